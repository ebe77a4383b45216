"""Hard negatives against comparing all rows; the tree's ranges leave leaves out and lose nothing."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import hard_negatives as hn
from marketlens.llm import hyperplane_tree as ht

SCHEMA = "vec_id long, embedding array<double>, label int, id string, score string, leaf string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


def mined(df, **kw):
    rows = hn.prepared(F.col("vec_id"), F.col("label"), F.col("embedding"), df)
    out = hn.mine_hard_negatives(rows, F.col("id") % 100 == 0, **kw)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in out.collect())


def brute(rows, least=80, most=100):
    good, seen = [], set()
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = tuple(math.floor(256 * x) for x in v)
        if sum(x * x for x in w) < 2 ** 62 and (i, label, w) not in seen:
            seen.add((i, label, w))
            good.append((i, w, label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731  (a shorter vector ends in zeros)
    out = []
    for a in good:
        if a[0] % 100:
            continue
        others = sorted((-dot(a[1], b[1]), b[0], b[2]) for b in good if b is not a)
        for p, pid, _ in [o for o in others if o[2] == a[2]][:5]:
            near = [(n, nid) for n, nid, lab in others if lab != a[2] and least * -p <= 100 * -n <= most * -p][:5]
            out += [(a[0], pid, k + 1, nid, -p, -n) for k, (n, nid) in enumerate(near)]
    return sorted(out)


def clustered(n, seed=1, dim=12, centres=15):
    rnd = np.random.default_rng(seed)
    c = rnd.standard_normal((centres, dim))
    v = c[rnd.integers(0, centres, n)] + 0.15 * rnd.standard_normal((n, dim))
    return [(i, (x / np.linalg.norm(x)).tolist(), int(rnd.integers(0, 4))) for i, x in enumerate(v)]


def test_equals_brute_force_with_a_small_sample(spark, monkeypatch):
    monkeypatch.setattr(hn, "SAMPLE", 300)
    monkeypatch.setattr(hn, "LEAF", 60)
    monkeypatch.setattr(hn, "CELL", 40)  # leaves of several cells
    rows = clustered(1500)
    rows += [(10_000 + i, rows[7][1], i % 3) for i in range(700)]  # a third are copies: ties everywhere
    assert mined(frame(spark, rows).repartition(5)) == brute(rows)


def test_awkward_rows(spark):
    rows = clustered(250, seed=2, dim=3)
    rows += [(100, rows[0][1], 1), (0, rows[5][1], 2), (0, rows[5][1], 2), (None, [1.0, 0.0, 0.0], 1), (300, None, 1), (301, [1.0, None, 0.0], 1),
             (302, [math.nan, 0.0, 0.0], 1), (303, [math.inf, 0.0, 0.0], 1), (304, [1.0, 0.0, 0.0], None), (400, [0.0, 0.0, 0.0], 1), (500, [], 2),
             (600, [0.5], 3), (601, [0.5, 0.5, 0.5, 0.5, 0.5], 3), (700, [1e300, 0.0, 0.0], 1), (800, [-0.7, 0.1, 0.0], 9)]
    assert mined(frame(spark, rows)) == brute(rows)


def test_scores_beyond_53_bits_are_exact(spark):
    rnd = random.Random(3)
    rows = [(i * 10, [2.0 ** 21 + rnd.random(), rnd.random() * 2.0 ** 21], i % 3) for i in range(60)]
    assert mined(frame(spark, rows)) == brute(rows)


def test_nothing(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(100, [1.0], 1)])) == []


def test_ranges_leave_leaves_out_and_lose_nothing():
    rows = np.array([r[1] for r in clustered(4000, seed=5)])
    tree = ht.grow(rows[::8], 0.03)
    leaf, seen = ht.route(tree, rows)
    for node, found in zip(tree.nodes, seen, strict=True):
        node.low, node.high = found
    queries = rows[:100]
    d = ht.distances(queries, rows)
    inner, outer = np.sort(d, axis=1)[:, [3]], np.sort(d, axis=1)[:, [40]]
    q, at = ht.rings(tree, queries, inner, outer, 1e-9)
    visited = set(zip(q.tolist(), at.tolist()))
    for i, j in zip(*np.nonzero((d >= inner) & (d <= outer)), strict=True):
        assert (i, leaf[j]) in visited
    assert tree.leaves > 20 and len(visited) < 0.5 * len(queries) * tree.leaves  # most are left out
    assert len(ht.rings(tree, queries, outer, inner, 0)[0]) == 0  # an empty ring visits nothing


@pytest.mark.parametrize("n", [0, 1, 5])
def test_tree_of_few_rows_is_a_leaf(n):
    tree = ht.grow(np.ones((n, 3)), 0.1)
    assert tree.leaves == 1 and not tree.nodes
    q, at = ht.rings(tree, np.zeros((2, 3)), np.zeros((2, 1)), np.full((2, 1), np.inf), 0)
    assert q.tolist() == [0, 1] and at.tolist() == [0, 0]
