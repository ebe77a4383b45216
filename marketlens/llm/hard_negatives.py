"""Hard-negative mining over a multiway hyperplane tree (``hyperplane_tree``).

The score of two rows is their inner product, in whole numbers. With M the largest norm of all rows and a
further component sqrt(M^2 - |x|^2) for a row, 0 for an anchor, the distance between anchor a and row x is
sqrt(|a|^2 + M^2 - 2 score): a window of scores is a ring around the anchor, so the tree's ranges tell which
leaves can hold a row of the window.

1. The tree grows from a sample of SAMPLE rows (fewer where vectors are long); every row is routed to its
   leaf and the ranges are taken over all rows. Leaves are kept in cells of about CELL rows.
2. Positives: each anchor visits the leaves within the distance of the best ``positives`` rows of its label in
   the sample; exact scores in every cell visited, the best of the cells' bests.
3. Negatives: each anchor visits the leaves that its positives' score windows reach, the lower ends raised to
   what the sample already offers; exact again.

A cell is read once a pass and its visitors stream by, so a task holds one cell whatever the number of
anchors or of equal vectors. The results are those of comparing all rows, whatever the sample.

Defined cases: rows without an id, label or vector, or with a null or non-finite component, take no part, nor
do rows whose squared norm does not fit 62 bits; a repeated row is one row, rows that share an id but differ are
rows of their own; a shorter vector is compared as if it ended in zeros; an anchor without another row of its
label has no result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm import hyperplane_tree as ht
from marketlens.llm.store import bounded_sample, written

SAMPLE, SAMPLE_VALUES = 16_384, 1 << 20  # rows of the sample; at most so many components in all
LEAF, CELL, VISITORS = 2_048, 4_096, 256
EXACT = 1 << 53  # below, float64 products and sums are exact

ROW = "id long, key long, label long, v array<int>"


def prepared(id_: Column, label: Column, vector: Column, rows: DataFrame, scale: int = 256) -> DataFrame:
    """(id, key, label, v) of the rows that take part; v = floor(scale * x)."""
    named = rows.select(id_.cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("x"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))).select(
        "id", "label", F.transform("x", lambda c: F.floor(c.cast("double") * scale)).alias("v"))
    small = whole.filter(_norm2("v") < float(1 << 62))
    return small.select("id", "label", F.col("v").cast("array<int>").alias("v")).distinct().select(
        "id", F.xxhash64("id", "label", "v").alias("key"), "label", "v")


def _norm2(v: str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class Index:
    """What every task gets: the tree, the sample, the largest squared norm."""

    def __init__(self, sample: list, dim: int, norm2: float, n: int):
        self.dim, self.norm2 = dim, norm2
        v = np.zeros((len(sample), dim), np.int64)
        for i, r in enumerate(sample):
            v[i, :len(r["v"])] = r["v"]
        order = sorted(range(len(sample)), key=lambda i: (sample[i]["id"], sample[i]["key"]))
        self.cell = Cell(np.array([sample[i]["id"] for i in order], np.int64), np.array([sample[i]["key"] for i in order], np.int64),
                         np.array([sample[i]["label"] for i in order], np.int64), v[order], norm2)
        self.tree = ht.grow(self.placed(v), LEAF / max(1, n))

    @property
    def slack(self) -> float:
        return 1e-6 * (1 + np.sqrt(self.norm2))

    def placed(self, v: np.ndarray) -> np.ndarray:
        """Rows with the component that makes inner products distances."""
        x = v.astype(np.float64)
        return np.concatenate([x, np.sqrt(np.maximum(0, self.norm2 - (x * x).sum(axis=1)))[:, None]], axis=1)

    def reach(self, anchors: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distance of the rows that score ``scores`` (one column a score)."""
        x = anchors.astype(np.float64)
        return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + self.norm2 - 2 * scores))

    def leaves(self, anchors: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        asked = np.concatenate([anchors.astype(np.float64), np.zeros((len(anchors), 1))], axis=1)
        return ht.rings(self.tree, asked, inner, outer, self.slack)


class Cell:
    """Rows in the order of (id, key), and the best of them for a block of anchors."""

    def __init__(self, ids, keys, labels, v, norm2):
        self.ids, self.keys, self.labels, self.exact = ids, keys, labels, norm2 < EXACT
        self.v = v.astype(np.float64) if self.exact else v

    def scores(self, v: np.ndarray) -> np.ndarray:
        return (v.astype(np.float64) @ self.v.T).astype(np.int64) if self.exact else v @ self.v.T

    def best(self, scores: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, row) of the first ``k`` rows with ``ok`` of every anchor, in order: high scores first, then small ids."""
        lowest = np.iinfo(np.int64).min
        held = np.where(ok, scores, lowest)
        if held.shape[1] > k:
            least = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
            ok = ok & (held >= least[:, None])
        a, r = np.nonzero(ok)
        order = np.lexsort((r, -scores[a, r], a))
        a, r = a[order], r[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        return a[place < k], r[place < k]

    def same_label(self, ids, keys, labels) -> np.ndarray:
        itself = (self.ids[None, :] == ids[:, None]) & (self.keys[None, :] == keys[:, None])
        return (self.labels[None, :] == labels[:, None]) & ~itself

    def window(self, scores, labels, positive, least, most) -> np.ndarray:
        """Rows of another label whose score lies between ``least`` and ``most`` percent of ``positive``."""
        p = positive[:, None]
        # 100 * score and percent * positive may pass 64 bits: compared as quotients of whole numbers
        low, high = -((-p * least) // 100) if self.exact else _percent(p, least, True), p * most // 100 if self.exact else _percent(p, most, False)
        return (self.labels[None, :] != labels[:, None]) & (scores >= low) & (scores <= high)


def _percent(p: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """percent * p / 100 rounded up or down, without passing 64 bits."""
    whole, rest = np.divmod(p, 100)
    return whole * percent + (-((-rest * percent) // 100) if up else rest * percent // 100)


def _route(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """Rows with their leaf; at the end of a partition the ranges its rows need, one row an entry."""
    nodes, fan = index.tree.nodes, ht.FAN
    low, high = np.full((len(nodes), fan, fan), np.inf), np.full((len(nodes), fan, fan), -np.inf)
    for batch in batches:
        leaf, seen = ht.route(index.tree, index.placed(_matrix(batch.column(3), index.dim)))
        for i, found in enumerate(seen):
            if found is not None:
                k = len(found[0])
                low[i, :k, :k] = np.minimum(low[i, :k, :k], found[0])
                high[i, :k, :k] = np.maximum(high[i, :k, :k], found[1])
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(leaf), pa.nulls(n, pa.int32()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())],
            names=[*batch.schema.names, "leaf", "entry", "low", "high"])
    entry = np.flatnonzero(np.isfinite(low.reshape(-1))).astype(np.int32)
    if len(entry):
        n = len(entry)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.int32()),
             pa.array(entry), pa.array(low.reshape(-1)[entry]), pa.array(high.reshape(-1)[entry])],
            names=["id", "key", "label", "v", "leaf", "entry", "low", "high"])


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(batch.column(i).to_numpy() for i in range(3))


def _visits(batches: Iterator[pa.RecordBatch], index: Index, rings: Callable) -> Iterator[pa.RecordBatch]:
    """Each anchor once for every leaf its rings reach. Columns: id, key, label, v, scores."""
    for whole in batches:
        for at in range(0, whole.num_rows, VISITORS):
            batch = whole.slice(at, VISITORS)
            v = _matrix(batch.column(3), index.dim)
            q, leaf = index.leaves(v, *rings(batch, v))
            taken = batch.take(pa.array(q.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaf.astype(np.int32))], names=[*batch.schema.names, "leaf"])


def _nearest_ring(index: Index, k: int) -> Callable:
    """From the anchor to the k-th best row of its label in the sample."""
    def rings(batch, v):
        ids, keys, labels = _columns(batch)
        scores = index.cell.scores(v)
        a, r = index.cell.best(scores, index.cell.same_label(ids, keys, labels), k)
        outer = np.full((len(v), 1), np.inf)
        last = np.searchsorted(a, np.arange(len(v)), side="right") - 1
        full = np.bincount(a, minlength=len(v)) == k
        outer[full] = index.reach(v, scores[np.arange(len(v)), np.where(full, r[last] if len(r) else 0, 0)][:, None])[full]
        return np.zeros_like(outer), outer

    return rings


def _window_rings(index: Index, n: int, k: int, least: int, most: int) -> Callable:
    """One ring a positive; a place without a positive has none."""
    def rings(batch, v):
        _, _, labels = _columns(batch)
        sizes = np.diff(batch.column(4).offsets.to_numpy())
        positive = _matrix(batch.column(4), n)
        inner, outer = np.full((len(v), n), np.inf), np.full((len(v), n), -np.inf)
        scores = index.cell.scores(v)
        for i in range(n):
            has = sizes > i
            p = positive[:, i]
            low = -((-p * float(least)) // 100)
            a, r = index.cell.best(scores, index.cell.window(scores, labels, p, least, most), k)
            full = np.bincount(a, minlength=len(v)) == k
            last = np.searchsorted(a, np.arange(len(v)), side="right") - 1
            if full.any():
                low = np.where(full, np.maximum(low, scores[np.arange(len(v)), np.where(full, r[last], 0)]), low)
            high = p * float(most) / 100
            some = has & (low <= high)
            inner[some, i] = index.reach(v, high[:, None])[some, 0]
            outer[some, i] = index.reach(v, low[:, None])[some, 0]
        return inner, outer

    return rings


def _cells(batches: Iterator[pa.RecordBatch], index: Index, answer: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell, a cell's own rows before its visitors."""
    now, parts, cell = None, [], None
    for whole in batches:
        if not whole.num_rows:
            continue
        place = np.stack([whole.column(c).to_numpy() for c in ("leaf", "block", "kind")])
        edges = np.concatenate([[0], np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1, [whole.num_rows]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            leaf, block, kind = place[:, a].tolist()
            if now != (leaf, block):
                now, parts, cell = (leaf, block), [], None
            run = whole.slice(a, b - a)
            if kind == 0:
                parts.append(run)
                continue
            if cell is None and parts:
                rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                cell = Cell(*_columns(rows), _matrix(rows.column(3), index.dim), index.norm2)
            for at in range(0, run.num_rows if cell else 0, VISITORS):
                some = run.slice(at, VISITORS)
                columns = answer(cell, some, _matrix(some.column(3), index.dim))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _positives_of(k: int) -> Callable:
    def answer(cell: Cell, batch, v):
        ids, keys, labels = _columns(batch)
        scores = cell.scores(v)
        a, r = cell.best(scores, cell.same_label(ids, keys, labels), k)
        return ids[a], keys[a], cell.ids[r], cell.keys[r], scores[a, r]

    return answer


def _negatives_of(n: int, k: int, least: int, most: int) -> Callable:
    def answer(cell: Cell, batch, v):
        ids, keys, labels = _columns(batch)
        sizes = np.diff(batch.column(4).offsets.to_numpy())
        positive, scores = _matrix(batch.column(4), n), cell.scores(v)
        out = []
        for i in range(n):
            ok = cell.window(scores, labels, positive[:, i], least, most) & (sizes > i)[:, None]
            a, r = cell.best(scores, ok, k)
            out.append((ids[a], keys[a], np.full(len(a), i, np.int32), cell.ids[r], cell.keys[r], scores[a, r]))
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    return answer


def _exact(placed: DataFrame, visits: DataFrame, blocks: Column, index: Index, answer: Callable, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    rows = placed.select("id", "key", "label", "v", F.array().cast("array<long>").alias("scores"), "leaf",
                         F.pmod(F.xxhash64("key"), blocks).cast("int").alias("block"), F.lit(0).alias("kind"))
    asked = visits.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("kind", F.lit(1))
    dealt = rows.unionByName(asked).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind", "id", "key")
    return dealt.mapInArrow(lambda b: _cells(b, index, answer, names), schema)


def mine_hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5,
                        least: int = 80, most: int = 100) -> DataFrame:
    """``rows`` from ``prepared``; ``is_anchor`` over its columns. One row a hard negative: anchor_id, positive_id,
    positive_rank, rank, negative_id, positive_score, negative_score. A negative scores between ``least`` and ``most``
    percent of the positive."""
    rows = written(rows, "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(_norm2("v")).alias("norm2")).first()
    dim, norm2, n = size["dim"] or 0, size["norm2"] or 0.0, size["n"]
    sample = bounded_sample(rows, min(SAMPLE, SAMPLE_VALUES // max(1, dim) + 1), F.xxhash64("key")).collect()
    index = Index(sample, dim, norm2, n)

    both = written(rows.mapInArrow(lambda b: _route(b, index), f"{ROW}, leaf int, entry int, low double, high double"), "placed")
    placed = both.filter("entry is null").select("id", "key", "label", "v", "leaf")
    fan = ht.FAN
    for node in index.tree.nodes:
        k = len(node.points)
        node.low, node.high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
    found = both.filter("entry is not null").groupBy("entry").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    for r in found:  # at most fan * fan entries a node of the tree
        node, at = divmod(r["entry"], fan * fan)
        index.tree.nodes[node].low[divmod(at, fan)], index.tree.nodes[node].high[divmod(at, fan)] = r["low"], r["high"]
    held = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # one row a leaf
    blocks = F.element_at(F.lit([max(1, -(-held.get(i, 0) // CELL)) for i in range(index.tree.leaves)]), F.col("leaf") + 1)

    anchors = placed.filter(is_anchor).select("id", "key", "label", "v", F.array().cast("array<long>").alias("scores"))
    to_leaf = f"{ROW}, scores array<long>, leaf int"
    near = anchors.mapInArrow(lambda b: _visits(b, index, _nearest_ring(index, positives)), to_leaf)
    pairs = _exact(placed, near, blocks, index, _positives_of(positives), "id long, key long, other long, other_key long, score long")
    ranked = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.desc("score"), "other", "other_key"))
    first = written(pairs.withColumn("place", ranked).filter(F.col("place") <= positives), "positives")

    lists = first.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("p"))
    with_scores = anchors.drop("scores").join(lists, ["id", "key"]).select("id", "key", "label", "v", F.col("p.score").alias("scores"))
    ringed = with_scores.mapInArrow(lambda b: _visits(b, index, _window_rings(index, positives, negatives, least, most)), to_leaf)
    hits = _exact(placed, ringed, blocks, index, _negatives_of(positives, negatives, least, most),
                  "id long, key long, place int, other long, other_key long, score long")
    order = Window.partitionBy("id", "key", "place").orderBy(F.desc("score"), "other", "other_key")
    best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named = first.select("id", "key", (F.col("place") - 1).alias("place"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return best.join(named, ["id", "key", "place"]).select(
        F.col("id").alias("anchor_id"), "positive_id", (F.col("place") + 1).alias("positive_rank"), "rank",
        F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
