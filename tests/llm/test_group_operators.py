import random
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlens.llm import components, embedding_dedup, minhash_dedup, mixing
from marketlens.llm.queries import QUERIES
from tests.llm.conftest import prose, rows


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_paths_stars_and_noise(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(100, 130)] + [(500, i) for i in range(501, 540)] + [(3, 3)]
    links += [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(45)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    links = [x for x in links if x[0] != x[1]]
    assert got == components_of({n for x in links for n in x}, links)


def test_components_of_no_links(spark):
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 2 MinHash near-dedup

def near_links(docs, weights):
    texts = [(i, t) for i, t in docs if t and t.split()]
    return [(a, b) for x, (a, s) in enumerate(texts) for b, t in texts[:x]
            if a != b and minhash_dedup.weighted_jaccard(s, t, weights) >= 0.8]


def test_near_duplicates_against_all_pairs(spark):
    docs, n = [], 0
    for g in range(8):
        base = prose(50 + g, 90 + 10 * g)
        for c in range(6):
            text = list(base)
            for e in range(c % 4):
                text[(17 * e + 5 * c) % len(text)] = f"edit{c}{e}"
            docs.append((n, " ".join(text)))
            n += 1
    docs += [(n, "one two"), (n + 1, "one  two"), (n + 2, "two one"), (n + 3, None), (n + 4, " ")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(df).collect()}
    weights = minhash_dedup.shingle_weights(df, "text")
    want = components_of([i for i, _ in docs], near_links(docs, weights))
    assert {i: r.component for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) for i, r in got.items())
    assert sum(r.kept for r in got.values()) < len(docs) - 20


def test_a_chain_that_its_bucket_end_does_not_link(spark):
    """Near copies of near copies: neighbours are alike, the ends of the chain are not."""
    docs, text = [], prose(77, 100)
    for i in range(12):
        docs.append((i, " ".join(text)))
        text = list(text)
        text[i * 8 + 2] = f"new{i}"
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component for r in minhash_dedup.near_duplicates(df).collect()}
    links = near_links(docs, minhash_dedup.shingle_weights(df, "text"))
    assert (11, 0) not in links and got == components_of(range(12), links) == dict.fromkeys(range(12), 0)


def test_many_documents_a_little_less_alike_than_the_threshold(spark):
    """Copies of one text with an edit each at different places: no pair is near, and few leave the join;
    with one pair of equal edits that must be found among them."""
    base, docs = prose(88, 60), []
    for i in range(40):
        text = list(base)
        text[3 + i % 50] = f"own{i}"
        text[(30 + 7 * i) % 60] = f"more{i}"
        docs.append((i, " ".join(text)))
    docs.append((100, docs[17][1] + " end"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    links = near_links(docs, minhash_dedup.shingle_weights(df, "text"))
    assert links and (100, 17) in links
    got = {r.doc_id: r.component for r in minhash_dedup.near_duplicates(df).collect()}
    want = components_of([i for i, _ in docs], links)
    assert got == want


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    got = minhash_dedup.near_duplicates(awkward).collect()
    assert len(got) == len(rows())
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].component for i in (3, 4, 5)] == [3, 3, 3] and [by_id[i].kept for i in (3, 4, 5)] == [True, False, False]
    assert all(by_id[i].kept for i in (1, 2, 6, 7, 8, 9, 10, 12, 13, 14, None))
    assert minhash_dedup.near_duplicates(nothing).count() == 0


def test_samples_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(3)
    shingles = np.sort(rng.integers(0, 1 << 48, 400, dtype=np.uint64))
    weights = rng.uniform(1, 2, 400)
    for share in (0.6, 0.9):
        hits, total = 0, 0
        for turn in range(30):
            fresh = minhash_dedup.mix(shingles + np.uint64(turn)) >> np.uint64(16)
            order = np.argsort(fresh)
            a, wa = fresh[order], weights[order]
            keep = rng.random(400) < share
            both = np.concatenate([a, a[keep]])
            got = minhash_dedup.consistent_samples(both, np.concatenate([wa, wa[keep]]), np.array([0, 400, 400 + keep.sum()]))
            hits += (got[0] == got[1]).sum() / minhash_dedup.SAMPLES
            total += wa[keep].sum() / wa.sum()
        assert abs(hits / 30 - total / 30) < 0.05


# ---- 4 embeddings

def brute_embeddings(ids, vectors):
    links = defaultdict(set)
    sound = [(i, np.array(v, float)) for i, v in zip(ids, vectors, strict=True)
             if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for a, x in sound:
        for b, y in sound:
            if a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                links[a].add(b)
    return links


def test_embeddings_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(12):
        center = rng.normal(size=16)
        vectors += [(center + rng.normal(size=16) * s).astype(np.float32).tolist() for s in np.linspace(0.02, 0.35, 12)]
    vectors += [vectors[0]] * 3 + [[2 * x for x in vectors[0]]]
    vectors += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0]]
    ids = [*range(len(vectors))]
    data = [*zip(ids, vectors, strict=True), (None, vectors[0]), (4, vectors[4])]
    df = spark.createDataFrame([(*d, 1, "x") for d in data], "vec_id long, embedding array<float>, label int, rep string")
    want = brute_embeddings(ids, vectors)
    group = components_of(ids, [(a, b) for a in want for b in want[a]])
    for block in (512, 5):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        got = embedding_dedup.link_embeddings(df).collect()
        assert len(got) == len(data)
        named = {r.vec_id: r for r in got if r.vec_id is not None}
        assert {i: named[i].n_links for i in ids} == {i: len(want[i]) for i in ids}
        assert {i: named[i].component_id for i in ids} == group
        assert all(named[i].kept == (i == group[i]) for i in ids)
    assert embedding_dedup.link_embeddings(df.filter("false")).count() == 0


def test_embeddings_of_doubles(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link_embeddings(df).collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


# ---- 8 mixing

def test_targets_stop_at_twice_the_size():
    got = mixing.targets({"a": 10, "b": 1000, "c": 1000, None: 500}, 1.5 * 2510)
    assert got["a"] == 20 and sum(got.values()) == pytest.approx(3765)
    assert got[None] == 1000 and got["b"] == pytest.approx(2 * got["c"])


def test_flow_meets_quotas_with_least_repetition():
    patterns = {("a",): 100, ("b",): 50, ("a", "b"): 100}
    flow = mixing.min_cost_flow(patterns, {"a": 150, "b": 100})
    into = defaultdict(int)
    used = defaultdict(int)
    for (p, s), n in flow.items():
        into[s] += n
        used[p] += n
    assert dict(into) == {"a": 150, "b": 100}
    assert dict(used) == {("a",): 100, ("b",): 50, ("a", "b"): 100}  # nothing is repeated
    flow = mixing.min_cost_flow(patterns, {"a": 400, "b": 0})
    assert sum(n for (_, s), n in flow.items() if s == "a") == 400  # both patterns twice
    assert sum(mixing.min_cost_flow(patterns, {"a": 10_000, "b": 0}).values()) == 400


def taken_by_source(spark, docs, seed=None):
    sized = docs.select("doc_id", "source", mixing.as_sources("source").alias("sources"), mixing.token_count().alias("size"),
                        mixing.seeded_hash("doc_id", "text").alias("h"))
    plans, sources = mixing.plan(sized)
    return mixing.with_copies(sized, plans).withColumn("taken", F.col("size") * F.col("n_copies")), sources


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(["w"] * rng.choice([1, 3, 10, 40, 200])), rng.choice(["a"] * 6 + ["b", "c", "d", None])) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    taken, sources = taken_by_source(spark, df)
    wanted = {r.source: (r.source_size, r.target) for r in sources.collect()}
    got, size = defaultdict(int), defaultdict(int)
    out = taken.collect()
    for r in out:
        got[r.source] += r.taken
        size[r.source] += r["size"]
        assert 0 <= r.taken <= 2 * r["size"]
    assert len(out) == len(docs) and {s: w[0] for s, w in wanted.items()} == dict(size)
    assert sum(w[1] for w in wanted.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(abs(got[s] - wanted[s][1]) <= max(2, 0.01 * wanted[s][1]) for s in wanted)
    again, _ = taken_by_source(spark, df.repartition(7))
    assert sorted((r.doc_id, r.taken) for r in again.collect()) == sorted((r.doc_id, r.taken) for r in out)


def test_overlapping_sources_share_documents(spark):
    docs = [(i, "w " * (5 + i % 11), ["a"] if i % 3 else ["a", "b"]) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, sources array<string>")
    sized = df.select("sources", mixing.token_count().alias("size"), mixing.seeded_hash("doc_id", "text").alias("h"))
    plans, sources = mixing.plan(sized)
    total = sized.agg(F.sum("size")).first()[0]
    taken = mixing.with_copies(sized, plans).agg(F.sum(F.col("size") * F.col("n_copies"))).first()[0]
    assert abs(taken - 1.5 * total) <= 10 and {r.source for r in sources.collect()} == {"a", "b"}


def test_mix_of_awkward_rows(awkward, nothing):
    mixed = mixing.mix_documents(awkward, mixing.as_sources("source"))
    assert mixed.columns == awkward.columns
    counts = {(r.doc_id, r.text): r["count"] for r in mixed.groupBy("doc_id", "text").count().collect()}
    assert all(t and t.split() for _, t in counts)
    assert mixing.mix_documents(nothing, mixing.as_sources("source")).count() == 0


def test_registered_mix(spark):
    got = QUERIES["op8_source_mixing"](spark, "/root/testdata/sf0.001").toPandas()
    assert (got.taken <= 2 * got["size"]).all() and len(got) == 200


# ---- 2, 10: what a shingle weighs

def test_shingles_weigh_by_their_own_document_frequency(spark, monkeypatch):
    """3,000 documents of which a third hold one passage: weights against counts of the shingles themselves."""
    monkeypatch.setattr(minhash_dedup, "HEAD", 50)
    passage = " ".join(prose(3, 20))
    docs = [(i, " ".join(prose(1000 + i - i % 2, 60)) + (" " + passage if i % 3 == 0 else "")) for i in range(3000)]
    df = spark.createDataFrame([(i, i, t) for i, t in docs], "node long, k long, text string").repartition(3)
    held = {i: set(minhash_dedup.shingle_counts([t.encode()])[0].tolist()) for i, t in docs}
    want = defaultdict(int)
    for x in held.values():
        for h in x:
            want[h] += 1
    rest, weights = minhash_dedup.frequencies(df, "text")
    assert 0 < len(weights.hashes) <= 50 and weights.documents == 3000
    shipped = spark.sparkContext.broadcast(weights)
    rows_ = minhash_dedup.with_frequencies(df, rest, shipped).collect()
    assert len(rows_) == len(docs)
    for r in rows_:
        own = np.array(r.own or [], np.int64).view(np.uint64), np.array(r.own_counts or [], np.int64)
        got = minhash_dedup.weighted_shingles(r.text, weights, *own)
        idf = [1 + np.log(3001 / (want[h] + 1)) / np.log(3001) for h in got[0].tolist()]
        assert np.allclose(got[1], idf, rtol=1e-5)


@pytest.mark.parametrize("head", [0, 400])
def test_frequencies_of_many_chunks_and_ranges(spark, monkeypatch, head):
    """Rows that count several times, over dozens of chunks, told their shingles by dozens of ranges."""
    monkeypatch.setattr(minhash_dedup, "CHUNK", 4000)
    monkeypatch.setattr(minhash_dedup, "HEAD", head)
    passage = " ".join(prose(3, 20))
    docs = [(i, " ".join(prose(500 + i - i % 2, 40)) + f" end{i}" + (" " + passage if i % 3 == 0 else ""), 1 + 4 * (i % 5 == 0)) for i in range(400)]
    docs += [(1000, "", 7), (1001, None, 1)]
    df = spark.createDataFrame(docs, "node long, text string, copies long").repartition(3)
    held = {i: minhash_dedup.shingle_counts([(t or "").encode()])[0].tolist() for i, t, _ in docs}
    want = defaultdict(int)
    for i, _, n in docs:
        for h in held[i]:
            want[h] += n
    rest, weights = minhash_dedup.frequencies(df, "text", F.col("copies"))
    assert weights.chunks > 20 and weights.documents == sum(n for i, _, n in docs if held[i])
    common = dict(zip(weights.hashes.tolist(), weights.counts.tolist(), strict=True))
    assert len(common) <= head and all(want[h] == n for h, n in common.items())
    got = minhash_dedup.with_frequencies(df, rest, spark.sparkContext.broadcast(weights)).collect()
    assert len(got) == len(docs)
    for r in got:
        told = dict(zip(np.array(r.own, np.int64).view(np.uint64).tolist(), r.own_counts, strict=True))
        assert told == {h: want[h] for h in held[r.node] if want[h] > 1 and h not in common}


def test_packed_runs():
    rng = np.random.default_rng(5)
    for n in (0, 1, 1000):
        run = np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64))
        assert (minhash_dedup.unpacked_run(minhash_dedup.packed_run(run)) == run).all()
    counts = np.array([1, 255, 256, (1 << 48) - 1], np.int64)
    assert minhash_dedup.unpacked(minhash_dedup.packed(counts)).tolist() == counts.tolist()


def test_pairs_that_differ_by_a_frequent_passage_in_a_cell_of_many_classes():
    """Their bare counts are less alike than the weighted ones: 40 pairs near by weight in one cell of 80 classes."""
    passage = prose(8, 76)
    common = minhash_dedup.shingle_counts([" ".join(passage).encode()])[0]
    weights = minhash_dedup.Weights(10_000, common, np.full(len(common), 3333))
    texts = [" ".join(prose(2000 + i // 2, 200) + passage * (i % 2)) for i in range(80)]
    assert all(0.8 <= minhash_dedup.weighted_jaccard(a, b, weights) < 0.83 for a, b in zip(texts[::2], texts[1::2], strict=True))
    none = pa.array([None] * 80, pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(80)), pa.array(texts), none, none], names=["node", "text", "own", "own_counts"])
    signed = pa.Table.from_batches(minhash_dedup._signatures(iter([batch]), SimpleNamespace(value=weights))).combine_chunks().to_batches()[0]
    zero, ids = pa.array(np.zeros(80, np.int64)), signed.column(0)
    cell = pa.RecordBatch.from_arrays([zero, zero, zero, zero, zero, ids, ids, signed.column(2), signed.column(3), batch.column(1), none, none],
                                      names=["lo", "hi", "band", "block", "at", "rep", "component", "bands", "sketch", "text", "own", "own_counts"])
    found = minhash_dedup._settle(cell, weights, 0.8)
    assert {(a, b) for a, b in found} <= {(i, i + 1) for i in range(0, 80, 2)} and len(found) >= 39


def test_texts_that_are_not_asked_for_stay_where_they_are(spark):
    """All rows that are asked for pass the map of bits, negative and large nodes too, and hardly any other."""
    rows = spark.range(20000).selectExpr("CASE WHEN id % 2 = 0 THEN id ELSE -id END * 922337203685 AS node", "CAST(id AS STRING) AS text")
    asked = rows.filter("CAST(text AS INT) % 10 = 3").select("node")
    got = minhash_dedup.among(rows, asked)
    assert got.columns == rows.columns
    assert got.join(asked, "node").count() == 2000 and got.count() < 2020
    assert minhash_dedup.among(rows, asked.limit(0)).isEmpty()
