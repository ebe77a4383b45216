"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine.

Normalised vectors are projected on Gaussian directions; PER_TABLE quantised projections
floor((a.v + b) / WIDTH) make one bucket, TABLES tables are searched. At cosine 0.9 (distance 0.447)
one projection agrees with probability 0.82, a table with 0.207 and one of 24 tables with 0.996;
at cosine 0.95 with 0.9999.

Equal vectors are one class and are searched once, with their number as weight. The vectors of a
bucket are compared by matrix products in double precision; a bucket beyond BLOCK vectors is cut
into blocks and every pair of blocks is a cell of its own, so no task holds a whole bucket. No pair
leaves its cell: a cell returns, per vector, how many it links to (a pair counts in the first table
that has both) and the smallest vector its links reach there, which is enough for the components.

Defined cases: a null, zero or empty vector, one with null or non-finite components, and one without
an id link with nothing and are kept; a repeated (id, vector) row is one vector; vectors of another
length than most are compared with those of their own length; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.components import connected
from marketlens.llm.store import written
from marketlens.llm.words import mix

TABLES, PER_TABLE, WIDTH, SEED, BLOCK = 24, 8, 2.0, 4, 512


def _keys(vectors: np.ndarray) -> np.ndarray:
    """Bucket hash of each row of ``vectors`` (normalised) in each table."""
    rng = np.random.default_rng([SEED, vectors.shape[1]])
    directions = rng.standard_normal((vectors.shape[1], TABLES * PER_TABLE))
    shift = rng.uniform(0, WIDTH, TABLES * PER_TABLE)
    cells = np.floor((vectors @ directions + shift) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(vectors), TABLES, PER_TABLE)
    key = np.tile(np.arange(TABLES, dtype=np.uint64) + np.uint64(vectors.shape[1] << 8), (len(vectors), 1))
    for i in range(PER_TABLE):
        key = mix(key ^ mix(cells[:, :, i] + np.uint64(i)))
    return key.view(np.int64)


def _normalised(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors in double precision) for each length present."""
    col = batch.column(column)
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        vectors = flat[starts[rows][:, None] + np.arange(n)]
        yield rows, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, vectors in _normalised(batch, 2):
            keys = _keys(vectors)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * TABLES), pa.array(keys.reshape(-1)))
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in range(3)] + [listed], names=["rep", "n", "vector", "keys"])


def _cell(rep, n, block, table, vectors, short, threshold):
    """(linked vectors' numbers, links of each, smallest vector each reaches) within one cell."""
    close = vectors @ vectors.T >= threshold
    np.fill_diagonal(close, False)
    if block.min() != block.max():
        close &= block[:, None] != block[None, :]
    i, j = np.nonzero(np.triu(close))
    if not len(i):
        return None
    first = ~(short[i, :table] == short[j, :table]).any(axis=1) if table else np.ones(len(i), bool)
    links = np.bincount(i[first], n[j[first]], len(rep)) + np.bincount(j[first], n[i[first]], len(rep))
    label = rep.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, before[i])
        if (label == before).all():
            break
    seen = np.unique(np.concatenate([i, j]))
    return rep[seen], links[seen].astype(np.int64), label[seen]


def _link(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; a cell may go on in the next batch."""
    held: list[pa.RecordBatch] = []

    def cells(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        batch = rows.to_batches()[0]
        key = np.stack([batch.column(c).to_numpy() for c in range(3)])
        edges = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
        rep, n, block, table = (batch.column(c).to_numpy() for c in (3, 4, 5, 6))
        short = batch.column(8).flatten().to_numpy().reshape(batch.num_rows, TABLES)
        found = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                (_, vectors), = _normalised(batch.slice(a, b - a), 7)
                if (hit := _cell(rep[a:b], n[a:b], block[a:b], int(table[a]), vectors, short[a:b], threshold)) is not None:
                    found.append(hit)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["rep", "links", "label"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in range(3)])
        cut = int(np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))[-1])
        starts_new = not held or any(held[-1].column(c)[-1] != batch.column(c)[0] for c in range(3))
        if cut == 0 and not starts_new:
            held.append(batch)
            continue
        head = [*held, batch.slice(0, cut)]
        if sum(b.num_rows for b in head):
            yield from cells(pa.Table.from_batches(head))
        held = [batch.slice(cut)]
    if held:
        yield from cells(pa.Table.from_batches(held))


def link_embeddings(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per row of ``vectors``: ``id_col``, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vector"))
    sound = (F.col("id").isNotNull() & F.col("vector").isNotNull()
             & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists("vector", lambda x: x != 0))
    good = rows.filter(F.coalesce(sound, F.lit(False))).distinct()
    classes = written(good.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("n")).select("rep", "n", "vector"), "classes")
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    keyed = written(classes.mapInArrow(_hash, f"rep long, n long, vector array<{kind}>, keys array<long>"), "keyed")

    buckets = keyed.select("rep", F.posexplode("keys").alias("table", "key"))
    sizes = written(buckets.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    members = keyed.select("rep", "n", "vector", F.transform("keys", _low).alias("short"), F.posexplode("keys").alias("table", "key"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = (members.join(sizes.hint("shuffle_hash"), "key")
              .withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                      "rep", "n", "block", "table", "vector", "short"))
    found = written(
        placed.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        .mapInArrow(lambda b: _link(b, threshold), "rep long, links long, label long"), "found")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    whole = connected(found.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    per_class = written(
        classes.join(links, "rep", "left").join(whole.withColumnRenamed("node", "rep"), "rep", "left")
        .select("vector", F.lit(True).alias("sound"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id")), "per-class")
    out = rows.join(per_class, "vector", "left")
    alone = F.col("sound").isNull() | F.col("id").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _low(key: Column) -> Column:
    """Low 32 bits of a bucket hash, signed."""
    return (F.pmod(key, F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")
