"""Near-duplicate documents by improved consistent weighted sampling.

A document is the weighted set of its shingles (WIDTH words; all of them for a shorter document). A
shingle's weight is its count times 1 + idf, with idf = ln((N + 1) / (df + 1)) / ln(N + 1) from the
whole corpus. Two documents are near if the weighted Jaccard similarity
sum(min) / sum(max) of their sets is at least ``threshold``.

df is counted for each shingle by ranges. Texts lie in chunks of about CHUNK bytes, and there are as many ranges
of shingles; a chunk sends each range its shingles as one sorted run, packed as differences, and gets back
those that more than one row of the corpus holds, with their df. A shingle is sent once a chunk, so the commonest weigh no
more than others; up to HEAD of them go to all tasks (a fixed size) and not back to the chunks.

SAMPLES = BANDS * ROWS consistent weighted samples (Ioffe's scheme: per shingle and sample r and c from
Gamma(2, 1), b uniform) agree with that similarity as probability; documents that agree on a whole
band are candidates: at 0.8 with probability 0.995, at 0.9 with 0.99997.

Documents of the same words are one class: one text of it is kept, which counts as often as the class has rows, and
is searched once. Candidates are verified in rounds that
form few more pairs than the links need, since pairs within a component need no check: first each
class of a band bucket against the bucket's smallest; then, within buckets that are still not one
component, classes of different components that fall in the same random part of about PART; last,
those of different components that are left. From the second round on the classes of a bucket meet in
cells (a part, or two blocks of at most BLOCK of a large bucket), where sketches are compared, then
the shingles of pairs that could be near, as long as the pair's sides are not joined yet; a cell returns
no more links than join its components, so that groups whose members are all a little less alike than
the threshold leave no pairs behind. A pair could be near, and is asked for in the first band it shares, if
at least AGREEING of all SAMPLES agree (a byte each), which estimates the judged similarity itself: missed at
a similarity of 0.8 with probability 0.008, at 0.85 with 0.0004. At 0.64 half of the pairs pass, at 0.5 one in 25.

Defined cases: a null text, and one without words, is near nothing and kept; documents are named by
their integer id, rows that share an id are one document; a null id is replaced by a number
past all ids, made from the text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.components import connected
from marketlens.llm.store import row_key, written
from marketlens.llm.words import chunked, mix, prefix, span, word_hashes
from marketlens.llm.workers import tidied

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 10, 4
SAMPLES = BANDS * ROWS
HEAD, COUNT_FLUSH, CHUNK, SEED = 1 << 18, 4_000_000, 8 << 20, 2
AGREEING, PART, BLOCK = 26, 16, 512
#: Bits of the map of nodes whose texts are asked for, 4 MB.
MAP_BITS = 1 << 25
#: Bits of a shingle hash that remain beside the document's number in a chunk.
_BITS = 48
_DOC_LIMIT = 1 << (64 - _BITS)
#: Bytes of a number in a packed run.
_BYTES = 6


def _random_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantile tables of Gamma(2, 1) as r and ln c, and a multiplier per sample."""
    rng = np.random.default_rng(SEED)
    gamma = rng.gamma(2.0, 1.0, (2, 1 << 16)).astype(np.float32)
    multipliers = rng.integers(1 << 62, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)
    return gamma[0], np.log(gamma[1]), multipliers


_R, _LN_C, _MULTIPLIERS = _random_tables()


def shingle_counts(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, counts, bounds, whole): the distinct shingles of raws[i], ascending, and their
    counts are at bounds[i]:bounds[i + 1]; whole[i] is the hash of all its words."""
    hashes, bounds = word_hashes(raws)
    sums, sizes = prefix(hashes), np.diff(bounds)
    whole = span(sums, bounds[:-1], bounds[1:])
    number = np.where(sizes == 0, 0, np.maximum(sizes - WIDTH + 1, 1))
    doc = np.repeat(np.arange(len(raws)), number)
    at = bounds[doc] + np.arange(len(doc)) - (np.cumsum(number) - number)[doc]
    shingles = span(sums, at, at + np.minimum(sizes, WIDTH)[doc]) >> np.uint64(64 - _BITS)
    both, counts = np.unique(doc.astype(np.uint64) << np.uint64(_BITS) | shingles, return_counts=True)
    doc = (both >> np.uint64(_BITS)).astype(np.int64)
    return both & np.uint64((1 << _BITS) - 1), counts, np.searchsorted(doc, np.arange(len(raws) + 1)), whole


def _runs(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    for first, raws in chunked(texts):
        for i in range(0, len(raws), _DOC_LIMIT):
            yield first + i, raws[i : i + _DOC_LIMIT]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**48, all their lowest bytes first, then all the next, which compress well where they are small."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES].T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // _BYTES, 8), np.uint8)
    out[:, :_BYTES] = np.frombuffer(raw, np.uint8).reshape(_BYTES, -1).T
    return out.reshape(-1).view("<u8")


def packed_run(ascending: np.ndarray) -> bytes:
    return packed(np.diff(ascending, prepend=np.uint64(0)))


def unpacked_run(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=np.uint64)


RUN = "chunk long, bucket long, h binary, c binary"
#: The range, and the chunk, of rows that count documents or go to all tasks.
ALL = -1


def _runs_of(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                                      names=["chunk", "bucket", "h", "c"])


def _sums(shingles: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles, ascending, and the sum of ``copies`` of each."""
    order = np.argsort(shingles)
    ascending = shingles[order]
    starts = np.flatnonzero(np.diff(ascending, prepend=~ascending[:1]))
    return ascending[starts], np.add.reduceat(copies[order], starts)


def _frequencies(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Runs of a chunk's shingles (chunk, copies, text), one for each range, with the rows that hold each."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    size, documents = 0, 0
    cuts = np.array([(i << _BITS) // buckets for i in range(1, buckets)], np.uint64)

    def flush() -> Iterator[pa.RecordBatch]:
        for chunk, parts in held.items():
            found, n = _sums(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            edges = [0, *np.searchsorted(found, cuts).tolist(), len(found)]
            yield _runs_of([(chunk, i, packed_run(found[a:b]), packed(n[a:b])) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b])
        held.clear()

    for batch in batches:
        chunk, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for first, raws in _runs(batch.column(2)):
            shingles, _, bounds, _ = shingle_counts(raws)
            sizes, own = np.diff(bounds), slice(first, first + len(raws))
            documents += int(copies[own][sizes > 0].sum())
            of, n = np.repeat(chunk[own], sizes), np.repeat(copies[own], sizes)
            for x in np.unique(of):
                held[int(x)].append((shingles[of == x], n[of == x]))
            size += len(shingles)
            if size >= COUNT_FLUSH:
                yield from flush()
                size = 0
    yield from flush()
    yield _runs_of([(ALL, ALL, b"", packed(np.array([documents])))])


def _replies(runs: pa.Table, head: int) -> pa.Table:
    """What each chunk is told of a range: its shingles that several rows hold, but for the ``head`` commonest, which go to all."""
    chunk, bucket = runs.column("chunk").to_pylist(), runs.column("bucket")[0].as_py()
    counts = [unpacked(x.as_py()).astype(np.int64) for x in runs.column("c")]
    if bucket == ALL:
        return pa.Table.from_batches([_runs_of([(ALL, ALL, b"", packed(sum((x.sum() for x in counts), np.zeros(1, np.int64))))])])
    shingles = [unpacked_run(x.as_py()) for x in runs.column("h")]
    found, total = _sums(np.concatenate(shingles), np.concatenate(counts))
    repeated = np.flatnonzero(total > 1)
    common = np.sort(repeated[np.argsort(-total[repeated], kind="stable")[:head]])
    told = total > 1
    told[common] = False
    rows = [(ALL, bucket, packed_run(found[common]), packed(total[common]))] if len(common) else []
    for i, own in enumerate(shingles):
        at = np.searchsorted(found, own)
        if len(at := at[told[at]]):
            rows.append((chunk[i], bucket, packed_run(found[at]), packed(total[at])))
    return pa.Table.from_batches([_runs_of(rows)])


class Weights:
    """1 + idf of shingles, from the commonest ones' frequencies and those that come with a row. A shingle in
    neither is in one row only."""

    def __init__(self, documents: int, hashes: np.ndarray, counts: np.ndarray, chunks: int = 1) -> None:
        order = np.argsort(hashes)
        self.documents, self.hashes, self.counts, self.chunks = documents, hashes[order], counts[order], chunks

    def __call__(self, shingles: np.ndarray, own: np.ndarray, own_counts: np.ndarray) -> np.ndarray:
        df = np.ones(len(shingles))
        for hashes, counts in ((self.hashes, self.counts), (own, own_counts)):
            known, at = _found(shingles, hashes)
            df[known] = counts[at[known]]
        return (1 + np.log((self.documents + 1) / (df + 1)) / np.log(self.documents + 1)).astype(np.float32)


NO_SHINGLES = np.zeros(0, np.uint64)


def _found(shingles: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each shingle is in the ascending ``among``, its place there)."""
    if not len(among):
        return np.zeros(len(shingles), bool), np.zeros(len(shingles), np.int64)
    at = np.minimum(np.searchsorted(among, shingles), len(among) - 1)
    return among[at] == shingles, at


def _chunk(text_col: str, chunks: int) -> Column:
    return F.pmod(F.xxhash64(text_col), F.lit(chunks)).alias("chunk")


def frequencies(docs: DataFrame, text_col: str, copies: Column | None = None) -> tuple[DataFrame, Weights]:
    """What each chunk of texts is told of its shingles, and the weights from the commonest ones. A row counts
    ``copies`` times; texts of a chunk meet in one task, so equal ones should be one row."""
    rows = docs.select(F.col(text_col).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies")).filter("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK))
    runs = rows.select(_chunk("text", chunks), "copies", "text").repartition("chunk").mapInArrow(tidied(lambda b: _frequencies(b, chunks)), RUN)
    head = HEAD // chunks
    replies = written(runs.groupBy("bucket").applyInArrow(lambda t: _replies(t, head), RUN), "replies")
    shared = replies.filter(F.col("chunk") == ALL).collect()
    documents = sum(int(unpacked(r["c"])[0]) for r in shared if r["bucket"] == ALL)
    common = [(unpacked_run(r["h"]), unpacked(r["c"])) for r in shared if r["bucket"] != ALL]
    hashes, counts = (np.concatenate(x) for x in zip(*common, strict=True)) if common else (NO_SHINGLES, NO_SHINGLES)
    return replies.filter(F.col("chunk") != ALL), Weights(documents, hashes, counts.astype(np.int64), chunks)


def shingle_weights(docs: DataFrame, text_col: str) -> Weights:
    """1 + idf of the HEAD commonest shingles of all documents; the others count as in one."""
    return frequencies(docs, text_col)[1]


def _own(rows: pa.Table, replies: pa.Table) -> pa.RecordBatch:
    """``rows`` of one chunk with ``own`` (ascending) and ``own_counts``, from what the chunk was told."""
    told = [(unpacked_run(h.as_py()), unpacked(c.as_py())) for h, c in zip(replies.column("h"), replies.column("c"), strict=True)]
    known, counts = (np.concatenate(x) for x in zip(*told, strict=True)) if told else (NO_SHINGLES, NO_SHINGLES)
    known, at = np.unique(known, return_index=True)
    counts = counts[at]
    own, own_counts, sizes = [NO_SHINGLES], [NO_SHINGLES], []
    for _, raws in _runs(rows.column("text").combine_chunks()):
        shingles, _, bounds, _ = shingle_counts(raws)
        held, at = _found(shingles, known)
        own.append(shingles[held])
        own_counts.append(counts[at[held]])
        sizes.append(np.diff(np.searchsorted(np.flatnonzero(held), bounds)))
    edges = pa.array(np.concatenate([[0], np.cumsum(np.concatenate([[0], *sizes])[1:])]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate(x).view(np.int64))) for x in (own, own_counts)]
    columns = [rows.column(c).combine_chunks() for c in rows.column_names]
    return pa.RecordBatch.from_arrays([*columns, *lists], names=[*rows.column_names, "own", "own_counts"])


def per_chunk(rows: DataFrame, rest: DataFrame, chunks: int, run: Callable[[pa.RecordBatch], pa.Table], schema: str) -> DataFrame:
    """``run`` of the rows (.., text) of each chunk with ``own`` and ``own_counts`` added."""
    names = rows.columns

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(_own(left.select(names), right))

    return rows.withColumn("chunk", _chunk("text", chunks)).groupBy("chunk").cogroup(rest.groupBy("chunk")).applyInArrow(meet, schema)


def with_frequencies(rows: DataFrame, rest: DataFrame, shipped) -> DataFrame:
    """``rows`` (.., text) with ``own`` (ascending) and ``own_counts``: the document frequencies of its shingles in ``rest``."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return per_chunk(rows, rest, shipped.value.chunks, lambda b: pa.Table.from_batches([b]), f"{ddl}, own array<long>, own_counts array<long>")


def consistent_samples(shingles: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SAMPLES hashes of each document that holds shingles, in the order of ``bounds``."""
    full = np.flatnonzero(np.diff(bounds))
    starts, owner = bounds[full], np.repeat(np.arange(len(full)), np.diff(bounds)[full])
    ln_weight = np.log(weights).astype(np.float32)
    spread = mix(shingles)
    out = np.empty((len(full), SAMPLES), np.uint64)
    for k in range(SAMPLES):
        drawn = spread * _MULTIPLIERS[k]
        r = _R[(drawn >> np.uint64(48)).astype(np.int32)]
        ln_c = _LN_C[((drawn >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int32)]
        b = ((drawn >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(ln_weight / r + b)
        ln_a = ln_c - r * (t - b) - r
        hit = np.flatnonzero(ln_a == np.minimum.reduceat(ln_a, starts)[owner])
        _, first = np.unique(owner[hit], return_index=True)
        chosen = hit[first]
        out[:, k] = mix(shingles[chosen]) ^ (t[chosen].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _signatures(batches: Iterator[pa.RecordBatch], shipped) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, raws in _runs(batch.column(1)):
            shingles, counts, bounds, whole = shingle_counts(raws)
            full = np.flatnonzero(np.diff(bounds))
            if not len(full):
                continue
            weights = np.concatenate([shipped.value(shingles[a:b], *own_frequencies(batch, 2, first + i))
                                      for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]) * counts
            samples = consistent_samples(shingles, weights, bounds)
            sketch = np.ascontiguousarray(mix(samples).astype(np.uint8)).view(np.int64)
            samples = samples.reshape(len(full), BANDS, ROWS)
            key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(full), 1))
            for i in range(ROWS):
                key = mix(key ^ samples[:, :, i])
            listed = [pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
                      for x in (key.view(np.int64), sketch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(first + full)), pa.array(whole[full].view(np.int64)), *listed],
                names=["node", "class", "bands", "sketch"])


SIGNATURE = pa.schema([("node", pa.int64()), ("class", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])


def _classes(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    """(node, class) or (node, class, text) of the rows (node, text) that hold words."""
    for batch in batches:
        for first, raws in chunked(batch.column(1)):
            hashes, bounds = word_hashes(raws)
            full = np.flatnonzero(np.diff(bounds))
            at = pa.array(first + full)
            whole = span(prefix(hashes), bounds[:-1], bounds[1:])[full].view(np.int64)
            text = {"text": batch.column(1).take(at)} if keep_text else {}
            yield pa.RecordBatch.from_pydict({"node": batch.column(0).take(at), "class": pa.array(whole), **text})


def own_frequencies(batch: pa.RecordBatch, column: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of ``own`` (at ``column``) of row i, and their ``own_counts`` from the column after it."""
    own, counts = batch.column(column)[i].values, batch.column(column + 1)[i].values
    return (own.to_numpy().view(np.uint64), counts.to_numpy()) if own is not None else (NO_SHINGLES, NO_SHINGLES)


def weighted_shingles(text: str, weights: Weights, own: np.ndarray = NO_SHINGLES, own_counts: np.ndarray = NO_SHINGLES) -> tuple[np.ndarray, np.ndarray]:
    shingles, counts, _, _ = shingle_counts([text.encode()])
    return shingles, weights(shingles, own, own_counts).astype(np.float64) * counts


def similarity(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of distinct shingles with weights."""
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = np.minimum(wx[i], wy[j]).sum()
    return float(shared / (wx.sum() + wy.sum() - shared))


def weighted_jaccard(a: str, b: str, weights: Weights) -> float:
    return similarity(*weighted_shingles(a, weights), *weighted_shingles(b, weights))


def _verify(batches: Iterator[pa.RecordBatch], shipped, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = [[weighted_shingles(batch.column(c)[i].as_py(), shipped.value, *own_frequencies(batch, c + 1, i)) for c in (2, 5)] for i in range(batch.num_rows)]
        alike = np.array([similarity(*x, *y) for x, y in sides])
        keep = pa.array(np.flatnonzero(alike >= threshold))
        yield pa.RecordBatch.from_arrays([batch.column(i).take(keep) for i in range(2)], names=["a", "b"])


def _cells(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of one cell at a time: rows come sorted by the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in range(keys)])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for first, end in zip(cuts[:-1], cuts[1:], strict=True):
            piece = batch.slice(first, end - first)
            if held and any(held[-1].column(c)[-1] != piece.column(c)[0] for c in range(keys)):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _settle(cell: pa.RecordBatch, weights: Weights, threshold: float) -> list[tuple[int, int]]:
    """Links that join the components within a cell (columns lo, hi, band, block, at, rep, component,
    bands, sketch, text, own, own_counts); a pair is asked for in the first band it shares, if its sketches agree
    well enough, and only while its two sides are not joined yet."""
    block, rep, component = (cell.column(c).to_numpy() for c in (3, 5, 6))
    at, m = int(cell.column(4)[0].as_py()), cell.num_rows
    bands = cell.column(7).flatten().to_numpy().reshape(m, BANDS)
    samples = np.ascontiguousarray(cell.column(8).flatten().to_numpy()).view(np.uint8).reshape(m, SAMPLES)
    _, group = np.unique(component, return_inverse=True)
    parent = list(range(m))

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    @lru_cache(maxsize=2 * BLOCK)
    def vector(i: int) -> tuple[np.ndarray, np.ndarray]:
        return weighted_shingles(cell.column(9)[i].as_py(), weights, *own_frequencies(cell, 10, i))

    between = block.min() != block.max()
    found = []
    for i in range(m - 1):
        j = np.arange(i + 1, m)
        j = j[group[j] != group[i]]
        if between:
            j = j[block[j] != block[i]]
        j = j[~(bands[j, :at] == bands[i, :at]).any(axis=1)]
        j = j[(samples[j] == samples[i]).sum(axis=1) >= AGREEING]
        for k in j:
            x, y = root(group[i]), root(group[k])
            if x != y and similarity(*vector(i), *vector(int(k))) >= threshold:
                parent[x] = y
                found.append((int(rep[i]), int(rep[k])))
    return found


def _settled(batches: Iterator[pa.RecordBatch], shipped, threshold: float) -> Iterator[pa.RecordBatch]:
    for cell in _cells(batches, 3):
        if cell.num_rows > 1 and (found := _settle(cell, shipped.value, threshold)):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def among(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` whose node may be in ``asked``: all that are, and few others, told by a hash's bit in a broadcast map
    of MAP_BITS bits. A join with ``asked`` then moves little more than the rows it keeps."""
    place = F.pmod(F.xxhash64("node"), F.lit(MAP_BITS))
    bucket, bit = F.bitmap_bucket_number(place).alias("__bucket"), F.bitmap_bit_position(place)
    bits = asked.groupBy(bucket).agg(F.bitmap_construct_agg(bit).alias("__bits"))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    marked = F.expr("shiftright(__byte, CAST(__bit % 8 AS INT)) % 2 = 1")
    return (rows.select("*", bucket, bit.alias("__bit")).join(F.broadcast(bits), "__bucket")
            .withColumn("__byte", byte).filter(marked).select(*rows.columns))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, component (the smallest id reachable by near pairs, the document itself included)
    and kept (whether it is that one), a row for each row of ``docs``."""
    node = F.coalesce(F.col(id_col).cast("long"), F.shiftrightunsigned(row_key(id_col, text_col), 2) + F.lit(1 << 62))
    rows = docs.select(F.col(id_col).alias("id"), node.alias("node"), F.col(text_col).alias("text"))
    filled = rows.select("node", "text").filter("text IS NOT NULL")
    distinct = written(filled.mapInArrow(tidied(lambda b: _classes(b, True)), "node long, class long, text string").groupBy("class")
                       .agg(F.min("node").alias("rep"), F.max("node").alias("last"), F.count("*").alias("copies"), F.first("text").alias("text")), "distinct")
    rest, weights = frequencies(distinct, "text", F.col("copies"))
    shipped = docs.sparkSession.sparkContext.broadcast(weights)

    def signatures(batch: pa.RecordBatch) -> pa.Table:
        return pa.Table.from_batches(list(_signatures(iter([batch]), shipped)), SIGNATURE)

    signed = written(per_chunk(distinct.select(F.col("rep").alias("node"), "text"), rest, weights.chunks, signatures,
                               "node long, class long, bands array<long>, sketch array<long>"), "signed")
    classes = signed.withColumnRenamed("node", "rep")
    copies = (filled.mapInArrow(tidied(lambda b: _classes(b, False)), "node long, class long")
              .join(distinct.filter("rep < last").select("class", "rep"), "class")
              .select(F.col("node").alias("a"), F.col("rep").alias("b")))

    def texts_of(asked: DataFrame) -> DataFrame:
        found = among(distinct.select(F.col("rep").alias("node"), "text"), asked).join(asked, "node").dropDuplicates(["node"])
        return with_frequencies(found, rest, shipped)

    members = classes.select("rep", F.posexplode("bands").alias("at", "band"))
    ends = (members.groupBy("band").agg(F.min("rep").alias("small"), F.max("rep").alias("large"), F.count("*").alias("size"))
            .filter("small < large").select("band", "small", F.ceil(F.col("size") / PART).alias("parts")))
    shared = written(members.join(written(ends, "ends").hint("shuffle_hash"), "band"), "shared")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-pairs")
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        texts = written(texts_of(asked), f"{name}-texts")
        a, b = (texts.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("text", "own", "own_counts"))) for x in "ab")
        both = pairs.join(a, "a").join(b, "b").select("a", "b", *(f"{c}_{x}" for x in "ab" for c in ("text", "own", "own_counts")))
        return written(both.mapInArrow(tidied(lambda x: _verify(x, shipped, threshold)), "a long, b long"), f"{name}-links")

    def unsettled(rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """``rows`` of buckets that are not one component yet, with theirs and the smallest of the bucket."""
        named = rows.join(connected(links).withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        named = written(named, f"{name}-named")
        apart = named.groupBy("band").agg(F.min("component").alias("main"), F.max("component").alias("other")).filter("main < other")
        return written(named.join(apart.select("band", "main"), "band"), f"{name}-unsettled")

    def settled(rows: DataFrame, name: str) -> DataFrame:
        cells = rows.select("lo", "hi", "band", "block", "at", "rep", "component", "bands", "sketch", "text", "own", "own_counts")
        return written(cells.repartition("lo", "hi", "band").sortWithinPartitions("lo", "hi", "band")
                       .mapInArrow(tidied(lambda x: _settled(x, shipped, threshold)), "a long, b long"), f"{name}-links")

    links = verified(shared.select(F.col("rep").alias("a"), F.col("small").alias("b")), "first")
    state = unsettled(shared, links, "first")
    if not state.isEmpty():
        asked = state.select(F.col("rep").alias("node")).distinct()
        texts = texts_of(asked).withColumnRenamed("node", "rep")
        open_classes = written(classes.select("rep", "bands", "sketch").dropDuplicates(["rep"]).join(texts, "rep"), "open")
        part = F.pmod(F.xxhash64("rep", "band"), F.col("parts")).cast("int")
        links = links.union(settled(state.withColumns({"lo": part, "hi": part, "block": F.lit(0)}).join(open_classes, "rep"), "second"))
        state = unsettled(state.drop("component", "main"), links, "second")
        sizes = state.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        placed = (state.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
                  .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                  .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}))
        links = links.union(settled(placed.join(open_classes, "rep"), "third"))

    whole = connected(links.union(copies))
    return (rows.select("id", "node").join(whole, "node", "left")
            .select(F.col("id").alias(id_col), F.coalesce("component", "node").alias("component"),
                    F.coalesce(F.col("component") == F.col("node"), F.lit(True)).alias("kept")))
