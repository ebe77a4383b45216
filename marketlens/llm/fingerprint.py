"""Document fingerprints from prefix polynomial hashes.

Modular prefix arrays (two 31-bit primes, so 62 bits) give the hash of any span of code points by one
subtraction and one product. They serve two ends: a fingerprint, made of the hash of the whole text
and a sketch of the hashes of all spans of SPAN code points, and the longest common extension of two
texts from given places, by binary search on span equality.

The sketch has SLOTS slots; each holds the low 16 bits of the smallest span hash that falls in it. The
likeness of two fingerprints is the share of equal slots among those filled in either, an estimate
of the Jaccard similarity of the two texts' spans.

Defined cases: a null text counts as empty; an empty text has no filled slot, and two such
fingerprints are alike by 1, one such and another by 0; a text shorter than SPAN has one span, itself;
rows in equal places of the order (a repeated or null id, nulls last) are ordered by their text's
hash; a single row is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.store import written
from marketlens.llm.words import mix

SPAN, SLOTS, EMPTY = 8, 64, 0xFFFF
CHUNK_CHARS = 1 << 18
PRIMES, BASES = (2147483647, 2147483629), (1000003, 998244353)


class Powers:
    """Powers of a base and of its inverse modulo a prime, doubled as longer texts arrive."""

    def __init__(self, prime: int, base: int) -> None:
        self.p = np.uint64(prime)
        self.bases = [base % prime, pow(base, -1, prime)]
        self.have = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def up_to(self, n: int) -> list[np.ndarray]:
        for i, base in enumerate(self.bases):
            while len(self.have[i]) < n:
                step = np.uint64(pow(base, len(self.have[i]), int(self.p)))
                self.have[i] = np.concatenate([self.have[i], self.have[i] * step % self.p])
        return [h[:n] for h in self.have]


_POWERS = [Powers(p, b) for p, b in zip(PRIMES, BASES, strict=True)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


class Prefix:
    """Prefix arrays of a run of code points; ``spans`` answers the hash of any [start, end)."""

    def __init__(self, points: np.ndarray) -> None:
        self.n = len(points)
        self.sums = []
        for powers in _POWERS:
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum((points + np.uint64(1)) * powers.up_to(self.n + 1)[1][: self.n] % powers.p, out=sums[1:])
            self.sums.append(sums % powers.p)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        halves = [(s[end] + w.p - s[start]) % w.p * w.up_to(self.n + 1)[0][start] % w.p
                  for s, w in zip(self.sums, _POWERS, strict=True)]
        return halves[0] << np.uint64(31) | halves[1]


def common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """Length of the longest run that a from i and b from j share, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        same = a.spans(np.array([i]), np.array([i + mid]))[0] == b.spans(np.array([j]), np.array([j + mid]))[0]
        low, high = (mid, high) if same else (low, mid - 1)
    return low


def fingerprints(texts: list[str]) -> list[str]:
    """Hex fingerprints: 16 digits of the whole text's hash and length, then 4 for each slot."""
    out, held, size = [], [], 0
    for text in [*texts, None]:
        if held and (text is None or size + len(text) > CHUNK_CHARS):
            out += _fingerprint_run(held)
            held, size = [], 0
        if text is not None:
            held.append(text)
            size += len(text)
    return out


def _fingerprint_run(texts: list[str]) -> list[str]:
    points = [code_points(t) for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    prefix = Prefix(np.concatenate(points))
    whole = mix(prefix.spans(starts, ends) ^ mix(sizes.astype(np.uint64)))
    width = np.minimum(sizes, SPAN)
    count = np.where(sizes > 0, sizes - width + 1, 0)
    doc = np.repeat(np.arange(len(texts)), count)
    at = starts[doc] + np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    hashes = mix(prefix.spans(at, at + width[doc]))
    slot = doc * SLOTS + (hashes >> np.uint64(58)).astype(np.int64)
    least = np.full(len(texts) * SLOTS, np.iinfo(np.int64).max, np.int64)
    np.minimum.at(least, slot, (hashes & np.uint64((1 << 58) - 1)).astype(np.int64))
    low = np.where(least == np.iinfo(np.int64).max, EMPTY, np.minimum(least & 0xFFFF, EMPTY - 1)).astype(">u2").reshape(-1, SLOTS)
    return [f"{int(w):016x}{row.tobytes().hex()}" for w, row in zip(whole, low, strict=True)]


def likeness(a: str, b: str) -> float:
    """Share of equal slots among those that either fingerprint fills; 1 for two empty texts."""
    x, y = (np.frombuffer(bytes.fromhex(f[16:]), ">u2") for f in (a, b))
    filled = (x != EMPTY) | (y != EMPTY)
    return float(((x == y) & filled).sum() / filled.sum()) if filled.any() else 1.0


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as many first code points of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


RESULT = "n_chars long, edited_text string, edited_sha256 string, fingerprint string, edited_fingerprint string, " \
         "near_edited double, near_next double, common_prefix long"


def _results(texts: list[str], following: list[str]) -> list[pa.Array]:
    """``following[i]`` is the next document of ``texts[i]``."""
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    known = dict(zip(dict.fromkeys([*texts, *following]), fingerprints([*dict.fromkeys([*texts, *following])]), strict=True))
    own, new = [known[t] for t in texts], fingerprints(changed)
    lce = [common_extension(Prefix(code_points(a)), 0, Prefix(code_points(b)), 0) for a, b in zip(texts, changed, strict=True)]
    return [pa.array([len(t) for t in texts], pa.int64()),
            pa.array(changed, pa.string()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array(own, pa.string()), pa.array(new, pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, new, strict=True)], pa.float64()),
            pa.array([likeness(a, known[b]) for a, b in zip(own, following, strict=True)], pa.float64()),
            pa.array(lce, pa.int64())]


NAMES = [c.strip().split(" ")[0] for c in RESULT.split(",")]


def _sorted_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one ordered partition; the first is also passed on as it is (kind head), and the
    last waits for the next partition's head (kind tail)."""
    kinds = pa.struct([("part", pa.int32()), ("text", pa.string())])
    last = None

    def emit(ids, texts, following, id_type):
        rows = _results(texts, following)
        rows[1] = pa.nulls(len(texts), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, id_type), pa.nulls(len(texts), kinds), pa.nulls(len(texts), kinds), *rows],
            names=["id", "head", "tail", *NAMES])

    def edge(row_id, head, tail, id_type):
        blank = [pa.nulls(1, t) for t in (pa.int64(), *[pa.string()] * 4, pa.float64(), pa.float64(), pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row_id], id_type), pa.array([head], kinds), pa.array([tail], kinds), *blank], names=["id", "head", "tail", *NAMES])

    id_type, part = None, 0
    for batch in batches:
        id_type = batch.column(0).type
        for first in range(0, batch.num_rows, 100):
            piece = batch.slice(first, 100)
            ids = piece.column(0).to_pylist()
            texts = [t or "" for t in piece.column(1).to_pylist()]
            part = piece.column(2)[0].as_py()
            if last is None:
                yield from edge(ids[0], {"part": part, "text": texts[0]}, None, id_type)
            else:
                ids, texts = [last[0], *ids], [last[1], *texts]
            if len(ids) > 1:
                yield from emit(ids[:-1], texts[:-1], texts[1:], id_type)
            last = ids[-1], texts[-1]
    if last is not None:
        yield from edge(last[0], None, {"part": part, "text": last[1]}, id_type)


def _pairs_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = _results(batch.column(1).to_pylist(), batch.column(2).to_pylist())
        rows[1] = pa.nulls(batch.num_rows, pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *rows], names=["id", *NAMES])


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its fingerprint, that of its edited text, and the likenesses.

    Documents are range-partitioned and sorted by descending id once; the next document is then the
    next row. Only the last row of each partition looks beyond it, to the head of the next one: the
    heads (one row a partition) are matched by a window over partition numbers alone.
    """
    order = [F.col("id").desc_nulls_last(), F.col("h")]
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
            .repartitionByRange(*order).sortWithinPartitions(*order)
            .select("id", "text", F.spark_partition_id().alias("part")))
    kind = rows.schema["id"].dataType.simpleString()
    out = written(rows.mapInArrow(
        _sorted_run, f"id {kind}, head struct<part:int,text:string>, tail struct<part:int,text:string>, {RESULT}"), "fingerprints")
    done = out.filter("head IS NULL AND tail IS NULL").select("id", *NAMES)
    heads = out.filter("head IS NOT NULL").select("head.part", F.col("head.text").alias("following"))
    turn = Window.orderBy("part")
    follows = heads.select("part").select("part", F.lead("part").over(turn).alias("next"), F.first("part").over(turn).alias("start"))
    tails = (out.filter("tail IS NOT NULL").select("id", "tail.part", "tail.text")
             .join(follows.select("part", F.coalesce("next", "start").alias("to")), "part")
             .join(heads.select(F.col("part").alias("to"), "following"), "to").select("id", "text", "following"))
    return done.unionByName(tails.mapInArrow(_pairs_run, f"id {kind}, {RESULT}")).drop("edited_text").withColumnRenamed("id", id_col)
