"""Byte-level BPE with word ends: encoding of texts to ids, and decoding of ids to vocabulary strings.

The vocabulary file (its path is a parameter) is read on the driver and broadcast; its size is that
of the file, whatever the corpus. A word is merged by a priority queue of merge ranks over a doubly
linked list of symbols: the lowest rank is joined first (the leftmost on a tie), entries whose
symbols have changed since are skipped. Words repeat, and so do the runs between white space that hold
them, so each task keeps the ids of recent runs and words of up to CACHE_CHARS characters in two
generations of bounded size; one that fell out is merged again, with the same result.

Defined cases: a null text counts as empty, an empty text has no ids and decodes to the empty
string; rows that repeat, null ids and other columns pass through
unchanged, but for one that bears the result's name, which it replaces; special tokens written
out in a text are recognised, as the vocabulary's own library does by default; null ids decode to the
empty string, and an id outside the vocabulary adds nothing to the decoded text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from marketlens.llm.workers import tidied

#: Runs and words kept per generation of a worker's cache; two generations are alive at a time.
CACHE_WORDS = 1 << 18
#: A longer run of characters is not kept.
CACHE_CHARS = 64
ID_BITS, PLACE_BITS = 24, 32
ID_MASK, PLACE_MASK = (1 << ID_BITS) - 1, (1 << PLACE_BITS) - 1


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if it prints as Latin-1, else 256, 257, ... in order."""
    spare = iter(range(256, 512))
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


#: Code points that the regex module has as letters or numbers but the Unicode version
#: of the vocabulary's library does not, and capitals it knows that Python's tables lack.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F))
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
            **{0x10D50 + i: 0x10D70 + i for i in range(22)}, **{0x16EA0 + i: 0x16EBB + i for i in range(25)}}
_RARE = re.compile("[^\x00-\u0557]")
_CONTROL = re.compile("[\x1c-\x1f]")


def _without_newer(pattern: str) -> str:
    newer = "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NEWER) + "]"
    for kind in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(kind, f"[{kind}--{newer}]")
    return pattern


class WordBpe:
    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        model = data["model"]
        steps = data["pre_tokenizer"]["pretokenizers"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pattern = steps[0]["pattern"]["Regex"]
        self.words, self.rare_words = regex.compile(pattern), regex.compile(_without_newer(pattern), regex.V1)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        named = {i: s for s, i in (self.vocab | self.special).items()}
        self.strings = pa.array([named.get(i) for i in range(max(named) + 1)], pa.string())
        ids = self.vocab
        # a pair and its merge are one integer each: left and right id, rank and new id
        self.merges = {ids[a] << ID_BITS | ids[b]: rank << ID_BITS | ids[a + b] for rank, (a, b) in enumerate(model["merges"])}
        self.inner = [ids.get(s, -1) for s in byte_symbols()]
        self.last = [ids.get(s + self.end, -1) for s in byte_symbols()]
        self.complete = min(self.inner + self.last) >= 0
        self.pairs = [self.merges.get(a << ID_BITS | b, 0) if a >= 0 and b >= 0 else 0 for a in self.inner for b in self.inner]
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, word: str) -> bytes:
        raw, merges = word.encode(), self.merges
        ids = [*map(self.inner.__getitem__, raw)]
        ids[-1] = self.last[raw[-1]]
        if not self.complete:
            ids = [x for x in ids if x >= 0]
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        # a queued merge is one integer too: rank, new id and place of the left symbol, in this order
        if n == len(raw):
            # pairs of single bytes have a table of their own
            pairs = self.pairs
            queue = [found << PLACE_BITS | i for i in range(n - 2) if (found := pairs[raw[i] << 8 | raw[i + 1]])]
            if n > 1 and (found := merges.get(ids[n - 2] << ID_BITS | ids[n - 1])):
                queue.append(found << PLACE_BITS | n - 2)
        else:
            queue = [found << PLACE_BITS | i for i in range(n - 1) if (found := merges.get(ids[i] << ID_BITS | ids[i + 1]))]
        heapify(queue)
        while queue:
            top = heappop(queue)
            i, merge = top & PLACE_MASK, top >> PLACE_BITS
            left, j = ids[i], after[i]
            if left < 0 or j < 0 or merges.get(left << ID_BITS | ids[j]) != merge:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = new, _ = merge & ID_MASK, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get(new << ID_BITS | ids[k]):
                    heappush(queue, found << PLACE_BITS | i)
            if (h := before[i]) >= 0 and (found := merges.get(ids[h] << ID_BITS | new)):
                heappush(queue, found << PLACE_BITS | h)
        return array("i", [x for x in ids if x >= 0]).tobytes()

    def keep(self, key: str, ids: bytes) -> bytes:
        if len(key) <= CACHE_CHARS:
            if len(self.recent) >= CACHE_WORDS:
                self.older, self.recent = self.recent, {}
            self.recent[key] = ids
        return ids

    def forget(self) -> None:
        """Both generations go, so that idle workers hold none."""
        self.recent, self.older = {}, {}

    def word(self, word: str) -> bytes:
        ids = self.recent.get(word) or self.older.get(word)
        return self.keep(word, self.merge(word) if ids is None else ids)

    def piece(self, piece: str) -> bytes:
        """Ids of a run without white space, which holds one word or several."""
        if (ids := self.older.get(piece)) is None:
            split, text = self.words, piece
            if _RARE.search(piece):
                split, text = self.rare_words, piece.translate(CAPITALS)
            ids = b"".join(map(self.word, split.findall(text)))
        return self.keep(piece, ids)

    def plain(self, text: str) -> bytes:
        if not text.isascii():
            # lower() spells a final capital sigma by its neighbours; the vocabulary lower-cases each letter alone
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # words hold no white space, so a cut there parts none; split() also cuts at four control characters that words may hold
        pieces = [text] if _CONTROL.search(text) else text.split()
        get, piece = self.recent.get, self.piece
        return b"".join([get(p) or piece(p) for p in pieces])

    def coded(self, text: str) -> bytes:
        """Ids as the bytes of 32-bit integers."""
        if not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.split_special.split(text)
        return b"".join([np.int32(self.special[part]).tobytes() if part in self.special else self.plain(part) for part in parts])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.coded(text), np.int32).tolist()

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Vocabulary strings joined by a space (the file names no decoder that would do more); ids outside
        the vocabulary have none and are left out, as the vocabulary's library does."""
        flat = ids.flatten()
        bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
        known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self.strings)))
        strings = self.strings.take(pc.if_else(known, flat, None))
        if strings.null_count:
            kept = np.concatenate([[0], np.cumsum(strings.is_valid().to_numpy(zero_copy_only=False))])
            bounds, strings = kept[bounds], strings.drop_null()
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), strings), " ")


@lru_cache(maxsize=2)
def load(spec: str) -> WordBpe:
    return WordBpe(spec)


def _spec(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with array<int> column ``out``: the ids of the whole ``text_col``."""
    docs = docs.drop(out)
    spec, at = _spec(docs, path), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(spec.value)
        try:
            for batch in batches:
                for first in range(0, batch.num_rows, 500):
                    part = batch.slice(first, 500)
                    rows = [model.coded(t) if t else b"" for t in part.column(at).to_pylist()]
                    bounds = np.cumsum([0, *map(len, rows)], dtype=np.int64) // 4
                    flat = np.frombuffer(b"".join(rows), np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))], names=[*part.schema.names, out])
        finally:
            model.forget()

    return docs.mapInArrow(tidied(run), _ddl(docs) + f", `{out}` array<int>")


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with string column ``out``: the vocabulary strings of ``ids_col``."""
    df = df.drop(out)
    spec, at = _spec(df, path), df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(spec.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = model.decode(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, out])

    return df.mapInArrow(tidied(run), _ddl(df) + f", `{out}` string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
