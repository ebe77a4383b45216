"""Removal of passages that occur more than once anywhere in the corpus (difference-cover anchors).

A perfect difference set modulo PERIOD has, for any two positions, a common shift below PERIOD that
takes both into the set. So two equal windows of ``window`` words always share an equal anchor of
``window - PERIOD + 1`` words that starts, in both, at a cover position. The steps:

1. hash anchors at cover positions only; an anchor hash that occurs once cannot lie in a repeat;
2. extend: in documents that hold repeated anchors, hash every whole window that contains one at
   an offset the cover allows (96 bits), and count those;
3. remove the words that a repeated window covers.

Every step counts by key with map-side combining and joins back, so a passage that fills a third of
the corpus meets as one count per task, the join's skewed partitions are split, and no pair of
occurrences is ever formed.

Defined cases: null, empty and short texts (fewer words than the window) keep all their words; a
null id is a row like any other; a row that occurs twice, id and text alike, repeats itself, so its
windows go from both; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.store import row_key, written
from marketlens.llm.words import chunked, mix, prefix, span, word_hashes

#: A perfect difference set; its 20 differences are 1..20 modulo 21.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _words_before(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, position in it) of every word of a chunk."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return doc, np.arange(bounds[-1]) - bounds[doc]


def _anchors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for first, raws in chunked(batch.column(1)):
            hashes, bounds = word_hashes(raws)
            doc, pos = _words_before(bounds)
            at = np.flatnonzero(_IN_COVER[pos % PERIOD] & (pos + width <= np.diff(bounds)[doc]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(span(prefix(hashes), at, at + width).view(np.int64)), pa.array(keys[first + doc[at]]),
                 pa.array(pos[at].astype(np.int32))], names=["h", "k", "pos"])


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """All windows around repeated anchors: starts s with a repeated anchor at s .. s + PERIOD - 1."""
    for batch in batches:
        keys, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
        for first, raws in chunked(batch.column(1)):
            hashes, bounds = word_hashes(raws)
            near = np.zeros(bounds[-1] + 1, np.int32)
            for i in range(len(raws)):
                at = marks[first + i].values.to_numpy()
                np.add.at(near, bounds[i] + np.maximum(at - PERIOD + 1, 0), 1)
                np.add.at(near, bounds[i] + at + 1, -1)
            doc, pos = _words_before(bounds)
            at = np.flatnonzero((np.cumsum(near)[:-1] > 0) & (pos + window <= np.diff(bounds)[doc]))
            h1 = span(prefix(hashes), at, at + window)
            h2 = (span(prefix(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))), at, at + window) >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int32)), pa.array(keys[first + doc[at]]),
                 pa.array(pos[at].astype(np.int32))], names=["h1", "h2", "k", "pos"])


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, starts = (batch.column(i) for i in range(3))
        total, gone, kept, spans = [], [], [], []
        for text, at in zip(texts.to_pylist(), starts, strict=True):
            words = (text or "").encode().split()
            total.append(len(words))
            if not at.is_valid:
                gone.append(0)
                kept.append(b" ".join(words).decode())
                spans.append([])
                continue
            edge = np.zeros(len(words) + 1, np.int32)
            begin = at.values.to_numpy()
            edge[begin] += 1
            np.add.at(edge, begin + window, -1)
            covered = np.cumsum(edge)[:-1] > 0
            gone.append(int(covered.sum()))
            kept.append(b" ".join(compress(words, ~covered)).decode())
            flip = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(flip[::2], flip[1::2], strict=True)])
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            names=["id", "n_words", "n_removed", "kept_text", "spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, n_removed, kept_text (the kept words joined
    by a space) and spans (the removed [start, end) word ranges). ``window`` is at least PERIOD."""
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD} words")
    width = window - PERIOD + 1
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("k"))
    keyed = rows.select("k", "text")
    anchors = keyed.mapInArrow(lambda b: _anchors(b, width), "h long, k long, pos int")

    again = written(anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "anchors")
    marked = anchors.join(again.hint("shuffle_hash"), "h", "left_semi")
    marks = written(marked.groupBy("k").agg(F.collect_set("pos").alias("marks")), "marks")
    windows = written(
        keyed.join(marks, "k").select("k", "text", "marks")
        .mapInArrow(lambda b: _windows(b, window), "h1 long, h2 int, k long, pos int"), "windows")
    twice = written(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"), "twice")
    starts = written(
        windows.join(twice.hint("shuffle_hash"), ["h1", "h2"], "left_semi")
        .groupBy("k").agg(F.collect_set("pos").alias("starts")), "starts")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_removed long, kept_text string, " \
             "spans array<struct<start:int,end:int>>"
    return (rows.join(starts, "k", "left").select("id", "text", "starts")
            .mapInArrow(lambda b: _cut(b, window), schema).withColumnRenamed("id", id_col))
