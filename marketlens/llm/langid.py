"""Language identification by cross-parsing.

For each language a suffix automaton of a bounded sample of labelled text is built. A text is parsed
greedily against it: each phrase is the longest match from the current place, a symbol that follows
no match begins the next phrase. The fewer phrases per symbol, times the bits that point into the
sample (log2 of its length), the better the language explains the text; the fewest bits win.

Automata are dense transition tables, so a whole batch of text is parsed by one table lookup per
symbol place for all its segments at once. Texts are parsed whole, in segments of SEGMENT symbols
(each opens a new phrase, alike for all languages).

Bounds: TRAIN_DOCS documents and TRAIN_CHARS symbols a language are the sample; a model is at most
2 * TRAIN_CHARS states of ALPHABET entries a language, whatever the corpus.

Defined cases: null texts and texts with no letter give ``und`` with score 0; equal bits give the
first language in code point order with score 0; a single learned language has score 1; an empty
training table makes every text ``und``; rows that repeat are scored alike; other columns pass,
except that lang_pred and score replace columns of those names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.store import written
from marketlens.llm.workers import tidied

UNDETERMINED = "und"
TRAIN_DOCS, TRAIN_CHARS = 400, 16_000
ALPHABET, SEGMENT = 64, 256
#: Symbol codes: 0 is any run of characters that are not letters, 1 a letter outside the alphabet, 63 padding.
GAP, OTHER, PAD = 0, 1, ALPHABET - 1
_POINTS = 1 << 16


def letters_of(texts: list[str]) -> np.ndarray:
    """Table from code point to symbol code: the commonest letters of the sample get codes of their own."""
    counts = Counter("".join(texts))
    common = sorted((c for c in counts if c.isalpha() and ord(c) < _POINTS), key=lambda c: (-counts[c], c))[: ALPHABET - 3]
    table = np.array([OTHER if chr(i).isalpha() else GAP for i in range(_POINTS)], np.uint8)
    for code, c in enumerate(sorted(common), start=2):
        table[ord(c)] = code
    return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Codes of the lower-cased text, runs of gaps made one; letters beyond the table are OTHER."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    codes = table[np.minimum(points, _POINTS - 1)]
    far = points >= _POINTS
    if far.any():
        codes[far] = [OTHER if chr(p).isalpha() else GAP for p in points[far]]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != GAP) | (codes[:-1] != GAP)
    return codes[keep]


def suffix_automaton(codes: list[int]) -> np.ndarray:
    """Transition table of the suffix automaton, made ready for parsing: entry = 2 * (row offset of the
    next state) + 1 if the symbol opened a new phrase."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    root = np.zeros(ALPHABET, np.int64)
    for c, to in step[0].items():
        root[c] = to
    table = np.empty((len(step), ALPHABET), np.int32)
    table[:] = root * ALPHABET * 2 + 1
    for state, found in enumerate(step):
        for c, to in found.items():
            table[state, c] = to * ALPHABET * 2
    table[0] |= 1
    table[:, PAD] = np.arange(len(step)) * ALPHABET * 2
    return table.reshape(-1)


def phrase_counts(texts: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Phrases of each symbol run, all segments of all texts advancing together."""
    sizes = np.array([len(t) for t in texts])
    parts = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), parts)
    lanes = np.full(parts.sum() * SEGMENT, PAD, np.uint8)
    first = np.concatenate([[0], np.cumsum(parts)]) * SEGMENT
    for i, t in enumerate(texts):
        lanes[first[i] : first[i] + len(t)] = t
    steps = np.ascontiguousarray(lanes.reshape(-1, SEGMENT).T).astype(np.int32)
    state = np.zeros(steps.shape[1], np.int32)
    count = np.zeros(steps.shape[1], np.int64)
    for row in steps:
        entry = table[state + row]
        count += entry & 1
        state = entry >> 1
    return np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """At most TRAIN_DOCS labelled documents a language, those with the smallest id hashes. The counts
    by language (one row each) give a cut below which about 1.2 TRAIN_DOCS lie; only those are ranked."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL")
    share = F.least(F.lit(1.0), (1.2 * TRAIN_DOCS + 50) / F.count("*"))
    cuts = F.broadcast(rows.groupBy("lang").agg(F.least(F.lit(2.0**63 - 1024), F.lit(-(2.0**63)) + share * 2.0**64).cast("long").alias("cut")))
    few = rows.withColumn("o", F.xxhash64("id")).join(cuts, "lang").filter("o <= cut AND text IS NOT NULL")
    rank = Window.partitionBy("lang").orderBy("o", "id", "text")
    return few.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= TRAIN_DOCS)


def level(lengths: list[int], total: int) -> int:
    """The least length to cut at so that the pieces hold ``total`` in all (the longest, if there is less)."""
    left = total
    for i, n in enumerate(sorted(lengths)):
        share = -(-left // (len(lengths) - i))
        if n >= share:
            return share
        left -= n
    return max(lengths, default=0)


def _portion(texts: list[str], table: np.ndarray) -> list[int]:
    """TRAIN_CHARS symbols from the middles of the texts, of each as much as short texts leave to it."""
    runs = [symbols(t, table) for t in texts]
    share = level([len(r) + 1 for r in runs], TRAIN_CHARS)
    out: list[int] = []
    for run in runs:
        begin = max(0, (len(run) + 1 - share) // 2)
        out += [GAP, *run[begin : begin + share - 1].tolist()]
    return out[:TRAIN_CHARS]


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Model: the symbol table and, by language, its automaton and sample length."""
    picked = sample(labelled, id_col, text_col, lang_col)
    spark = labelled.sparkSession
    picked = written(picked.select("lang", "rank", "text"), "picked")
    lengths: dict[str, list[int]] = {}
    for r in picked.select("lang", F.length("text").alias("n")).collect():
        lengths.setdefault(r["lang"], []).append(r["n"])
    # runs of gaps are one symbol, so more characters than symbols are taken
    cuts = spark.createDataFrame([(lang, level(n, 4 * TRAIN_CHARS)) for lang, n in lengths.items()], "lang string, most int")
    piece = F.expr("substr(text, 1 + greatest(0, length(text) - most) div 2, most)")
    heads = picked.join(F.broadcast(cuts), "lang").groupBy("lang").agg(F.collect_list(F.struct("rank", piece.alias("text"))).alias("texts"))
    rows = {r["lang"]: [t["text"].lower() for t in sorted(r["texts"], key=lambda t: t["rank"])] for r in heads.collect()}
    table = letters_of([t for texts in rows.values() for t in texts])
    if not rows:
        return {"table": table, "langs": [], "automata": [], "sizes": []}
    portions = spark.createDataFrame([(lang, _portion(rows[lang], table)) for lang in sorted(rows)], "lang string, codes array<int>")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": pdf["lang"], "size": [len(pdf["codes"][0])],
                             "automaton": [suffix_automaton([int(c) for c in pdf["codes"][0]]).tobytes()]})

    built = portions.groupBy("lang").applyInPandas(build, "lang string, size int, automaton binary").collect()
    built.sort(key=lambda r: r["lang"])
    return {"table": table, "langs": [r["lang"] for r in built], "sizes": [r["size"] for r in built],
            "automata": [np.frombuffer(bytes(r["automaton"]), np.int32) for r in built]}


def predict_texts(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    runs = [symbols(t, model["table"]) if t else np.zeros(0, np.uint8) for t in texts]
    live = [i for i, r in enumerate(runs) if (r != GAP).any()]
    if not live or not model["langs"]:
        return langs, scores
    lengths = np.array([len(runs[i]) for i in live])
    bits = np.stack([phrase_counts([runs[i] for i in live], a) * math.log2(max(2, n)) / lengths
                     for a, n in zip(model["automata"], model["sizes"], strict=True)])
    best = bits.argmin(axis=0)
    least = np.sort(bits, axis=0)
    for k, i in enumerate(live):
        langs[i] = model["langs"][best[k]]
        scores[i] = float(1 - least[0, k] / least[1, k]) if len(least) > 1 else 1.0
    return langs, scores


def identify(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (1 - bits of the best language / bits of the second)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            texts = batch.column(at).to_pylist()
            while first < len(texts):
                end, size = first, 0
                while end < len(texts) and (end == first or size < 1 << 20):
                    size += len(texts[end] or "")
                    end += 1
                langs, scores = predict_texts(texts[first:end], shipped.value)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=[*part.schema.names, "lang_pred", "score"])
                first = end

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(tidied(run), f"{ddl}, lang_pred string, score double")


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus
