"""Document quality by co-training of two views.

The text view sees the words and their endings, hashed; the page view sees what surrounds and shapes
the text: source, language, lengths, lines and shares of character kinds, but no word. Each view has a
logistic classifier. Over ROUNDS each scores a pool of unlabelled documents and hands its most
confident ones, as pseudo-labels, to the other view's training set. The views are then calibrated on
labelled documents that neither was trained on, combined there by one more logistic regression over
their two logits, and every document is scored.

Bounds: the classifiers are fitted on at most LABELLED labelled documents and a POOL of unlabelled
ones, those with the smallest seeded hashes, with their whole texts; FEATURES + 2 * META_SIZE weights go
to all tasks. Scores use whole texts of all documents.

Defined cases: a null text counts as empty and is scored by the page view's features; null source or
language are values of their own; null or conflicting labels are left out; with labels of only one
kind, or none, every document gets the share of good labels (0.5 without any); documents that repeat
are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.store import bounded_sample, written
from marketlens.llm.words import chunked, mix, word_hashes

FEATURES, SOURCES = 1 << 15, 64
KINDS = ("upper", "lower", "digit", "space", "other", "beyond")
META_SIZE = 2 * SOURCES + 6 + 2 * len(KINDS)
LABELLED, POOL, ROUNDS, GAIN, CALIBRATION = 2_500, 2_500, 5, 0.03, 4
STEPS, DECAY = 300, 1e-4

_KIND = np.full(256, KINDS.index("other"))
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 0, 1, 2
_KIND[[9, 10, 11, 12, 13, 32]], _KIND[128:] = 3, 5


def word_rows(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature of every word and of every word's ending, bounds): texts without words have one, 0."""
    raws = [r if r.split(None, 1) else b"\x00" for r in raws]
    hashes, bounds = word_hashes(raws)
    data = np.frombuffer(b"\n\n" + b"\n".join(raws) + b"\n", np.uint8)
    word = _KIND[data] != 3
    last = np.flatnonzero(word[:-1] & ~word[1:])
    ending = mix(data[last].astype(np.uint64) << np.uint64(16) | data[last - 1].astype(np.uint64) << np.uint64(8) | data[last - 2])
    half = np.uint64(FEATURES // 2)
    rows = np.empty((len(hashes), 2), np.int32)
    rows[:, 0], rows[:, 1] = hashes % half, ending % half + half
    return rows.reshape(-1), bounds * 2


def page_rows(raws: list[bytes], sources: list[str | None], langs: list[str | None]) -> np.ndarray:
    """Dense page features: hashed source and language, and the shape of the text."""
    out = np.zeros((len(raws), META_SIZE))
    for i, (raw, names) in enumerate(zip(raws, zip(sources, langs, strict=True), strict=True)):
        for j, name in enumerate(names):
            value = int.from_bytes((name or "\x00null").encode()[:64], "little")
            out[i, j * SOURCES + int(mix(np.array([value & 0xFFFFFFFFFFFFFFFF], np.uint64))[0] % np.uint64(SOURCES))] = 1
        kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=len(KINDS)) / max(1, len(raw))
        lines, words = raw.count(b"\n") + 1, max(1, len(raw.split()))
        shape = [1.0, np.log1p(len(raw)), np.log1p(len(raw) / lines), np.log1p(lines), len(raw) / words / 10, np.log1p(words)]
        out[i, 2 * SOURCES :] = [*shape, *kinds, *np.sqrt(kinds)]
    return out


def mean_weights(weights: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[rows], bounds[:-1]) / np.diff(bounds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _descend(gradient, size: int) -> np.ndarray:
    """Adagrad on the mean logistic loss; ``gradient(w)`` is its gradient."""
    w, seen = np.zeros(size), np.full(size, 1e-8)
    for _ in range(STEPS):
        g = gradient(w) + DECAY * w
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    return w


def fit_text(rows: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    owner, share = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(bounds)), 1 / np.diff(bounds)

    def gradient(w: np.ndarray) -> np.ndarray:
        error = (_sigmoid(np.add.reduceat(w[rows], bounds[:-1]) * share) - y) * weight
        return np.bincount(rows, (error * share)[owner], FEATURES)

    return _descend(gradient, FEATURES)


def fit_dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return _descend(lambda w: ((_sigmoid(x @ w) - y) * weight) @ x, x.shape[1])


def _balanced(y: np.ndarray) -> np.ndarray:
    return np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))


class TwoViews:
    """Both views' classifiers, their standardisation, and the weights that combine their logits."""

    def __init__(self, prior: float) -> None:
        self.prior, self.text, self.page = prior, None, None

    def logits(self, rows: np.ndarray, bounds: np.ndarray, page: np.ndarray) -> np.ndarray:
        return np.stack([mean_weights(self.text, rows, bounds), (page - self.center) / self.scale @ self.page], axis=1)

    def combined(self, logits: np.ndarray) -> np.ndarray:
        """Calibrated text score, page score, and the score of both."""
        one = np.ones((len(logits), 1))
        calibrated = [_sigmoid(np.hstack([logits[:, [i]], one]) @ self.platt[i]) for i in range(2)]
        return np.stack([*calibrated, _sigmoid(np.hstack([logits, one]) @ self.both)], axis=1)


def _part(rows: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pieces = [rows[bounds[i] : bounds[i + 1]] for i in at]
    return np.concatenate(pieces), np.cumsum([0, *map(len, pieces)])


def split(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places to fit on and to calibrate on: one of CALIBRATION of each kind of label calibrates, and the
    only one of a kind serves both."""
    fit, calibrate = [], []
    for value in (0, 1):
        at = np.flatnonzero(label == value)
        calibrate.append(at[::CALIBRATION])
        fit.append(np.delete(at, np.s_[::CALIBRATION]) if len(at) > 1 else at)
    return np.sort(np.concatenate(fit)), np.sort(np.concatenate(calibrate))


def co_train(pdf: pd.DataFrame) -> TwoViews:
    """``pdf``: rows (list of ints), page (list of floats), label (0, 1 or nan)."""
    label = pdf["label"].to_numpy(float)
    known = ~np.isnan(label)
    if len(set(label[known])) < 2:
        return TwoViews(float(label[known].mean()) if known.any() else 0.5)
    model = TwoViews(float(label[known].mean()))
    bounds = np.cumsum([0, *map(len, pdf["rows"])])
    rows, page = np.concatenate(pdf["rows"].tolist()), np.stack(pdf["page"].tolist())
    model.center, model.scale = page.mean(axis=0), page.std(axis=0) + 1e-3
    model.center[2 * SOURCES] = 0  # the constant stays one
    model.scale[2 * SOURCES] = 1
    scaled = (page - model.center) / model.scale
    start, held = split(label)
    labels = [dict(zip(start, label[start], strict=True)) for _ in range(2)]
    pool = np.flatnonzero(~known)
    for turn in range(ROUNDS + 1):
        at = [np.array(sorted(found)) for found in labels]
        y = [np.array([found[i] for i in a]) for found, a in zip(labels, at, strict=True)]
        model.text = fit_text(*_part(rows, bounds, at[0]), y[0], _balanced(y[0]))
        model.page = fit_dense(scaled[at[1]], y[1], _balanced(y[1]))
        if turn == ROUNDS or not len(pool):
            break
        logits = model.logits(*_part(rows, bounds, pool), page[pool])
        moved = set()
        for view in range(2):
            order = np.argsort(logits[:, view], kind="stable")
            bad, good = (max(1, int(GAIN * len(pool) * p)) for p in (1 - model.prior, model.prior))
            for chosen, value in ((order[:bad], 0.0), (order[len(order) - good :], 1.0)):
                sure = chosen[(logits[chosen, view] > 0) == bool(value)]
                labels[1 - view].update(dict.fromkeys(pool[sure], value))
                moved.update(pool[sure])
        pool = np.array([i for i in pool if i not in moved], int)
    logits, one = model.logits(*_part(rows, bounds, held), page[held]), np.ones((len(held), 1))
    even = np.full(len(held), 1 / len(held))
    model.platt = [fit_dense(np.hstack([logits[:, [i]], one]), label[held], even) for i in range(2)]
    model.both = fit_dense(np.hstack([logits, one]), label[held], even)
    return model


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, sources, langs = (batch.column(i).to_pylist() for i in range(3))
        for first, raws in chunked(texts):
            end = first + len(raws)
            rows, bounds = word_rows(raws)
            page = page_rows(raws, sources[first:end], langs[first:end])
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(rows)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(raws) + 1, dtype=np.int32) * META_SIZE), pa.array(page.reshape(-1))),
                 batch.column(3).slice(first, len(raws))], names=["rows", "page", "label"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> TwoViews:
    """Fit on documents with a label and a pool of those without one."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("l"))
    agreed = (known.groupBy("id").agg(F.min("l").alias("a"), F.max("l").alias("b")).filter("a = b")
              .select("id", F.col("a").cast("double").alias("label")))
    order = F.xxhash64("id", F.lit(9))
    rows = docs.select(F.col(id_col).alias("id"), "text", "source", "lang")
    agreed = written(agreed.join(rows.select("id"), "id", "left_semi"), "agreed")  # labels of other documents teach nothing
    labelled = rows.join(F.broadcast(bounded_sample(agreed, LABELLED, order)), "id")
    pool = bounded_sample(rows, POOL, order).join(known.select("id"), "id", "left_anti").withColumn("label", F.lit(None).cast("double"))
    picked = labelled.unionByName(pool).withColumn("o", order).orderBy("o", "text").limit(LABELLED + POOL)
    found = picked.select("text", "source", "lang", "label").mapInArrow(_extract, "rows array<int>, page array<double>, label double").toPandas()
    return co_train(found)


def score(docs: DataFrame, model: TwoViews, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, score, text_score and page_score (probabilities of good quality) of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(F.col(id_col).alias("id"), "text", "source", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            texts, sources, langs = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for first, raws in chunked(texts):
                end = first + len(raws)
                if model.text is None:
                    scores = np.full((len(raws), 3), model.prior)
                else:
                    scores = model.combined(model.logits(*word_rows(raws), page_rows(raws, sources[first:end], langs[first:end])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(raws)), *(pa.array(scores[:, i]) for i in (2, 0, 1))],
                    names=["id", "score", "text_score", "page_score"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, score double, text_score double, page_score double").withColumnRenamed("id", id_col)
