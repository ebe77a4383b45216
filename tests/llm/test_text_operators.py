import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marketlens.llm import bpe, fingerprint, langid, line_dedup, lm, quality, substring_dedup
from marketlens.llm.queries import QUERIES
from marketlens.llm.words import word_hashes
from tests.llm.conftest import prose, rows, words

PATH = "/opt/tokenizers/word_bpe_49k.json"


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


# ---- words

def test_word_hashes_agree_with_split():
    raws = [b"the cat\x0bthe dog", b"", b" dog  the cat "]
    hashes, bounds = word_hashes(raws)
    assert np.diff(bounds).tolist() == [len(r.split()) for r in raws]
    flat = [w for r in raws for w in r.split()]
    assert len(set(hashes.tolist())) == len(set(flat))
    assert all((hashes[i] == hashes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


# ---- 1 substring dedup

def brute_kept(texts, window):
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_difference_cover_has_every_difference():
    cover = substring_dedup.COVER
    found = {(a - b) % substring_dedup.PERIOD for a in cover for b in cover}
    assert found == set(range(substring_dedup.PERIOD))


@pytest.mark.parametrize("window", [21, 35])
def test_repeats_against_brute_force(awkward, window):
    got = collected(substring_dedup.remove_repeats(awkward, window=window), "doc_id", "n_words", "n_removed", "kept_text")
    want = [(r[0], *b) for r, b in zip(rows(), brute_kept([r[1] for r in rows()], window), strict=True)]
    assert got == sorted(want, key=repr)
    assert any(r[2] for r in got) and any(0 < r[2] < r[1] for r in got)


def test_overlapping_repeats_at_every_alignment(spark):
    passage = prose(3, 37)
    texts = [" ".join(prose(100 + i, i) + passage + prose(200 + i, 7)) for i in range(45)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    for i, (n, gone, kept) in enumerate(brute_kept(texts, 35)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (n, gone, kept) and gone == 37
        assert [(s.start, s.end) for s in got[i].spans] == [(i, i + 37)]


def test_repeats_in_nothing(nothing):
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_window_must_hold_a_period(awkward):
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(awkward, window=20)


# ---- 3 language identification

def longest_phrases(sample, text):
    count, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i:j + 1] in sample:
            j += 1
        if text[i:j] not in sample:
            j = i + 1
        count, i = count + 1, j
    return count


@given(st.lists(st.integers(2, 5), min_size=1, max_size=60), st.lists(st.integers(2, 6), min_size=1, max_size=80))
@settings(max_examples=60, deadline=None)
def test_phrases_against_substring_search(sample, text):
    table = langid.suffix_automaton(sample)
    got = langid.phrase_counts([np.array(text, np.uint8)], table)[0]
    assert got == longest_phrases("".join(map(str, sample)), "".join(map(str, text)))


def test_languages_of_held_out_documents(spark):
    from marketlens.llm.store import table
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_language_id"](spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4) == 2).all()
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_few_long_documents_fill_the_sample(spark):
    docs = spark.createDataFrame([(i, " ".join(prose(i, 4000)), "aa") for i in range(5)] + [(9, "kurz", "bb"), (10, "", "cc")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert dict(zip(model["langs"], model["sizes"], strict=True))["aa"] == langid.TRAIN_CHARS


@given(st.lists(st.integers(0, 50), min_size=1, max_size=20), st.integers(0, 300))
def test_level_of_cuts(lengths, total):
    at = langid.level(lengths, total)
    held = sum(min(n, at) for n in lengths)
    assert held >= min(total, sum(lengths)) and (at == 0 or held == sum(lengths) or sum(min(n, at - 1) for n in lengths) < total)


def test_language_of_awkward_rows(awkward, nothing):
    model = langid.train(awkward)
    got = langid.identify(awkward, model).select("doc_id", "text", "lang_pred", "score", "kept_text").collect()
    assert len(got) == len(rows())
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert 0 <= r.score <= 1 and (r.lang_pred != "und" or r.score == 0)
    untaught = langid.identify(awkward, langid.train(nothing))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}
    assert langid.identify(nothing, model).count() == 0


# ---- 5 fingerprints

def test_fingerprints_against_plain_edits(awkward):
    got = fingerprint.fingerprint_documents(awkward).collect()
    by_id = {r.doc_id: r for r in got}
    plain = {i: t or "" for i, t, *_ in rows() if i is not None}
    order = sorted(plain, reverse=True)
    assert len(got) == len(rows())
    for a, b in zip(order, order[1:], strict=False):
        if 9 in (a, b) or a == 1:
            continue
        text = plain[a]
        cut = len(text) // 3
        want = text[:len(text) - cut] + plain[b][:cut]
        r = by_id[a]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert r.common_prefix == next((i for i, (x, y) in enumerate(zip(text, want, strict=False)) if x != y), min(len(text), len(want)))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (text == want) <= (r.near_edited == 1)
    assert by_id[3].fingerprint == by_id[5].fingerprint != by_id[4].fingerprint
    assert by_id[3].near_next < 1 and by_id[4].near_next > 0.6  # 4 is followed by its near copy 3


def test_fingerprint_of_one_and_no_document(spark, nothing):
    one = fingerprint.fingerprint_documents(spark.createDataFrame([(1, "abcdefghi" * 9)], "doc_id long, text string")).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(("abcdefghi" * 6 + "abcdefghi" * 3).encode()).hexdigest()
    assert fingerprint.fingerprint_documents(nothing).count() == 0


@given(st.text(alphabet="ab\U0001F642é", max_size=40), st.text(alphabet="ab\U0001F642é", max_size=40), st.data())
@settings(max_examples=60, deadline=None)
def test_common_extension(a, b, data):
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    pre = [fingerprint.Prefix(fingerprint.code_points(t)) for t in (a, b)]
    assert fingerprint.common_extension(pre[0], i, pre[1], j) == n


def test_likeness_follows_shared_spans():
    base = " ".join(prose(21, 400))
    full, half, other = fingerprint.fingerprints([base, base[: len(base) // 2] + " ".join(prose(22, 200)), " ".join(prose(23, 400))])
    assert fingerprint.likeness(full, full) == 1 and fingerprint.likeness(full, other) < 0.1
    assert 0.15 < fingerprint.likeness(full, half) < 0.55


# ---- 6 line dedup

def brute_lines(docs):
    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < line_dedup.MIN_CHARS or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    order = sorted({(d[0] is None, d[0] or 0, d[1]) for d in docs if d[1] is not None})
    before, out = [], {}
    for none, i, text in order:
        kept = []
        for line in text.split("\n"):
            if not line.strip():
                kept.append(line)
                continue
            if not any(near(line, e) for e in before):
                kept.append(line)
            before.append(line)
        out[none, i, text] = "\n".join(kept)
    return out


def test_lines_against_brute_force(awkward):
    got = line_dedup.dedup_lines(awkward).select("doc_id", "text", "kept_text", "n_lines", "n_removed", "lang", "k").collect()
    want = brute_lines(rows())
    assert len(got) == len(rows())
    for r in got:
        if r.text is None:
            assert r.kept_text is None and r.n_lines == r.n_removed == 0
            continue
        kept = want[r.doc_id is None, r.doc_id or 0, r.text]
        assert r.kept_text == kept
        assert r.n_lines == r.text.count("\n") + 1


def test_lines_one_edit_apart(spark):
    base = "a line of some length, é and 🙂 in it"
    edits = [base[:i] + base[i + 1:] for i in range(0, len(base), 5)] + [base[:i] + "Z" + base[i:] for i in (0, 9, len(base))] \
        + [base[:i] + "Q" + base[i + 1:] for i in (0, 11, len(base) - 1)]
    far = ["QQ" + base[2:], base[:-2], base + "ZZ"]
    docs = [(i, t) for i, t in enumerate([base, *edits, *far])] + [(99, base), (98, "\n".join([base, base]))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute_lines(docs)
    assert {i: r.kept_text for i, r in got.items()} == {i: want[False, i, t] for i, t in docs}
    assert got[98].n_removed == 2 and got[0].n_removed == 0


def test_no_lines(nothing):
    assert line_dedup.dedup_lines(nothing).count() == 0


# ---- 7 BPE

def test_bpe_agrees_with_the_library(awkward, nothing):
    library = Tokenizer.from_file(PATH)
    got = bpe.decode(bpe.encode(awkward, PATH), PATH).collect()
    assert len(got) == len(rows())
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(nothing, PATH), PATH).count() == 0


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_bpe_on_any_text(text):
    library = test_bpe_on_any_text.__dict__.setdefault("library", Tokenizer.from_file(PATH))
    model = bpe.load(test_bpe_on_any_text.__dict__.setdefault("spec", open(PATH, encoding="utf-8").read()))
    assert model.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_cache_never_changes_a_result(monkeypatch):
    model = bpe.WordBpe(open(PATH, encoding="utf-8").read())
    text = " ".join(prose(31, 400))
    want = model.encode(text)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    assert model.encode(text) == want


# ---- 9 quality

def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.good == (held.quality == 1)).mean() > 0.93
    assert got.score.between(0, 1).all()


def test_quality_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 0), (3, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(awkward, labels)
    assert {r.score for r in quality.score(awkward, model).collect()} == {1.0}
    empty = labels.filter("false")
    assert {r.score for r in quality.score(awkward, quality.train(awkward, empty)).collect()} == {0.5}
    assert quality.score(nothing, model).count() == 0


def test_quality_of_one_bad_label_in_five_hundred(spark):
    """Labels of other documents take no place in the sample, and the only one of its kind is learned from."""
    docs = spark.createDataFrame([(i, "spam buy now $$$ click" if i == 7 or i > 500 else " ".join(prose(i, 60)), "s", "en") for i in range(560)],
                                 "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i != 7)) for i in range(500)] + [(i, 0) for i in range(10_000, 14_000)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    good = sorted(got[i] for i in range(500) if i != 7)
    assert max(got[i] for i in range(501, 560)) < good[len(good) // 20]


@given(st.lists(st.sampled_from([0.0, 1.0, float("nan")]), max_size=60))
def test_labels_split_by_kind(label):
    label = np.array(label)
    fit, held = quality.split(label)
    for value in (0, 1):
        at = set(np.flatnonzero(label == value))
        a, b = at & set(fit), at & set(held)
        assert a | b == at and bool(a) == bool(b) == bool(at) and (len(at) < 2 or not a & b)


# ---- 10 language model

def test_scores_against_brute_force_counts(awkward):
    from pyspark.sql import functions as F
    held = F.coalesce(langid.fold("doc_id", 7) == 2, F.lit(False))
    got = lm.score(awkward, held).collect()
    lower = str.maketrans({i: i + 32 for i in range(65, 91)})
    docs = [(i, [*words((t or "").translate(lower)), None]) for i, t, *_ in rows()]
    out = {i for i, _ in docs if i is not None and zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(w for i, t in docs if i not in out for w in t)
    n, v = sum(counts.values()), len(counts)
    want = [(i, i in out, len(t), sum(w in counts for w in t), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)) for i, t in docs]
    key = lambda r: (repr(r[0]), r[2], r[5])
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] <= 0


def test_rare_tokens_are_counted_by_join(awkward, monkeypatch):
    from pyspark.sql import functions as F
    whole = {(r.doc_id, r.n_tokens): (r.n_known, r.base_score) for r in lm.score(awkward, F.lit(False)).collect()}
    monkeypatch.setattr(lm, "HEAD", 5)
    for r in lm.score(awkward, F.lit(False)).collect():
        known, base = whole[r.doc_id, r.n_tokens]
        assert r.n_known == known == r.n_tokens and r.base_score == pytest.approx(base, rel=1e-9)


def test_commonest_tokens_by_histogram(spark):
    counts = [(i, c) for i, c in enumerate([1] * 30 + [2] * 10 + [7, 7, 5000, 5001, 9000, 70_000])]
    df = spark.createDataFrame(counts, "h long, c long")
    for most, want in ((46, 46), (45, 16), (16, 16), (6, 6), (5, 4), (1, 1), (0, 0)):
        got = [r.c for r in lm.commonest(df, most).collect()]
        assert len(got) == want and sorted(got, reverse=True) == sorted((c for _, c in counts), reverse=True)[:want]


def test_probabilities_of_a_factor_sum_to_one():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(lm.TABLE, lm.WIDTH)).astype(np.float32)
    prior = np.log(rng.dirichlet(np.ones(lm.WIDTH), size=lm.WIDTH + 1)).astype(np.float32)
    rows_ = np.repeat(rng.integers(0, lm.TABLE, (lm.FEATURES, 1)), lm.WIDTH, axis=1).astype(np.int32)
    logs = lm.line_logs(np.arange(lm.WIDTH), np.full(lm.WIDTH, 5), rows_, weights, prior)
    assert np.exp(logs).sum() == pytest.approx(1, rel=1e-4)


def test_scores_against_a_plain_softmax(spark):
    """Whole texts scored in plain Python from the counts and the trained weights; the operator must agree, whatever the layout."""
    from pyspark.sql import functions as F
    texts = [" ".join(prose(i, 40 + 30 * i)) for i in range(12)] + ["", None, "x", "unheard of " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = F.col("doc_id") % 4 == 3
    _, vocabulary, weights = lm.train(docs.filter(~held), "doc_id", "text")
    assert weights.any()
    got = [{r.doc_id: r.score for r in lm.score(d, held).collect()} for d in (docs, docs.repartition(5), docs.coalesce(1))]
    assert got[0] == got[1] == got[2]
    for i, text in enumerate(texts):
        hashes, shape, bounds = lm.tokens([(text or "").encode()])
        rank, count = vocabulary.look_up(hashes)
        _, _, rows_ = lm.features(rank, shape, bounds, len(weights))
        total = 0.0
        for t, (r, s) in enumerate(zip(rank.tolist(), shape.tolist(), strict=True)):
            symbol = r if r < lm.SINGLES else lm.SINGLES + s
            for half, (goal, base) in enumerate(((symbol // lm.WIDTH, 0), (symbol % lm.WIDTH, 1 + symbol // lm.WIDTH))):
                sums = [float(vocabulary.prior[base, j]) + sum(float(weights[row, j]) for row in rows_[:, t + half * len(rank)]) for j in range(lm.WIDTH)]
                total += (sums[goal] - math.log(sum(map(math.exp, sums)))) / math.log(10)
            total += math.log10(count[t] + 1) - vocabulary.log_room[symbol]
        assert got[0][i] == pytest.approx(total, rel=1e-5)


def test_symbols_and_tokens_of_each_sum_to_one(spark):
    texts = [" ".join(prose(i, 200)) for i in range(6)]
    _, vocabulary, _ = lm.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    assert np.exp(vocabulary.prior).sum(axis=1) == pytest.approx(np.ones(lm.WIDTH + 1), rel=1e-5)
    hashes, shape, _ = lm.tokens([t.encode() for t in texts])
    _, first = np.unique(hashes, return_index=True)
    rank, count = vocabulary.look_up(hashes[first])
    of = lm.symbols(rank, shape[first])
    sums = np.bincount(of, (count + 1) / 10 ** vocabulary.log_room[of], lm.SYMBOLS) + 1 / 10**vocabulary.log_room
    assert sums == pytest.approx(np.ones(lm.SYMBOLS))


def test_a_hot_document_is_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAME", 50)
    docs = spark.createDataFrame([(1, "the same"), (None, None)] * 300 + [(i, f"text {i}") for i in range(2, 200)], "id long, text string")
    parts = [[r.text for r in p] for p in lm.sharded(docs, 6).rdd.glom().collect()]
    assert len(parts) == 6 and Counter(t for p in parts for t in p) == Counter(r.text for r in docs.collect())
    assert max(p.count("the same") for p in parts) < 100 and max(p.count(None) for p in parts) < 100


def test_model_beats_counts_on_held_out_documents(spark):
    got = QUERIES["op10_lm_scoring"](spark, "/root/testdata/sf0.01").toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() * 0.926
    assert (got.score <= 0).all()


def test_scores_of_nothing(nothing):
    from pyspark.sql import functions as F
    assert lm.score(nothing, F.lit(False)).count() == 0


def test_every_training_document_moves_the_weights(spark):
    """1,500 documents, each with a word of its own: the weights after each of them must have been trained."""
    own = [f"own{i}x" for i in range(1500)]
    docs = spark.createDataFrame([(i, f"{w} then {w} there {w}") for i, w in enumerate(own)], "doc_id long, text string").repartition(3)
    _, vocabulary, weights = lm.train(docs, "doc_id", "text")
    hashes, shape, bounds = lm.tokens([f"{w} {w} {w} {w}".encode() for w in own])
    rank, count = vocabulary.look_up(hashes)
    _, _, met = lm.features(rank, shape, bounds, len(weights))
    assert (count[bounds[:-1]] == 3).all() and (rank[bounds[:-1]] < lm.CONTEXT).all()
    assert weights[met[0, bounds[:-1] + 1]].any(axis=1).all()


def test_weight_table_grows_with_the_corpus():
    sizes = [lm.table_rows(n) for n in (0, 1, 10**6, 10**9, 10**10)]
    assert sizes[:3] == [lm.TABLE] * 3 and lm.TABLE < sizes[3] < sizes[4] and all(n & (n - 1) == 0 for n in sizes)


def test_a_step_is_the_gradient_of_each_row():
    rng = np.random.default_rng(2)
    goal, rows_ = rng.integers(0, lm.WIDTH, 300), rng.integers(0, 40, (lm.FEATURES, 300)).astype(np.int32)
    rows_[0, :200] = 7
    weights, prior = rng.normal(size=(64, lm.WIDTH)).astype(np.float32), np.zeros((300, lm.WIDTH), np.float32)
    p = np.exp(weights[rows_].sum(axis=0).astype(float))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(300), goal] -= 1
    want = np.zeros((64, lm.WIDTH))
    for r in rows_:
        np.add.at(want, r, p)
    gathered = lm.FIRST + (want**2).mean(axis=1)
    moved, sums = weights.copy(), np.full(64, lm.FIRST, np.float32)
    lm._step(goal, rows_, moved, sums, prior)
    assert np.allclose(weights - moved, lm.RATE / np.sqrt(gathered)[:, None] * want, atol=1e-4) and np.allclose(sums, gathered, rtol=1e-3)


@pytest.mark.parametrize("table", [lm.TABLE, 1 << 22])
def test_training_steps_against_plain_sums(table):
    """Adagrad steps over batches with rows that are met once, a few times and by every line; the room that a batch
    leaves behind must not show in the next, smaller one."""
    rng = np.random.default_rng(3)
    weights, gathered = np.zeros((table, lm.WIDTH), np.float32), {}
    prior = np.log(rng.dirichlet(np.ones(lm.WIDTH), size=lm.WIDTH + 1)).astype(np.float32)
    step, plain = lm.Steps(weights, prior), {}
    for n in (600, 37, 1):
        goal, base = rng.integers(0, lm.WIDTH, n), rng.integers(0, lm.WIDTH + 1, n)
        rows_ = np.stack([rng.integers(table - 50, table, n), rng.integers(0, 4 * n, n), rng.integers(0, n // 3 + 1, n), np.full(n, table - 1)]).astype(np.int32)
        gradient = {}
        for i in range(n):
            x = prior[base[i]].astype(np.float64) + sum(plain.get(r, np.zeros(lm.WIDTH)) for r in rows_[:, i].tolist())
            p = np.exp(x) / np.exp(x).sum()
            p[goal[i]] -= 1
            for r in rows_[:, i].tolist():
                gradient[r] = gradient.get(r, 0) + p
        for r, g in gradient.items():
            gathered[r] = gathered.get(r, lm.FIRST) + (g * g).sum() / lm.WIDTH
            plain[r] = plain.get(r, np.zeros(lm.WIDTH)) - lm.RATE / np.sqrt(gathered[r]) * g
        step(goal, base, rows_)
        assert weights[[*plain]] == pytest.approx(np.array([*plain.values()]), abs=2e-5)
    assert np.count_nonzero(weights[table - 60 :].any(axis=1)) == sum(r >= table - 60 for r in plain)


def test_counts_of_hashes_that_share_their_leading_bits():
    import pandas as pd
    near = [(1 << 50) + i for i in range(5)] + [0, 1, (1 << 64) - 1, (1 << 64) - 3, (1 << 44) - 1, 1 << 44]
    counts = {h: 100 - i for i, h in enumerate(near)}
    head = pd.DataFrame({"h": np.array([*counts], np.uint64).view(np.int64), "c": [*counts.values()], "shape": [1] * len(near)})
    vocabulary = lm.Vocabulary(head, {1: (1000, len(near))}, 1000, len(near))
    asked = [*near, *(h + 1 for h in near if h + 1 < 1 << 64), 2, (1 << 63) + 5]
    rank, count = vocabulary.look_up(np.array(asked, np.uint64))
    assert count.tolist() == [counts.get(h, 0) for h in asked]
    assert rank.tolist() == [near.index(h) if h in counts else lm.HEAD for h in asked]


def test_lines_against_plain_features():
    """Contexts end at the start of a text, however short it and its neighbours are; rows are those of splitmix hashes."""
    rng = np.random.default_rng(4)
    for sizes in ([1], [1, 1, 2, 1, 3, 5, 1], [40, 1, 7]):
        n, bounds, table = sum(sizes), np.concatenate([[0], np.cumsum(sizes)]), 1 << 18
        shape, rank = rng.integers(0, lm.SHAPES, n).astype(np.int16), rng.integers(0, 2 * lm.CONTEXT, n)
        code, symbol = lm.codes(rank, shape), lm.symbols(rank, shape)
        goal, base, rows_ = lm.lines(code, symbol, bounds, table)
        mix = lambda x: int(lm.mix(np.array([x], np.uint64))[0])
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            for t in range(start, end):
                group, member = divmod(int(symbol[t]), lm.WIDTH)
                assert (goal[t], base[t], goal[n + t], base[n + t]) == (group, 0, member, group + 1)
                past = [int(code[t - d]) if t - d >= start else 0xFFFF for d in (1, 2, 3)]
                for i, k in enumerate([*past, past[0] << 20 | past[1]]):
                    h = mix(k << 2 | i)
                    inner = (h ^ mix(group)) * int(lm.SPREAD) % (1 << 64) >> 24
                    assert (rows_[i, t], rows_[i, n + t]) == (h % table, inner % table)


def test_codes_are_trained_in_the_runs_of_their_texts(monkeypatch):
    import pyarrow as pa
    from marketlens.llm import words as w
    monkeypatch.setattr(lm, "CHUNK_BYTES", 100)
    monkeypatch.setattr(w, "CHUNK_BYTES", 100)
    for texts in ([], [""], ["", "a b", "c" * 300, "d", ""], ["x " * 49] * 3 + ["e", "f g"], ["y" * 60, "z" * 40, "é" * 50, ""]):
        raws = [t.encode() for t in texts]
        codes = [np.arange(len(r.split()) + 1, dtype=np.uint16) + 7 * i for i, r in enumerate(raws)]
        batch = pa.RecordBatch.from_arrays([pa.array([len(r) for r in raws], pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["size", "codes"])
        got = [[code[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] for code, bounds in lm._runs(batch)]
        assert got == [[c.tolist() for c in codes[first : first + len(run)]] for first, run in w.chunked(texts)]


def test_a_code_tells_the_symbol():
    import pandas as pd
    rng = np.random.default_rng(5)
    for n in (0, 3, lm.SINGLES + 5, lm.CONTEXT + 50):
        shape = rng.integers(0, lm.SHAPES, n)
        head = pd.DataFrame({"h": np.arange(n, dtype=np.int64), "c": np.arange(n, 0, -1), "shape": shape})
        sizes = {s: (10**8, 10**5) for s in range(lm.SHAPES)}
        vocabulary = lm.Vocabulary(head, sizes, 10**9, 10**6)
        rank, of = np.concatenate([np.arange(n), np.full(lm.SHAPES, lm.HEAD)]), np.concatenate([shape, np.arange(lm.SHAPES)])
        assert vocabulary.symbols.take(lm.codes(rank, of)).tolist() == lm.symbols(rank, of).tolist()


def test_totals_of_hashes_that_differ_in_their_last_bits():
    rng = np.random.default_rng(6)
    far = rng.integers(0, 1 << 63, 50, dtype=np.uint64) << np.uint64(1)
    for kinds in (far, np.concatenate([far, far[:5] ^ np.uint64(1)]), np.arange(3, dtype=np.uint64)):
        shape = rng.integers(0, lm.SHAPES, len(kinds)).astype(np.int16)
        at = rng.integers(0, len(kinds), 400)
        want = sorted((int(kinds[i]), int(shape[i]), n) for i, n in Counter(at.tolist()).items())
        assert [*zip(*(c.tolist() for c in lm.totals(kinds[at], shape[at])), strict=True)] == want


def test_hot_rows_keep_all_their_columns(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAME", 20)
    keyed = spark.createDataFrame([(5, 3, bytearray(b"ab"))] * 60 + [(i, i, bytearray([i, 0])) for i in range(10, 30)], "k long, size long, codes binary")
    got = lm.placed(keyed, 4).collect()
    assert Counter((r.size, bytes(r.codes)) for r in got) == Counter((r.size, bytes(r.codes)) for r in keyed.collect())
    assert max(Counter(r.shard for r in got if r.size == 3).values()) < 60


def test_batches_hold_every_line_once_at_even_distances(monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(lm, "BATCH", 16)
    for sizes in ([1], [3, 1, 4], [8], [9, 1, 30, 2, 7]):
        n, bounds, table = sum(sizes), np.concatenate([[0], np.cumsum(sizes)]), 1 << 18
        shape, rank = rng.integers(0, lm.SHAPES, n).astype(np.int16), rng.integers(0, 2 * lm.CONTEXT, n)
        code, symbol = lm.codes(rank, shape), lm.symbols(rank, shape)
        goal, base, rows_ = lm.lines(code, symbol, bounds, table)
        batches = [*lm.dealt(code, symbol, bounds, table)]
        assert len(batches) == -(-2 * n // 16)
        for a, batch in enumerate(batches):
            at = slice(a, None, len(batches))
            for got, want in zip(batch, (goal[at], base[at], rows_[:, at]), strict=True):
                assert got.tolist() == want.tolist()


def test_a_batch_reads_each_weight_row_once():
    rng = np.random.default_rng(8)

    class Counted:
        def __init__(self, weights):
            self.weights, self.read = weights, 0

        def __len__(self):
            return len(self.weights)

        def take(self, at, **how):
            self.read += len(at)
            return self.weights.take(at, **how)

    step = lm.Steps(np.zeros((lm.TABLE, lm.WIDTH), np.float32), np.zeros((lm.WIDTH + 1, lm.WIDTH), np.float32))
    step.weights = counted = Counted(step.weights)
    rows_ = rng.zipf(1.3, (lm.FEATURES, 500)).clip(max=lm.TABLE - 1).astype(np.int32)
    step(rng.integers(0, lm.WIDTH, 500), np.zeros(500, np.int64), rows_)
    assert counted.read == len(np.unique(rows_))


@pytest.mark.parametrize("size", [60.0, 1e6])
def test_a_step_keeps_extreme_sums_apart(size):
    """Sums beyond +-EXTREME count as that much, so no exponential overflows and no total is 0."""
    n = lm.WIDTH
    start = np.where(np.arange(n)[:, None] <= np.arange(lm.WIDTH), size, -size).astype(np.float32)
    start[0] = -size
    weights = start.copy()
    rows_ = np.stack([np.arange(n), np.arange(n), np.full(n, n), np.full(n, n + 1)]).astype(np.int32)
    weights = np.concatenate([weights, np.zeros((2, lm.WIDTH), np.float32)])
    step = lm.Steps(weights, np.zeros((1, lm.WIDTH), np.float32))
    goal = np.arange(n) % 3
    step(goal, np.zeros(n, np.int64), rows_)
    p = np.exp(np.clip(2.0 * start, -lm.EXTREME, lm.EXTREME))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), goal] -= 1
    g = p.sum(axis=0)
    assert np.isfinite(weights).all()
    assert weights[n] == pytest.approx(-lm.RATE / np.sqrt(lm.FIRST + (g * g).mean()) * g, abs=1e-5)


def test_texts_are_cut_in_runs_of_the_given_size():
    from marketlens.llm import words as w
    texts = ["a" * 40, "b" * 70, None, "c" * 30, "d" * 200]
    assert [(first, [len(r) for r in run]) for first, run in w.chunked(texts, 100)] == [(0, [40]), (1, [70, 0, 30]), (4, [200])]
    assert len([*w.chunked(texts)]) == 1
