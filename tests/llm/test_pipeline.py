import corpus_pipeline as pipeline
from marketlens.llm import line_dedup, minhash_dedup
from marketlens.llm.queries import QUERIES
from marketlens.llm.store import written
from tests.llm.conftest import prose, rows


def stages_of(spark, docs):
    out = []
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, "unused"), f"test-{name}")
        out.append(docs)
    return out


def test_stages_take_effect_on_their_own_input(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    told, lined, single, mixed, coded = stages_of(spark, docs)
    assert told.count() == docs.count()  # every document there has letters
    kept = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(told).collect()}
    assert {r.doc_id: r.text for r in lined.collect()} == {i: t for i, t in kept.items() if t.strip()}
    assert lined.count() < told.count()
    assert lined.filter("n_chars <> length(text)").count() == 0
    stay = {r.doc_id for r in minhash_dedup.near_duplicates(lined).filter("kept").collect()}
    assert {r.doc_id for r in single.collect()} == stay and single.count() == len(stay)
    assert {r.doc_id for r in mixed.collect()} <= stay and mixed.columns == list(pipeline.COLUMNS)
    assert coded.count() == mixed.count()
    for r in coded.limit(20).collect():
        assert r.n_tokens == len(r.ids)


def test_awkward_rows_pass(spark, awkward):
    told, lined, single, mixed, coded = stages_of(spark, awkward)
    assert {r.doc_id for r in told.collect()} == {1, 2, 3, 4, 5, 9, 10, 12, 13, 14, None}
    assert told.count() == len(rows()) - 4  # no text, no letters
    assert 5 not in {r.doc_id for r in lined.collect()}  # its one line is document 3's
    ids = [r.doc_id for r in single.collect()]
    assert ids.count(9) == 1 and len(ids) == len(set(ids)) and 3 in ids and 4 not in ids  # 4 is near 3
    assert coded.count() == mixed.count() > 0


def test_empty_table_passes(spark, nothing):
    assert [d.count() for d in stages_of(spark, nothing)] == [0] * 5


def test_every_query_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """Each row is judged by itself: near copies with null ids, and one id with two unlike texts."""
    base, other, third = prose(21, 120), prose(22, 120), prose(23, 120)
    near = lambda text: " ".join([*text[:60], "changed", *text[61:]])
    texts = [(None, " ".join(base)), (None, near(base)), (None, " ".join(other)),
             (5, " ".join(third)), (7, near(third)), (7, " ".join(prose(24, 120))), (7, " ".join(prose(24, 120))), (9, near(prose(24, 120)))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, "unused").collect()), key=repr)
    nulls = [t for i, t in got if i is None]
    assert len(nulls) == 2 and texts[2][1] in nulls
    assert [x for x in got if x[0] is not None] == [texts[3], texts[5]]
