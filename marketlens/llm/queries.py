"""Registered queries of the training-data operators; each reads its whole table and derives the
digest columns from the operator's own output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import bpe, collocations, embedding_dedup, fingerprint, hard_negatives, langid, line_dedup, lm, minhash_dedup, mixing, quality, secret_scan, substring_dedup
from marketlens.llm.store import table, written

WORDS = r"[^\x20\x09-\x0D]+"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.fold("doc_id", 4) == 2, F.lit(False))
    model = langid.train(docs.filter(~held_out))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_embeddings(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    decoded = bpe.decode(ids, path)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select(
        "doc_id", "source", mixing.as_sources("source").alias("sources"), mixing.token_count().alias("size"),
        mixing.seeded_hash("doc_id", "text").alias("h")), "sized")
    plans, sources = mixing.plan(sized)
    mixed = mixing.with_copies(sized, plans).withColumn("taken", F.col("size") * F.col("n_copies")).alias("m")
    own = F.broadcast(sources.alias("s"))
    return (mixed.join(own, F.col("m.source").eqNullSafe(F.col("s.source")))
            .select("m.doc_id", "m.size", "s.source_size", "s.target", "m.taken"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(langid.fold("doc_id", 4) == 2, F.lit(False))
    model = quality.train(docs.filter(~held_out), labels)
    scores = quality.score(docs, model)
    return scores.select("doc_id", held_out.alias("held_out"), "score", "text_score", "page_score", (F.col("score") >= 0.5).alias("good"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(langid.fold("doc_id", 7) == 2, F.lit(False))
    return lm.score(table(spark, sf_dir, "documents"), held_out)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.prepared(vec_id, label, F.col("embedding"), table(spark, sf_dir, "embeddings"))
    return hard_negatives.mine_hard_negatives(rows, F.col("id") % 100 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(table(spark, sf_dir, "documents"), k=2000, least=10)


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_documents(table(spark, sf_dir, "documents"))
    n_base = len(secret_scan.BASE_RULES)
    base = F.filter("spans", lambda s: s["kind"] < n_base)

    def of(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    count = [of(i).alias(f"n_{r.kind}") for i, r in enumerate(secret_scan.BASE_RULES)]
    return found.select("doc_id", *count, F.sha2(secret_scan.as_text(base), 256).alias("base_sha256"), secret_scan.as_text(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_minhash_near_dedup, op3_language_id, op4_embedding_near_dedup,
    op5_document_fingerprints, op6_line_dedup, op7_bpe_roundtrip, op8_source_mixing, op9_quality_classifier,
    op10_lm_scoring, op11_hard_negatives, op12_phrase_collocations, op13_secret_scans)}
