"""The corpus pipeline: documents through five of the training-data operators, in order.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import bpe, langid, line_dedup, minhash_dedup, mixing
from marketlens.llm.store import row_key, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those with no text or no letter go."""
    model = langid.train(docs)
    return langid.identify(docs, model).filter(F.col("lang_pred") != langid.UNDETERMINED).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line of the corpus, or differ from one by an edit, go; so do
    documents of which that leaves only blank lines."""
    kept = line_dedup.dedup_lines(docs).filter((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"\S"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source",
                       F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id, a null one last. Rows are told
    apart by id and text, so ids may be null or repeat; a row that repeats both stays once."""
    keyed = docs.withColumn("__k", row_key("doc_id", "text"))
    found = minhash_dedup.near_duplicates(keyed.select("__k", "text"), id_col="__k").select("__k", "component").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__k"))
    kept = keyed.select("__k", "doc_id").distinct().join(found, "__k").groupBy("component").agg(first.alias("first")).select("first.__k")
    return keyed.dropDuplicates(["__k"]).join(kept, "__k", "left_semi").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs, mixing.as_sources("source")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives the same ids' strings again."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "source", "text"), path).drop("text"), path)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language", language), ("line_dedup", lines), ("near_duplicates", near_duplicates),
          ("mixing", mixture), ("bpe", encoding)]

#: SQL can express neither the sampled language model nor the sampling sketches.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
