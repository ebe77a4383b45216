"""Intermediate tables in the folder all executors share, and reads of the text tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files of a finished write are of no further use; Spark drops them when this is on.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a new temporary folder only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")
    made = tempfile.mkdtemp(prefix="marketlens-llm-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, so a lost executor
    costs no recomputation, and the write's own shuffle files are dropped at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marketlens-llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str, text_col: str) -> Column:
    """Key of a row that is the same on every recomputation. Rows that repeat both id and text
    share it, which is harmless: whatever holds for one of them holds for the other."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def bounded_sample(df: DataFrame, n: int, order: Column) -> DataFrame:
    """The ``n`` rows with the smallest ``order``, a 64-bit hash of the row. Only rows below a cut that
    leaves about 1.2 n of them are ordered, so a task sends its share of those and no more."""
    total = df.count()
    share = min(1.0, (1.2 * n + 50) / max(1, total))
    cut = int(-(2**63) + share * 2**64)
    few = df.withColumn("__o", order).filter(F.col("__o") <= F.lit(min(cut, 2**63 - 1)))
    return few.orderBy("__o", *[F.col(f"`{c}`") for c in df.columns]).limit(n).drop("__o")
