"""Key deduplication with a declared, deterministic survivor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.sources.tables import staged


def smallest_row(df: DataFrame, key: str, order_by: list[str] | None = None) -> DataFrame:
    """One row per ``key``: the row that is smallest by ``order_by`` (such as an arrival time) and then
    by every other column, nulls last, so a copy that lacks a value never wins over one that has it.

    ``min(struct(...))`` is an ordinary aggregate (sort-based, since a struct is compared), so copies of
    a hot key collapse map-side before the shuffle; a ``row_number`` window would send all of them to
    one task. Null keys form one group, like any other value.
    """
    order_by = order_by or []
    rest = [c for c in df.columns if c != key and c not in order_by]
    packed = F.struct(*[x for c in order_by + rest for x in (F.isnull(c).alias(f"_no_{c}"), F.col(c))]).alias("_row")
    kept = df.groupBy(key).agg(F.min(packed).alias("_row"))
    return kept.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """(_key) of the keys that more than one row has, as a small stored table: counting shuffles keys only, and a
    stored table has a known size, so Spark can tell whether it may be broadcast."""
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    return staged(counts.where(F.col("_n") > 1).select("_key"), "repeated-keys")


def keep_first(df: DataFrame, key: str, order_by: list[str] | None = None) -> DataFrame:
    """``smallest_row`` of every ``key``, moving as few rows as possible.

    Keys alone are counted first. Rows of unique keys pass an anti join with the repeated ones; only rows of
    repeated keys are packed, aggregated and shuffled. With few copies the repeated keys are broadcast (Spark
    decides by the size of their stored table and AQE again by what it measures) and unique rows do not move
    at all; with many it is a co-partitioned join.
    """
    again = repeated_keys(df, key)
    same = F.col(key).eqNullSafe(F.col("_key"))
    unique = df.join(again, same, "left_anti")
    return unique.unionByName(smallest_row(df.join(again, same, "left_semi"), key, order_by))


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole-row deduplication."""
    return df.distinct()
