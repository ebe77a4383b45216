"""Distributed ordering primitives: ordinal rank, exact "nearest" quantiles, equal-frequency bins.

A plain ``row_number().over(Window.orderBy(...))`` has no partition key, so Spark moves every row
into one task. These operators keep the work spread over all executors instead.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.operators.select import BUCKETS, double_of, ordered_long, select_keys
from marketlens.session import checkpoint_dir

_ROW_BITS = 33  # monotonically_increasing_id = partition index << 33 | row index within partition


def ordinal_rank(df: DataFrame, order_by: list[Column], rank_col: str = "rank",
                 partitions: int | None = None) -> DataFrame:
    """Add a 1-based ordinal rank (a permutation of 1..n) following ``order_by``.

    ``order_by`` must make the order total (end it with a unique key) so ranks are deterministic.
    Plan: range-partition on the sort key (sampled bounds split even a single hot value, because
    the unique tie-break is part of the key), sort inside partitions, write a reliable checkpoint so
    partition contents can no longer move, then rank = rows in earlier partitions + row index.
    The per-partition counts are one row per partition, so the offsets table is bounded.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n_parts, *order_by).sortWithinPartitions(*order_by).checkpoint(eager=True)
    indexed = ranged.withColumn("_mid", F.monotonically_increasing_id()).withColumn(
        "_pid", F.shiftright("_mid", _ROW_BITS))
    counts = indexed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    row_in_part = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (indexed.join(F.broadcast(offsets), "_pid")
            .withColumn(rank_col, F.col("_off") + row_in_part + 1)
            .drop("_mid", "_pid", "_off"))


def nearest_index(n: int, q: float) -> int:
    """0-based position of the "nearest" quantile: round((n - 1) * q), halves rounded up."""
    return int(math.floor((n - 1) * q + 0.5))


def quantile_nearest(df: DataFrame, column: str, qs: list[float], buckets: int = BUCKETS) -> DataFrame:
    """Exact "nearest" quantiles of a numeric column: one row per q with columns (q, value).

    All of them are found together by ``select.select_keys``: hash aggregates over the column, at most six
    at any size, whatever values it holds; NaN is the largest value. They run when the plan is built, since
    each depends on the counts before it.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    found, n, _ = select_keys(values, [ordered_long(F.col("v"))], lambda n: [nearest_index(n, q) for q in qs], buckets)
    picked = [double_of(k[0]) for k in found] if n else [None] * len(qs)
    return df.sparkSession.createDataFrame([(float(q), v) for q, v in zip(qs, picked, strict=True)], "q double, value double")


def frequency_bins(df: DataFrame, orderings: dict[str, list[Column]], max_bins: int = 5) -> tuple[DataFrame, int]:
    """(``df`` with one equal-frequency bin column per ordering, number of bins).

    An ordering is a list of longs that no two rows share (end it with the id). The bins of ``equal_frequency_bins``
    are cut at fixed ranks, so the b - 1 rows at those ranks are all that has to be found (``select_keys``); a
    row's bin is then one more than the number of cuts it lies beyond. No row is sorted, joined or moved. The
    orderings are searched at the same time, when the plan is built: ``df`` should be a stored table.
    """
    def cuts(keys: list[Column]) -> tuple[list[tuple[int, ...]], int]:
        found, n, _ = select_keys(df, keys, lambda n: [(n - 1) * j // min(max_bins, max(n, 1)) for j in range(1, min(max_bins, n))])
        return found, n

    with ThreadPoolExecutor(max_workers=max(1, len(orderings))) as pool:
        found = list(pool.map(cuts, orderings.values()))
    columns = {}
    for (name, keys), (at, _) in zip(orderings.items(), found, strict=True):
        row = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
        beyond = [(row > F.struct(*[F.lit(v).cast("long").alias(f"k{i}") for i, v in enumerate(cut)])).cast("long") for cut in at]
        columns[name] = reduce(lambda a, b: a + b, beyond, F.lit(1).cast("long"))
    n = found[0][1] if found else 0
    return df.withColumns(columns), max(min(max_bins, n), 1)


def equal_frequency_bins(rank: Column, n: Column, max_bins: int = 5) -> Column:
    """Bin (1..b) of an ordinal rank among n values, b = max(min(max_bins, n), 1).

    Matches quantile cuts of ranks 1..n with linearly interpolated breaks and right-closed bins:
    bin = ceil((r - 1) * b / (n - 1)), at least 1; 7 ranks in 5 bins -> 1,1,2,3,4,5,5. Unlike
    ``ntile`` (1,1,2,2,3,4,5) it needs no window: it is a pure expression of (rank, n).
    """
    b = F.greatest(F.least(F.lit(max_bins), n), F.lit(1)).cast("long")
    num = (rank.cast("long") - 1) * b + n.cast("long") - 2
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(
        F.greatest(F.lit(1).cast("long"), F.call_function("div", num, n.cast("long") - 1)))
