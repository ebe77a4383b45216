"""Incremental refresh of the daily trend charts (orders per day, delivered GMV per day).

The reference refreshes by recomputing everything once a day. With Structured Streaming the two
daily trend tables can instead be kept up to date as raw order files land: order rows are parsed
like the batch cleaning does, exact re-deliveries of an order are dropped within the watermark,
and per-day counts and exact GMV sums are kept in streaming state.

The upper-fence winsorising needs quantiles of the whole table, so a stream cannot compute it; pass
the fence of the last batch refresh (``order_value_fence``) to apply it, or None to report raw values.
Orders arriving later than the watermark delay behind the newest order seen are dropped, as
streaming deduplication requires; the daily batch refresh stays the source of truth for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.numeric import money_sum
from marketlens.model import DELIVERED


def daily_trends(raw_orders: DataFrame, fence: float | None = None, watermark: str = "2 days") -> DataFrame:
    """Streaming (or batch) frame: order_date, orders, gmv (delivered, DECIMAL sum as double)."""
    placed = F.col("order_placed_time")
    if not isinstance(raw_orders.schema["order_placed_time"].dataType, T.TimestampNTZType):
        placed = placed.try_cast(T.TimestampNTZType())
    orders = (raw_orders.where(F.col("order_value").isNotNull())
              .withColumn("order_placed_time", placed)
              .where(F.col("order_placed_time").isNotNull())
              # watermarks need a zone-aware timestamp; it only bounds the dedup state below
              .withColumn("_event_time", F.col("order_placed_time").cast(T.TimestampType()))
              .withWatermark("_event_time", watermark))
    # a stream keeps order ids only for the watermark delay; a batch run deduplicates outright
    orders = orders.dropDuplicatesWithinWatermark(["order_id"]) if orders.isStreaming else orders.dropDuplicates(["order_id"])
    value = F.col("order_value") if fence is None else F.least(F.col("order_value"), F.lit(float(fence)))
    # one state row per calendar day: bounded by the calendar, not by the number of orders
    daily = orders.groupBy(F.to_date("order_placed_time").alias("order_date")).agg(
        F.count(F.lit(1)).alias("orders"),
        money_sum(F.when(F.col("order_status") == DELIVERED, value)).alias("_gmv"))
    return daily.select("order_date", "orders",
                        F.round("_gmv", 4).cast("double").alias("gmv"))


def write_epoch(table_dir: str):
    """foreachBatch sink: each micro-batch (the updated days with their current totals) goes to its
    own folder ``epoch=<id>``. A retried epoch overwrites the same folder, so output is exactly-once
    together with the stream checkpoint."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_dir.rstrip('/')}/epoch={epoch_id}")
    return write


def read_daily_trends(spark: SparkSession, table_dir: str) -> DataFrame:
    """Current table: for each day, the totals from the latest epoch that updated it (one row per
    day and epoch at most, so each group is bounded by the number of micro-batches)."""
    t = spark.read.parquet(table_dir)
    latest = t.groupBy("order_date").agg(F.max_by(F.struct("orders", "gmv"), "epoch").alias("s"))
    return latest.select("order_date", "s.orders", "s.gmv")


def start_daily_trends_table(spark: SparkSession, source_dir: str, schema: T.StructType, table_dir: str,
                             checkpoint: str, fence: float | None = None, available_now: bool = True):
    """Run the stream into an append-only parquet table of per-epoch updates (see ``read_daily_trends``).
    Restarting with the same ``checkpoint`` resumes from the last committed epoch."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    writer = (daily_trends(stream, fence).writeStream.outputMode("update").foreachBatch(write_epoch(table_dir))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
