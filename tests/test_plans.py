"""Plan shape checks: no operator pulls every row into one task, filters reach the scan."""

import re

import pytest

from marketlens.plans.inspect import physical_plan, scan_lines, unpartitioned_windows
from marketlens.plans.registry import QUERIES
from tests.conftest import SF_SMALL

# Global windows that are allowed: over one row per shuffle partition (rank offsets).
ALLOWED = re.compile(r"_pid")


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_unpartitioned_window_over_data(spark, key):
    df = QUERIES[key](spark, SF_SMALL)
    bad = [w for w in unpartitioned_windows(df) if not ALLOWED.search(w)]
    assert bad == []


def test_date_slice_prunes_month_folders(spark):
    lines = scan_lines(QUERIES["filter_date_range"](spark, SF_SMALL))
    assert any("PartitionFilters: [isnotnull(order_month" in l and "1997-01" in l for l in lines)


def test_projection_reaches_scan(spark):
    lines = scan_lines(QUERIES["rating_dist"](spark, SF_SMALL))
    assert lines and all("ReadSchema: struct<order_status:string,rating:" in l for l in lines)


def test_events_are_not_expanded(spark):
    for key in ("kpi_engagement", "kpi_conversion"):
        assert "Expand" not in physical_plan(QUERIES[key](spark, SF_SMALL))


def test_dedup_is_an_aggregate_not_a_window(spark):
    from marketlens.operators.dedup import keep_first

    df = spark.createDataFrame([(1, "a"), (1, "b")], "k long, s string")
    plan = physical_plan(keep_first(df, "k"))
    assert "Window" not in plan and ("HashAggregate" in plan or "SortAggregate" in plan or "ObjectHashAggregate" in plan)


def test_cuisine_filter_is_a_semi_join(spark):
    assert "LeftSemi" in physical_plan(QUERIES["filter_cuisine"](spark, SF_SMALL))


def test_window_detector_sees_global_and_partitioned_windows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.range(10).withColumn("g", F.col("id") % 2)
    glob = df.withColumn("r", F.row_number().over(Window.orderBy("id")))
    part = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    whole = df.withColumn("m", F.min("id").over(Window.partitionBy("g")))
    assert len(unpartitioned_windows(glob)) == 1
    assert unpartitioned_windows(part) == [] and unpartitioned_windows(whole) == []
    assert len(unpartitioned_windows(QUERIES["ordinal_rank"](spark, SF_SMALL))) == 1  # the offsets window, allowed


@pytest.mark.parametrize("key", sorted(k for k in QUERIES if k != "clean_orders"))
def test_orders_scans_are_pruned(spark, key):
    """Every query but clean_orders (which returns every column) reads a narrow slice of orders."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    widths = [m.group(1).count(":") for line in physical_plan(QUERIES[key](spark, SF_SMALL)).splitlines()
              if "marketlens-clean" in line and "/orders" in line
              and (m := re.search(r"ReadSchema: struct<(.*?)>(\s|$)", line))]
    assert all(w <= 20 for w in widths), widths  # of 33 columns (the fused orders aggregate reads 18)
