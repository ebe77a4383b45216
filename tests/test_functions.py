"""Column functions: one test per pitfall of the obvious Spark mapping."""

import datetime as dt

from pyspark.sql import functions as F

from marketlens.functions.dates import parse_date_multi, week_key, whole_minutes, whole_seconds
from marketlens.functions.numeric import n_unique, round_pct
from marketlens.functions.text import strip_ws, title_case


def test_title_case_splits_on_any_non_alphanumeric(spark):
    rows = [("self-employed of x1Y",), ("NATION_3",), ("delhi  ncr",), ("",), (None,), ("o'neil",)]
    out = spark.createDataFrame(rows, "s string").select(title_case("s").alias("t")).collect()
    assert [r.t for r in out] == ["Self-Employed Of X1y", "Nation_3", "Delhi  Ncr", "", None, "O'Neil"]


def test_initcap_would_differ(spark):
    r = spark.range(1).select(F.initcap(F.lit("self-employed")).alias("a"), title_case(F.lit("self-employed")).alias("b")).first()
    assert (r.a, r.b) == ("Self-employed", "Self-Employed")


def test_strip_removes_all_whitespace(spark):
    r = spark.range(1).select(strip_ws(F.lit("\t x \n")).alias("s"), F.trim(F.lit("\t x ")).alias("t")).first()
    assert r.s == "x" and r.t == "\t x"


def test_two_format_date_parse(spark):
    rows = [("2024-03-05",), ("05/03/2024",), ("junk",), (None,)]
    out = spark.createDataFrame(rows, "s string").select(parse_date_multi("s").alias("d")).collect()
    assert [r.d for r in out] == [dt.date(2024, 3, 5), dt.date(2024, 3, 5), None, None]


def test_week_key_reference_and_iso(spark):
    rows = [(dt.date(2024, 12, 30),), (dt.date(2023, 1, 1),), (dt.date(2024, 6, 3),)]
    df = spark.createDataFrame(rows, "d date")
    out = df.select(week_key("d").alias("r"), week_key("d", "iso").alias("i")).collect()
    assert [(r.r, r.i) for r in out] == [("2024-W01", "2025-W01"), ("2023-W52", "2022-W52"), ("2024-W23", "2024-W23")]


def test_whole_minutes_and_seconds_truncate(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10, 0, 0), dt.datetime(2024, 1, 1, 10, 2, 59, 999000))],
                               "a timestamp_ntz, b timestamp_ntz")
    r = df.select(whole_minutes("a", "b").alias("m"), whole_seconds("a", "b").alias("s")).first()
    assert (r.m, r.s) == (2, 179)


def test_round_pct_is_exact_half_up(spark):
    # 1/8 = 12.5 % -> 13 at 0 dp; 1/16 = 6.25 % -> 6.3 at 1 dp; 1/3 -> 33.3
    df = spark.createDataFrame([(1, 8), (1, 16), (1, 3), (0, 0)], "a long, b long")
    out = df.select(round_pct(F.col("a"), F.col("b"), 0).alias("r0"), round_pct(F.col("a"), F.col("b"), 1).alias("r1")).collect()
    assert [(r.r0, r.r1) for r in out] == [(13.0, 12.5), (6.0, 6.3), (33.0, 33.3), (None, None)]


def test_n_unique_counts_null_once(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",), (None,), ("b",)], "x string")
    r = df.agg(n_unique("x").alias("n"), F.count_distinct("x").alias("c")).first()
    assert (r.n, r.c) == (3, 2)


def test_local_now_is_ist(spark):
    from marketlens.functions.dates import local_now

    r = spark.range(1).select(local_now().alias("ist"), F.current_timestamp().cast("timestamp_ntz").alias("utc")).first()
    offset = (r.ist - r.utc).total_seconds()
    assert abs(offset - 5.5 * 3600) < 60
