"""Distributed rank, exact quantiles, equal-frequency bins and the native p-values."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions.stats import normal_two_sided_p, student_t_two_sided_p
from marketlens.operators.rank import equal_frequency_bins, frequency_bins, nearest_index, ordinal_rank, quantile_nearest
from marketlens.operators.select import double_of, ordered_long, select_keys
from marketlens.plans.inspect import physical_plan
from marketlens.plans.segments import decimal_keys, order_keys


def test_ordinal_rank_equals_global_window(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice([1, 2, 2, 3, 3, 3, None])) for i in range(2000)]  # heavy ties and nulls
    df = spark.createDataFrame(rows, "id long, v long").repartition(5)
    ours = ordinal_rank(df, [F.asc("v"), F.asc("id")], "r", partitions=7)
    ref = df.withColumn("g", F.row_number().over(Window.orderBy(F.asc("v"), F.asc("id"))))
    joined = ours.join(ref, "id").where(F.col("r") != F.col("g"))
    assert joined.count() == 0
    assert sorted(r.r for r in ours.select("r").collect()) == list(range(1, 2001))


def test_ordinal_rank_descending_hot_value(spark):
    # one value holds most rows: the unique tie-break still spreads it over partitions
    rows = [(i, 5 if i % 10 else i) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, v long")
    out = ordinal_rank(df, [F.desc("v"), F.asc("id")], "r", partitions=4).orderBy("r").collect()
    expected = sorted(rows, key=lambda t: (-t[1], t[0]))
    assert [(r.id, r.r) for r in out] == [(t[0], i + 1) for i, t in enumerate(expected)]


def test_quantile_nearest_textbook(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 9)], "v double")
    out = {r.q: r.value for r in quantile_nearest(df, "v", [0.25, 0.5, 0.75]).collect()}
    assert out == {0.25: 3.0, 0.5: 5.0, 0.75: 6.0}  # positions round(7q): 2, 4 (3.5 up), 5


@pytest.mark.parametrize("seed", [1, 2])
def test_quantile_nearest_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    values = [round(rnd.lognormvariate(10, 1), 2) for _ in range(5000)] + [1000.0] * 2000  # hot value
    df = spark.createDataFrame([(v,) for v in values], "v double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    s = sorted(values)
    want = {q: s[nearest_index(len(s), q)] for q in qs}
    for buckets in (2, 64, 4096):  # many passes, few
        assert {r.q: r.value for r in quantile_nearest(df, "v", qs, buckets=buckets).collect()} == want, buckets


def test_quantile_nearest_of_few_or_no_values(spark):
    for values in ([], [None], [3.0], [2.0, 2.0, 2.0, None], [5.0, -1.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        s = sorted(v for v in values if v is not None)
        want = {q: s[nearest_index(len(s), q)] if s else None for q in (0.0, 0.5, 1.0)}
        assert {r.q: r.value for r in quantile_nearest(df, "v", [0.0, 0.5, 1.0]).collect()} == want


@pytest.mark.parametrize("n,expected", [
    (1, [1]), (3, [1, 2, 3]), (5, [1, 2, 3, 4, 5]), (7, [1, 1, 2, 3, 4, 5, 5]),
    (10, [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]),
])
def test_equal_frequency_bins(spark, n, expected):
    df = spark.range(1, n + 1).select(F.col("id").alias("r"))
    out = df.select(equal_frequency_bins(F.col("r"), F.lit(n)).alias("b")).orderBy("r").collect()
    assert [r.b for r in out] == expected


def test_ntile_differs_from_quantile_bins(spark):
    df = spark.range(1, 8).select(F.col("id").alias("r"))
    nt = [r.b for r in df.select(F.ntile(5).over(Window.orderBy("r")).alias("b")).collect()]
    assert nt == [1, 1, 2, 2, 3, 4, 5]


@pytest.mark.parametrize("z,p", [(1.959963985, 0.05), (2.575829304, 0.01), (0.0, 1.0), (3.290526731, 0.001)])
def test_normal_p(spark, z, p):
    got = spark.range(1).select(normal_two_sided_p(F.lit(z)).alias("p")).first().p
    assert abs(got - p) < 1e-8


@pytest.mark.parametrize("t,df,p", [(2.228138852, 10.0, 0.05), (12.70620474, 1.0, 0.05), (1.959966, 1e6, 0.05),
                                    (2.0, 10.0, 0.0733880347707), (0.0, 4.0, 1.0)])
def test_student_t_p(spark, t, df, p):
    got = spark.range(1).select(student_t_two_sided_p(F.lit(t), F.lit(df)).alias("p")).first().p
    assert abs(got - p) < 1e-6


def test_student_t_closed_form_df2(spark):
    # df = 2: p = 1 - t / sqrt(t^2 + 2)
    for t in (0.5, 1.5, 4.0):
        got = spark.range(1).select(student_t_two_sided_p(F.lit(t), F.lit(2.0)).alias("p")).first().p
        assert abs(got - (1 - t / math.sqrt(t * t + 2))) < 1e-9


AWKWARD = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308,
           -1.7976931348623157e308, math.inf, -math.inf, 0.1, 1 - 2 ** -53, 1 + 2 ** -52, 2.0 ** 52, 2.0 ** 53 - 1, 1e22, 123456.78, 1e-300]


def test_ordered_long_orders_and_returns_every_double(spark):
    rnd = random.Random(11)
    values = AWKWARD + [rnd.uniform(-1, 1) * 10.0 ** rnd.randint(-320, 308) for _ in range(3000)] + [2.0 ** e for e in range(-1074, 1024, 7)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered_long(F.col("v")).alias("k")).collect()
    assert all(double_of(r.k) == r.v for r in got)
    assert [r.k for r in sorted(got, key=lambda r: r.v)] == sorted(r.k for r in got)
    nan = spark.createDataFrame([(math.nan,)], "v double").select(ordered_long(F.col("v")).alias("k")).first().k
    assert nan > max(r.k for r in got) and math.isnan(double_of(nan))


def test_selection_of_awkward_values_takes_few_passes(spark):
    rnd = random.Random(5)
    values = AWKWARD + [math.nan] * 2 + [rnd.uniform(-1, 1) * 10.0 ** rnd.randint(-320, 308) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    order = sorted(values, key=lambda v: (math.isnan(v), v if v == v else 0))
    ranks = [0, 1, 17, 2000, len(values) // 2, len(values) - 3, len(values) - 1]
    keys, n, passes = select_keys(df, [ordered_long(F.col("v"))], ranks)
    assert n == len(values) and [repr(double_of(k)) for k, in keys] == [repr(order[r] + 0.0) for r in ranks]
    assert passes <= 7  # the bounds, then six times twelve bits at most
    # a full 64-bit spread of integers
    wide = [-(2 ** 63), 2 ** 63 - 1, 0, -1, 1] + [rnd.randint(-(2 ** 63), 2 ** 63 - 1) for _ in range(2000)]
    keys, _, passes = select_keys(spark.createDataFrame([(v,) for v in wide], "v long"), [F.col("v")], range(0, 2005, 401))
    assert [k for k, in keys] == sorted(wide)[::401] and passes <= 7


def test_selection_settles_ties_by_the_next_key(spark):
    rows = [(5 if i % 3 else i, i * 7919 % 3001) for i in range(3000)]  # two thirds share one value
    df = spark.createDataFrame(rows, "a long, b long")
    ranks = [0, 500, 1500, 2500, 2999]
    for buckets in (2, 4096):
        keys, _, _ = select_keys(df, [F.col("a"), F.col("b")], ranks, buckets)
        assert keys == [sorted(rows)[r] for r in ranks]


def test_selection_is_planned_as_hash_aggregates(spark):
    rows = spark.createDataFrame([(1.5,)], "v double").select(ordered_long(F.col("v")).alias("k"))
    plan = physical_plan(rows.groupBy(F.shiftright("k", 40).alias("bucket")).agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")))
    assert "HashAggregate" in plan and "Sort" not in plan and "ObjectHash" not in plan


def test_frequency_bins_equal_bins_of_ranks(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, 1, 2, 2, 3]), rnd.choice([5, 5, 5, 5, 6])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a long, b long")
    ids = order_keys("id")
    binned, bins = frequency_bins(df, {"ra": [*order_keys("a", descending=True), *ids], "rb": [*order_keys("b"), *ids]})
    got = {r.id: (r.ra, r.rb) for r in binned.collect()}
    n = len(rows)

    def expected(order):
        return {i: max(1, (rank * 5 + n - 2) // (n - 1)) for rank, (i, _, _) in enumerate(order)}

    ra = expected(sorted(rows, key=lambda t: (t[1] is None, -(t[1] or 0), t[0])))
    rb = expected(sorted(rows, key=lambda t: (t[2], t[0])))
    assert bins == 5 and got == {i: (ra[i], rb[i]) for i, _, _ in rows}
    assert "Exchange" not in physical_plan(binned) and "Sort" not in physical_plan(binned)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7])
def test_frequency_bins_of_few_rows(spark, n):
    df = spark.range(n).select(F.col("id").alias("v"))
    binned, bins = frequency_bins(df, {"b": [F.col("v")]})
    assert bins == max(1, min(5, n))
    assert [r.b for r in binned.orderBy("v").collect()] == [max(1, (i * min(5, n) + n - 2) // (n - 1)) if n > 1 else 1 for i in range(n)]


def test_decimal_keys_order_exact_sums(spark):
    values = ["-123456789012345678901.2345", "-1.0001", "-1.0000", "0.0000", "0.0001", "99999999.9999", "100000000.0000", "123456789012345678901.2345", None]
    df = spark.createDataFrame([(v,) for v in values], "s string").select(F.col("s").cast("decimal(38,4)").alias("d"))
    keys = [tuple(r) for r in df.select("d", *[k.alias(f"k{i}") for i, k in enumerate(decimal_keys("d"))]).collect()]
    order = sorted(keys, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[1:] for r in order] == sorted(r[1:] for r in keys) and len({r[1:] for r in keys}) == len(values)
