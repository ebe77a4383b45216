"""One user holding a third of all orders: results stay exact and no step funnels the hot key into one task."""

import pytest
from pyspark.sql import functions as F

from marketlens.model import KpiConfig
from marketlens.operators.clean import clean
from marketlens.operators.dedup import keep_first
from marketlens.operators.rank import ordinal_rank
from marketlens.plans import kpis as K
from marketlens.plans import segments as SG
from marketlens.plans.inspect import physical_plan
from marketlens.sources.adapter import load_raw
from tests.conftest import SF_SMALL

HOT = 1


@pytest.fixture(scope="module")
def skewed(spark):
    raw = load_raw(spark, SF_SMALL)
    orders = raw.orders.withColumn("user_id", F.when(F.col("order_id") % 3 == 0, F.lit(HOT)).otherwise(F.col("user_id")))
    return clean(raw.with_(orders=orders), stage=False)


@pytest.fixture(scope="module")
def pdf(skewed):
    return skewed.orders.select("order_id", "user_id", "order_placed_time", "order_date", "order_value").toPandas()


def test_hot_user_holds_a_third(pdf):
    assert (pdf.user_id == HOT).mean() > 0.3


def test_first_order_flag_exact(skewed, pdf):
    got = {r.order_id for r in SG.first_order_flag(skewed).where("is_first_order").collect()}
    # orders without a user form one group, whose earliest order is flagged too
    first = pdf.sort_values(["user_id", "order_placed_time", "order_id"]).groupby("user_id", dropna=False).head(1)
    assert got == set(first.order_id)


def test_retention_exact(skewed, pdf):
    named = pdf[pdf.user_id.notna()]  # orders without a user cannot return
    firsts = named.groupby("user_id").order_date.transform("min")
    offset = (named.order_date - firsts).apply(lambda d: d.days)
    d7 = named[(offset >= 1) & (offset <= 7)].user_id.nunique()
    n_users = skewed.users.count()
    r = K.kpi_retention(skewed, KpiConfig()).first()
    assert r.d7 == d7 / n_users * 100


def test_rfm_frequency_bins_follow_ranks(skewed, pdf):
    rfm = SG.rfm_scores(skewed).toPandas()
    def users(ids):
        return [None if u != u else int(u) for u in ids]

    sizes = pdf.groupby("user_id", dropna=False).size()
    counts = dict(zip(users(sizes.index), sizes))
    assert None in counts  # orders without a user are one group, ranked before the ids it ties with
    assert dict(zip(users(rfm.user_id), rfm.frequency)) == counts
    order = sorted(counts.items(), key=lambda kv: (kv[1], kv[0] is not None, kv[0] or 0))
    n = len(order)
    expected = {u: max(1, ((i * 5) + n - 2) // (n - 1)) for i, (u, _) in enumerate(order)}
    assert dict(zip(users(rfm.user_id), rfm.F_score)) == expected


def test_range_partitioning_splits_the_hot_value(spark):
    rows = [(i, 7 if i % 3 else i) for i in range(30_000)]  # two thirds share one value
    df = spark.createDataFrame(rows, "id long, v long")
    sizes = [r["count"] for r in df.repartitionByRange(8, "v", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * (30_000 / 8)
    ranked = ordinal_rank(df, [F.asc("v"), F.asc("id")], "r", partitions=8)
    assert ranked.agg(F.min("r"), F.max("r"), F.count_distinct("r")).first() == (1, 30_000, 30_000)


def test_hot_duplicate_key_is_collapsed_map_side(spark):
    df = spark.range(0, 10_000).select((F.col("id") % 3 == 0).cast("long").alias("k"), F.lit("x").alias("s"))
    plan = physical_plan(keep_first(df, "k"))
    partial = plan.find("partial_min")
    assert partial > 0 and plan.find("Exchange") < partial  # the partial aggregate sits below the shuffle


def test_periods_exact_under_skew(skewed, pdf):
    dau = pdf.groupby("order_date").user_id.nunique(dropna=False).mean()  # null counts as one value
    r = K.kpi_engagement(skewed, KpiConfig()).first()
    assert r.avg_dau == pytest.approx(dau, rel=1e-12)
