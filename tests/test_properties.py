"""Properties on the adapter data (sf0.001): sums that must agree, permutations, monotone filters."""

from pyspark.sql import functions as F

from marketlens.model import FilterSpec
from marketlens.operators.filters import apply_filters
from marketlens.plans import charts as CH
from marketlens.plans import kpis as K
from marketlens.plans import segments as SG
from marketlens.plans.registry import KPI_CONFIG


def test_city_gmv_sums_to_gmv(small):
    gmv = K.kpi_revenue(small, KPI_CONFIG).first().gmv
    daily = CH.gmv_trend_daily(small).agg(F.sum("gmv")).first()[0]
    cities = CH.city_perf(small).agg(F.sum("orders")).first()[0]
    delivered = small.orders.where(F.col("order_status") == "Delivered").count()
    assert abs(daily - gmv) < 1e-6 * gmv and cities == delivered


def test_cohort_sizes_sum_to_users(small):
    sizes = SG.cohort_retention(small).select("cohort_month", "cohort_size").distinct().agg(F.sum("cohort_size")).first()[0]
    users_with_signup = small.users.where(F.col("signup_date").isNotNull()).count()
    assert sizes <= users_with_signup
    assert CH.channel_acq(small).agg(F.sum("new_users")).first()[0] == small.users.count()


def test_segments_partition_users(small):
    rfm = SG.rfm_scores(small)
    n = rfm.count()
    assert n == small.orders.select("user_id").distinct().count()
    assert SG.segment_summary(small).agg(F.sum("users")).first()[0] == n
    for score in ("R_score", "F_score", "M_score"):
        counts = [r["count"] for r in rfm.groupBy(score).count().collect()]
        assert max(counts) - min(counts) <= 1 + n // 5  # equal-frequency bins (ties broken by id)


def test_adding_a_filter_never_adds_orders(small):
    base = apply_filters(small, FilterSpec(cuisines=["Italian", "Bakery"])).orders.count()
    more = apply_filters(small, FilterSpec(cuisines=["Italian", "Bakery"], devices=["Android"])).orders.count()
    most = apply_filters(small, FilterSpec(cuisines=["Italian", "Bakery"], devices=["Android"], genders=["Female"])).orders.count()
    assert base >= more >= most


def test_demographic_gmv_adds_up(small):
    # the charts join orders with users: those without one have no label
    total = K.kpi_revenue(small.with_(orders=small.orders.where("user_id IS NOT NULL")), KPI_CONFIG).first().gmv
    for chart in (CH.demo_gender, CH.demo_age_group, CH.demo_profession, CH.demo_income_bracket):
        whole = chart(small).agg(F.sum("gmv").alias("gmv"), F.sum("gmv_share").alias("share")).first()
        assert abs(whole.gmv - total) < 1e-6 * total and abs(whole.share - 100) < 1e-4
    cross = CH.gender_age_cross(small)
    bands = [c for c in cross.columns if c != "gender"]
    assert abs(cross.select(sum(F.col(f"`{b}`") for b in bands).alias("s")).agg(F.sum("s")).first()[0] - total) < 1e-6 * total


def test_kpi_all_is_complete(small):
    rows = K.kpi_all(small, KPI_CONFIG).collect()
    assert len(rows) == 61 and len({(r.family, r.kpi) for r in rows}) == 61


def test_growth_trend_series_equal_standalone_charts(small):
    got = {(r.period, r.value) for r in CH.growth_trend(small, "GMV", "Monthly").collect()}
    want = {(r.order_month, r.gmv) for r in CH.gmv_trend(small).collect()}
    assert got == want
    got = {(r.period, r.value) for r in CH.growth_trend(small, "Orders", "Daily").collect()}
    want = {(str(r.order_date), float(r.orders)) for r in CH.orders_trend_daily(small).collect()}
    assert got == want
