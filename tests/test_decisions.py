"""One test per semantic decision taken where the reference looks like it has a defect."""

import datetime as dt

import pytest

from marketlens.model import FilterSpec, KpiConfig
from marketlens.operators.clean import clean, clean_users
from marketlens.operators.filters import apply_filters, filter_options
from marketlens.plans import kpis as K
from marketlens.plans import segments as SG
from tests.builders import raw_marketplace


def _m(spark, **kw):
    return clean(raw_marketplace(spark, **kw), stage=False)


def test_population_always_narrowed_but_kpis_callable_unfiltered(spark):
    m = _m(spark, users=[dict(user_id=1), dict(user_id=2)], orders=[dict(order_id=1, user_id=1)])
    assert K.kpi_acquisition(m).first().activation_rate == 50.0            # meaningful on the unfiltered tables
    s = apply_filters(m, FilterSpec())
    assert K.kpi_acquisition(s).first().activation_rate == 100.0           # the dashboard slice: users with orders


def test_ltv_counts_all_statuses_unless_asked(spark):
    orders = [dict(order_id=1, user_id=1, order_value=100.0, commission_rate=0.1, delivery_fee=0.0,
                   delivery_cost_to_rider=0.0, payment_gateway_fee=0.0),
              dict(order_id=2, user_id=1, order_value=100.0, commission_rate=0.1, delivery_fee=0.0,
                   delivery_cost_to_rider=0.0, payment_gateway_fee=0.0, order_status="Cancelled")]
    m = _m(spark, users=[dict(user_id=1)], orders=orders)
    assert K.kpi_retention(m).first().avg_ltv == 20.0
    assert K.kpi_retention(m, KpiConfig(ltv_delivered_only=True)).first().avg_ltv == 10.0
    assert K.kpi_revenue(m).first().avg_contribution_margin == 10.0       # margin: delivered only


def test_constants_are_parameters(spark):
    m = _m(spark, users=[dict(user_id=1), dict(user_id=2, signup_date="2024-02-01")],
           orders=[dict(order_id=1, user_id=1), dict(order_id=2, user_id=2)])
    base = K.kpi_acquisition(m).first().cac
    assert base == 50_000 * 2 / 2
    assert K.kpi_acquisition(m, KpiConfig(monthly_marketing_spend=1000)).first().cac == 1000.0
    assert K.kpi_clv(m, KpiConfig(lifespan_years=4.0)).first().assumed_lifespan_years == 4.0


def test_all_null_age_falls_into_last_band(spark):
    m = raw_marketplace(spark, users=[dict(user_id=1, age=None), dict(user_id=2, age=None)])
    assert {r.age_group for r in clean_users(m.users).collect()} == {"55+"}


def test_filter_options_skip_nulls(spark):
    m = _m(spark, users=[dict(user_id=1)], orders=[dict(order_id=1, user_id=1, city=None), dict(order_id=2, user_id=1)])
    cities = [r.value for r in filter_options(m).where("dimension = 'cities'").collect()]
    assert cities == ["Pune"]


def test_date_range_drops_orders_without_a_date(spark):
    m = _m(spark, users=[dict(user_id=1)],
           orders=[dict(order_id=1, user_id=1), dict(order_id=2, user_id=1, order_placed_time="garbage")])
    s = apply_filters(m, FilterSpec(date_range=(dt.date(2000, 1, 1), dt.date(2100, 1, 1))))
    assert [r.order_id for r in s.orders.collect()] == [1]


def test_empty_sums_are_zero_not_null(spark):
    m = _m(spark, users=[dict(user_id=1)], orders=[dict(order_id=1, user_id=1, order_status="Failed")])
    r = K.kpi_revenue(m).first()
    assert r.gmv == 0.0 and r.aov is None and r.take_rate is None       # 0 / 0 -> null, never an error


def test_split_date_is_a_parameter(spark):
    orders = [dict(order_id=1, user_id=1, restaurant_id=1, order_placed_time="2024-01-10 10:00:00"),
              dict(order_id=2, user_id=1, restaurant_id=2, order_placed_time="2024-06-10 10:00:00")]
    m = _m(spark, users=[dict(user_id=1)], orders=orders)
    assert K.kpi_marketplace(m).first().restaurant_churn_rate == 100.0   # default split: both are first-half only
    assert K.kpi_marketplace(m, KpiConfig(split_date=dt.date(2024, 3, 1))).first().restaurant_churn_rate == 100.0
    assert K.kpi_marketplace(m, KpiConfig(split_date=dt.date(2024, 1, 1))).first().restaurant_churn_rate == 0.0


def test_cohort_matrix_is_a_full_grid(spark):
    orders = [dict(order_id=i, user_id=1, order_placed_time=f"2024-{m:02d}-10 10:00:00") for i, m in enumerate([1, 3, 11], 1)]
    m = _m(spark, users=[dict(user_id=1, signup_date="2024-01-01")], orders=orders)
    grid = {r.month_offset: r.retention_pct for r in SG.cohort_matrix(m).collect()}
    assert grid == {i: 100.0 if i in (0, 2, 10) else None for i in range(11)}
    heat = SG.cohort_heat(m).first()
    assert heat.heat_cols == list(range(11)) and heat.heat_data == [grid[i] for i in range(11)]


def test_orders_without_user_cannot_return(spark):
    """30 guest orders over two months: a customer in the counts, but neither retained nor frequent."""
    orders = [dict(order_id=i, user_id=None, order_placed_time=f"2024-01-{i % 28 + 1:02d} 10:00:00") for i in range(1, 31)]
    orders += [dict(order_id=100, user_id=None, order_placed_time="2024-02-10 10:00:00")]
    orders += [dict(order_id=101, user_id=1, order_placed_time="2024-01-01 10:00:00"),
               dict(order_id=102, user_id=1, order_placed_time="2024-03-01 10:00:00"),
               dict(order_id=103, user_id=2, order_placed_time="2024-01-01 10:00:00")]
    m = _m(spark, users=[dict(user_id=1), dict(user_id=2)], orders=orders)
    k = K.kpi_retention(m).first()
    assert k.d7 == 0 and k.d30 == 0 and k.churn_d30 == 100
    assert k.order_frequency_retained == 1.0  # two orders of user 1 over two retained groups, one without a user


@pytest.mark.parametrize("mode,expected", [("reference", "2024-W01"), ("iso", "2025-W01")])
def test_week_key_mode(spark, mode, expected):
    orders = [dict(order_id=1, user_id=1, order_placed_time="2024-12-30 10:00:00")]
    m = _m(spark, users=[dict(user_id=1)], orders=orders)
    assert K.kpi_engagement(m, KpiConfig(week_key=mode)).first().avg_wau == 1.0
    from marketlens.functions.dates import week_key
    assert m.orders.select(week_key("order_date", mode).alias("w")).first().w == expected


def test_first_order_flag_for_orders_without_user(spark):
    orders = [dict(order_id=1, user_id=None, order_placed_time="2024-01-02 10:00:00"),
              dict(order_id=2, user_id=None, order_placed_time="2024-01-01 10:00:00"),
              dict(order_id=3, user_id=5)]
    m = _m(spark, users=[dict(user_id=5)], orders=orders)
    flags = {r.order_id: r.is_first_order for r in SG.first_order_flag(m).collect()}
    assert flags == {1: False, 2: True, 3: True}


def test_filters_active_flag(spark):
    from marketlens.operators.filters import filters_active

    orders = [dict(order_id=1, user_id=1, order_placed_time="2024-01-10 10:00:00"),
              dict(order_id=2, user_id=1, order_placed_time="2024-03-10 10:00:00")]
    m = _m(spark, users=[dict(user_id=1)], orders=orders)
    full = (dt.date(2024, 1, 10), dt.date(2024, 3, 10))
    assert filters_active(m, FilterSpec()).first().filtered is False
    assert filters_active(m, FilterSpec(date_range=full)).first().filtered is False     # the full range is no filter
    assert filters_active(m, FilterSpec(date_range=(dt.date(2024, 2, 1), full[1]))).first().filtered is True
    assert filters_active(m, FilterSpec(devices=["iOS"])).first().filtered is True
