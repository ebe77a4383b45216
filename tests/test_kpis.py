"""KPI families, charts and segments on tiny hand-written marketplaces with known answers."""

import datetime as dt

import pytest

from marketlens.model import FilterSpec, KpiConfig
from marketlens.operators.clean import clean
from marketlens.operators.filters import apply_filters, require_kpi_ready
from marketlens.plans import charts as CH
from marketlens.plans import kpis as K
from marketlens.plans import segments as SG
from tests.builders import raw_marketplace

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def _m(spark, **kw):
    return clean(raw_marketplace(spark, **kw), stage=False)


def test_revenue_and_operations(spark):
    orders = [
        dict(order_id=1, user_id=1, order_value=100.0, commission_rate=0.2, delivery_fee=10.0, delivery_cost_to_rider=30.0,
             payment_gateway_fee=2.0, discount_amount=5.0),
        dict(order_id=2, user_id=2, order_value=300.0, commission_rate=0.1, delivery_fee=20.0, delivery_cost_to_rider=40.0,
             payment_gateway_fee=6.0, discount_amount=0.0, wrong_item_flag=1, delivered_time="2024-01-10 12:50:30"),
        dict(order_id=3, user_id=2, order_status="Cancelled", order_value=50.0, cancel_reason="Long wait time",
             delivered_time=None, ready_time=None),
    ]
    m = _m(spark, users=[dict(user_id=1), dict(user_id=2), dict(user_id=3)], orders=orders)
    r = K.kpi_revenue(m).first()
    assert r.gmv == 400.0 and r.aov == 200.0
    assert r.arpu == pytest.approx((20 + 30 + 30) / 3) and r.arppu == pytest.approx(80 / 2)
    assert r.take_rate == pytest.approx(50 / 400 * 100)
    assert r.avg_contribution_margin == pytest.approx(((20 + 10 - 30 - 2 - 5) + (30 + 20 - 40 - 6)) / 2)
    o = K.kpi_operations(m).first()
    assert o.cancellation_rate == pytest.approx(100 / 3)
    assert o.avg_delivery_time == pytest.approx((40 + 50) / 2)  # whole minutes, 50:30 truncates to 50
    assert o.on_time_rate == 50.0 and o.order_accuracy_rate == 50.0 and o.cost_per_delivery == 35.0
    a = K.kpi_acquisition(m).first()
    assert a.activation_rate == pytest.approx(200 / 3)


def test_sessions_and_funnel(spark):
    ev = [(1, "s1", 1, "app_open", T0, "iOS"), (2, "s1", 1, "menu_view", T0 + dt.timedelta(seconds=90), "iOS"),
          (3, "s2", 2, "app_open", T0, "iOS"), (4, "s2", 2, "add_to_cart", T0, "iOS")]
    m = _m(spark, users=[dict(user_id=1), dict(user_id=2)], orders=[dict(order_id=1, user_id=1)], events=ev)
    e = K.kpi_engagement(m).first()
    assert e.avg_session_duration_sec == 45.0  # 90 s and a single-instant session (0 s)
    assert e.avg_session_frequency == 1.0
    f = {r.event_name: (r.sessions, r.conversion_from_top_pct) for r in CH.funnel_counts(m).collect()}
    assert f == {"app_open": (2, 100.0), "menu_view": (1, 50.0), "add_to_cart": (1, 50.0),
                 "checkout_started": (0, 0.0), "payment_completed": (0, 0.0)}
    c = K.kpi_conversion(m).first()
    assert c.menu_to_cart_rate == 100.0 and c.cart_abandonment == 100.0 and c.visitor_to_order_conv == 50.0


def test_restaurant_churn_halves(spark):
    orders = [dict(order_id=1, user_id=1, restaurant_id=1, order_placed_time="2025-03-01 10:00:00"),  # H1 only
              dict(order_id=2, user_id=1, restaurant_id=2, order_placed_time="2025-08-01 10:00:00"),  # H2 only
              dict(order_id=3, user_id=1, restaurant_id=3, order_placed_time="2025-03-01 10:00:00"),  # both
              dict(order_id=4, user_id=1, restaurant_id=3, order_placed_time="2025-09-01 10:00:00")]
    m = _m(spark, users=[dict(user_id=1)], orders=orders)
    g = K.kpi_marketplace(m, KpiConfig()).first()
    assert g.restaurant_churn_rate == 50.0 and g.active_restaurants == 3 and g.total_restaurants == 3
    assert g.top10_share == 100.0


def test_ab_one_group_only(spark):
    orders = [dict(order_id=i, user_id=1, order_value=100.0 + i) for i in range(1, 5)]
    r = K.kpi_ab_test(_m(spark, users=[dict(user_id=1)], orders=orders)).first()
    assert r.ab_available is False and r.ab_p1 is None and r.ab_p_value_aov is None


def test_ab_zero_variance_gives_null_p(spark):
    orders = [dict(order_id=i, user_id=1, order_value=100.0, ab_test_group="Control") for i in range(1, 4)]
    orders += [dict(order_id=i, user_id=2, order_value=100.0, ab_test_group="Treatment") for i in range(4, 7)]
    r = K.kpi_ab_test(_m(spark, users=[dict(user_id=1), dict(user_id=2)], orders=orders)).first()
    assert r.ab_available is True and r.ab_p_value_aov is None and r.ab_p_value_completion == 1.0


def test_ab_direction(spark):
    # treatment: higher completion and basket -> both p small with enough rows
    orders = []
    for i in range(400):
        orders.append(dict(order_id=i, user_id=1, ab_test_group="Control", order_value=100.0 + i % 7,
                           order_status="Delivered" if i % 10 < 6 else "Cancelled"))
        orders.append(dict(order_id=1000 + i, user_id=2, ab_test_group="Treatment", order_value=110.0 + i % 7,
                           order_status="Delivered" if i % 10 < 9 else "Cancelled"))
    m = _m(spark, users=[dict(user_id=1), dict(user_id=2)], orders=orders)
    r = K.kpi_ab_test(m).first()
    assert r.ab_p2 > r.ab_p1 and r.ab_treat_aov_mean > r.ab_control_aov_mean
    assert r.ab_p_value_completion < 1e-6 and r.ab_p_value_aov < 1e-6
    v = K.ab_verdict(m).first()
    assert v.completion_p_text == "< 0.0001" and v.both_significant is True


@pytest.mark.parametrize("n", [1, 3, 5, 7])
def test_rfm_small_populations(spark, n):
    users = [dict(user_id=i) for i in range(1, n + 1)]
    orders = [dict(order_id=100 * u + k, user_id=u, order_value=10.0 * u,
                   order_placed_time=f"2024-01-{10 + u:02d} 12:00:00") for u in range(1, n + 1) for k in range(u)]
    rfm = {r.user_id: r for r in SG.rfm_scores(_m(spark, users=users, orders=orders)).collect()}
    assert len(rfm) == n
    bins = min(5, n)
    assert {r.F_score for r in rfm.values()} <= set(range(1, bins + 1))
    if n == 1:
        assert rfm[1].segment_label == "Champions"  # one bin: both fractions are 1.0
    if n == 7:
        assert [rfm[u].F_score for u in range(1, 8)] == [1, 1, 2, 3, 4, 5, 5]
        assert rfm[7].segment_label == "Champions" and rfm[1].segment_label == "Lost / Hibernating"
    summary = SG.segment_summary(_m(spark, users=users, orders=orders)).collect()
    assert sum(r.users for r in summary) == n


def test_empty_slice_guard(spark):
    m = _m(spark, users=[dict(user_id=1)], orders=[dict(order_id=1, user_id=1, order_status="Cancelled")])
    with pytest.raises(ValueError, match="delivered"):
        require_kpi_ready(m)
    s = apply_filters(m, FilterSpec(cities=["Nowhere"]))
    with pytest.raises(ValueError, match="no order or no user"):
        require_kpi_ready(s)


def test_cascade_keeps_population_consistent(spark):
    users = [dict(user_id=1, gender="Female"), dict(user_id=2, gender="Male"), dict(user_id=3, gender="Female")]
    orders = [dict(order_id=1, user_id=1), dict(order_id=2, user_id=2), dict(order_id=3, user_id=2, city="Goa")]
    nps = [(1, 1, "2024-01-01", 9), (2, 2, "2024-01-01", 3), (3, 3, "2024-01-01", 10)]
    m = _m(spark, users=users, orders=orders, nps=nps)
    s = apply_filters(m, FilterSpec(genders=["Female"]))
    assert sorted(r.order_id for r in s.orders.collect()) == [1]
    assert sorted(r.user_id for r in s.users.collect()) == [1]  # user 3 has no orders: dropped
    assert sorted(r.response_id for r in s.nps.collect()) == [1]
    none = apply_filters(m, FilterSpec())
    assert none.users.count() == 2  # always narrowed to users with orders
    more = apply_filters(m, FilterSpec(genders=["Female"], cities=["Goa"]))
    assert more.orders.count() <= s.orders.count()


def test_retention_windows(spark):
    orders = [dict(order_id=1, user_id=1, order_placed_time="2024-01-01 10:00:00"),
              dict(order_id=2, user_id=1, order_placed_time="2024-01-05 10:00:00"),   # day 4: d7 and d30
              dict(order_id=3, user_id=2, order_placed_time="2024-01-01 10:00:00"),
              dict(order_id=4, user_id=2, order_placed_time="2024-01-20 10:00:00"),   # day 19: d30 only
              dict(order_id=5, user_id=3, order_placed_time="2024-01-01 09:00:00"),
              dict(order_id=6, user_id=3, order_placed_time="2024-01-01 18:00:00")]   # same day: neither
    m = _m(spark, users=[dict(user_id=u) for u in range(1, 5)], orders=orders)
    r = K.kpi_retention(m).first()
    assert (r.d7, r.d30, r.churn_d30) == (25.0, 50.0, 50.0)
    assert r.repeat_rate == 100.0 and r.order_frequency_retained == 0.0


def test_public_api_round_trip(spark, small):
    from marketlens import api

    kpi, charts = api.compute_all_kpis(api.filter_data(small, cuisines=["Italian"]))
    row = kpi.first().asDict()
    assert len(row) == 61 and row["gmv"] > 0
    assert set(charts["demo_breakdown"]) == {"gender", "age_group", "profession", "income_bracket"}
    assert charts["cohort_matrix"].count() > 0
    empty = api.filter_data(small, cities=["Nowhere"])
    with pytest.raises(ValueError):
        api.compute_all_kpis(empty)


def test_session_rollup(spark):
    from marketlens.operators.rollups import session_rollup

    ev = [(1, "s1", 1, "app_open", T0, "iOS"), (2, "s1", 1, "menu_view", T0 + dt.timedelta(seconds=75), "iOS"),
          (3, "s2", 2, "app_open", T0, "iOS")]
    m = _m(spark, users=[dict(user_id=1)], orders=[dict(order_id=1, user_id=1)], events=ev)
    got = {r.session_id: r.duration_sec for r in session_rollup(m.events).collect()}
    assert got == {"s1": 75, "s2": 0}


def test_top10_share_bucketed_matches_brute_force(spark):
    import random as _random

    rnd = _random.Random(11)
    orders = [dict(order_id=i, user_id=1, restaurant_id=rnd.randint(1, 60), order_value=float(rnd.choice([100, 200, 200, 350])))
              for i in range(1, 400)]
    rest = [(r, f"r{r}", "Italian", "Pune", "2023-01-01", 0.2, 4.0) for r in range(1, 61)]
    m = _m(spark, users=[dict(user_id=1)], orders=orders, restaurants=rest)
    per = {}
    for o in orders:
        per[o["restaurant_id"]] = per.get(o["restaurant_id"], 0.0) + o["order_value"]
    want = sum(sorted(per.values(), reverse=True)[:10]) / sum(per.values()) * 100
    got = K.kpi_marketplace(m).first().top10_share
    assert got == pytest.approx(want, rel=1e-12)
