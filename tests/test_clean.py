"""Cleaning jobs on hand-written dirty rows (every dirt pattern of the reference's generator)."""

import datetime as dt

from pyspark.sql import functions as F

from marketlens.operators.clean import clean, clean_events, clean_nps, clean_users, ensure_bool, order_value_fence
from marketlens.operators.dedup import keep_first
from tests.builders import raw_marketplace


def test_keep_first_uses_declared_order(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (2, None, 1), (2, "z", 0)], "k long, s string, v long")
    out = {r.k: (r.s, r.v) for r in keep_first(df, "k").collect()}
    assert out == {1: ("a", 9), 2: ("z", 0)}  # smallest by remaining columns, nulls last
    out = {r.k: (r.s, r.v) for r in keep_first(df, "k", ["v"]).collect()}
    assert out == {1: ("b", 2), 2: ("z", 0)}


def test_clean_users_dirt(spark):
    m = raw_marketplace(spark, users=[
        dict(user_id=1, city="  PUNE ", gender="male", profession="self-employed", signup_date="05/03/2024", age=None),
        dict(user_id=1, city="  PUNE ", gender="male", profession="self-employed", signup_date="05/03/2024", age=None),
        dict(user_id=2, city="delhi ncr", gender=None, profession=None, device_type=None, age=20, signup_date="junk"),
        dict(user_id=3, age=40, income_bracket=None, is_subscriber=1),
        dict(user_id=4, age=60),
    ])
    out = {r.user_id: r for r in clean_users(m.users).collect()}
    assert len(out) == 4
    assert out[1].city == "Pune" and out[1].gender == "Male" and out[1].profession == "Self-Employed"
    assert out[1].signup_date == dt.date(2024, 3, 5)
    assert out[1].age == 40.0 and out[1].age_group == "35-44"  # median of 20, 40, 60
    assert out[2].city == "Delhi Ncr" and out[2].gender == "Unknown" and out[2].profession == "Unknown"
    assert out[2].device_type == "Unknown" and out[2].signup_date is None and out[2].age_group == "18-24"
    assert out[3].income_bracket == "Unknown" and out[3].is_subscriber is True and out[4].age_group == "55+"


def test_missing_demographic_columns_become_unknown(spark):
    m = raw_marketplace(spark, users=[dict(user_id=1)])
    users = m.users.drop("gender", "profession", "income_bracket")
    r = clean_users(users).first()
    assert (r.gender, r.profession, r.income_bracket) == ("Unknown", "Unknown", "Unknown")


def test_flags_as_int_and_string(spark):
    df = spark.createDataFrame([(1, "1"), (0, "0"), (None, "x")], "a int, b string")
    out = ensure_bool(df, ["a", "b", "missing"]).collect()
    assert [(r.a, r.b) for r in out] == [(True, True), (False, False), (None, None)]


def test_clean_orders_fence_fee_and_parse(spark):
    orders = [dict(order_id=i, user_id=1, order_value=float(v)) for i, v in enumerate([10, 20, 30, 40, 50, 60, 70, 80], 1)]
    orders += [dict(order_id=9, user_id=1, order_value=10000.0, delivery_fee=-15.0, payment_method="cash on delivery"),
               dict(order_id=10, user_id=1, order_value=None),
               dict(order_id=11, user_id=1, order_value=55.0, order_placed_time="not a time"),
               dict(order_id=1, user_id=1, order_value=10.0)]  # duplicate of order 1
    m = clean(raw_marketplace(spark, users=[dict(user_id=1)], orders=orders))
    out = {r.order_id: r for r in m.orders.collect()}
    assert sorted(out) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 11]
    # 10 values: q1 at position round(9 * .25) = 2 -> 30, q3 at round(6.75) = 7 -> 70; fence 70 + 60 = 130
    assert out[9].order_value == 130.0 and out[9].delivery_fee == 15.0
    assert out[9].payment_method == "Cash On Delivery"
    assert out[11].order_placed_time is None and out[11].order_date is None
    assert out[1].order_date == dt.date(2024, 1, 10) and out[1].order_month == "2024-01"
    assert out[1].is_promo_used is False


def test_fence_row(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 9)], "order_value double")
    r = order_value_fence(df).first()
    assert (r.q1, r.q3, r.upper_fence) == (3.0, 6.0, 10.5)


def test_events_distinct_and_nps_range(spark):
    t = dt.datetime(2024, 1, 1, 10, 0, 0)
    ev = spark.createDataFrame([(1, "s", 1, "app_open", t, "iOS")] * 3 + [(2, "s", 1, "menu_view", t, "iOS")],
                               "event_id long, session_id string, user_id long, event_name string, event_time timestamp_ntz, device_type string")
    assert clean_events(ev).count() == 2
    nps = spark.createDataFrame([(1, 1, "2024-01-01", 10), (1, 1, "2024-01-01", 10), (2, 2, "bad", 11), (3, 3, "2024-02-30", -1),
                                 (4, 4, "2024-02-01", 0)], "response_id long, user_id long, response_date string, nps_score long")
    out = {r.response_id: r for r in clean_nps(nps).collect()}
    assert sorted(out) == [1, 4] and out[4].response_date == dt.date(2024, 2, 1)


def test_cleaning_users_is_idempotent(spark):
    m = raw_marketplace(spark, users=[dict(user_id=i, gender=g, age=None if i == 3 else 20 + i)
                                      for i, g in enumerate(["male", " Female", None, "other"])])
    once = clean_users(m.users)
    twice = clean_users(once.drop("age_group"))
    cols = sorted(once.columns)
    assert sorted(map(tuple, once.select(cols).collect())) == sorted(map(tuple, twice.select(cols).collect()))


def test_null_key_kept_once(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c")], "k long, s string")
    assert keep_first(df, "k").where(F.col("k").isNull()).count() == 1
