"""Adapter from the star-schema test tables to the six marketplace tables (raw, dirty layer).

One SQL text per table, written in the dialect subset that Spark SQL and DuckDB share, so the
same text feeds the Spark engine and the DuckDB oracle. Placeholders in braces name the input
tables; Spark binds them to DataFrames (``spark.sql(text, **frames)``), the oracle to view names.

Dirt is injected deterministically from the keys: padded and lower-case cities, null devices,
``dd/mm/yyyy`` signup dates, null ages, lower-case genders and professions, negative fees, null and
x20 order values, lower-case payment methods, invalid NPS scores, exact duplicate rows, copies of
orders that lack their value, orders without a user, commission rates with six decimals. No input row
is dropped: orders without line items have 0 items and no restaurant or city.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_USERS = """
WITH u AS (
  SELECT c.c_custkey AS k, c.c_name, c.c_mktsegment, c.c_acctbal, n.n_name,
         cast(date '1995-01-01' + interval '1' day * cast(c.c_custkey % 900 AS int) AS date) AS d
  FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
), r AS (
  SELECT k AS user_id,
    c_name AS user_name,
    CASE WHEN k % 33 = 0
         THEN lpad(cast(day(d) AS string), 2, '0') || '/' || lpad(cast(month(d) AS string), 2, '0') || '/' || cast(year(d) AS string)
         ELSE cast(d AS string) END AS signup_date,
    c_mktsegment AS acquisition_channel,
    CASE WHEN k % 10 = 0 THEN ' ' || n_name || ' ' WHEN k % 10 = 1 THEN lower(n_name) ELSE n_name END AS city,
    CASE WHEN k % 20 = 0 THEN NULL WHEN k % 2 = 0 THEN 'Android' ELSE 'iOS' END AS device_type,
    CASE WHEN k % 50 = 3 THEN NULL ELSE 18 + k % 38 END AS age,
    CASE WHEN k % 50 = 5 THEN NULL WHEN k % 12 = 0 THEN 'male' WHEN k % 25 = 0 THEN 'Other'
         WHEN k % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
    CASE k % 7 WHEN 0 THEN 'Student' WHEN 1 THEN 'Salaried Employee' WHEN 2 THEN 'self-employed'
         WHEN 3 THEN 'Business Owner' WHEN 4 THEN 'Homemaker' WHEN 5 THEN 'Self-Employed' END AS profession,
    CASE WHEN c_acctbal < 0 THEN 'Low (<3L)' WHEN c_acctbal < 3000 THEN 'Mid (3-8L)'
         WHEN c_acctbal < 7000 THEN 'High (8-15L)' ELSE 'Premium (15L+)' END AS income_bracket,
    CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS is_subscriber,
    CASE WHEN k % 4 < 2 THEN 'Control' ELSE 'Treatment' END AS ab_test_group
  FROM u
)
SELECT * FROM r UNION ALL SELECT * FROM r WHERE user_id % 50 = 7
"""

RAW_RESTAURANTS = """
SELECT s.s_suppkey AS restaurant_id,
  s.s_name AS restaurant_name,
  CASE s.s_suppkey % 5 WHEN 0 THEN 'North Indian' WHEN 1 THEN 'Chinese' WHEN 2 THEN 'Italian'
       WHEN 3 THEN 'Biryani' ELSE 'Bakery' END AS cuisine_type,
  n.n_name AS city,
  cast(cast(date '1994-01-01' + interval '1' day * cast(s.s_suppkey % 365 AS int) AS date) AS string) AS onboarded_date,
  cast(12 + s.s_suppkey % 14 AS double) / 100 AS commission_rate,
  cast(35 + s.s_suppkey % 15 AS double) / 10 AS base_rating
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey
"""

RAW_RIDERS = """
SELECT p_partkey AS delivery_partner_id,
  p_name AS partner_name,
  p_brand AS city,
  cast(cast(date '1996-01-01' + interval '1' day * cast(p_partkey % 700 AS int) AS date) AS string) AS joined_date,
  CASE p_size % 3 WHEN 0 THEN 'Bike' WHEN 1 THEN 'Bicycle' ELSE 'Scooter' END AS vehicle_type
FROM {part}
"""

RAW_ORDERS = """
WITH li AS (
  SELECT l_orderkey, count(*) AS n, min(l_suppkey) AS sk FROM {lineitem} GROUP BY l_orderkey
), b AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS ck, o.o_totalprice AS tp, coalesce(li.n, 0) AS n, li.sk, n.n_name,
    o.o_orderdate + interval '1' minute * cast((o.o_orderkey % 24) * 60 + o.o_orderkey % 60 AS int) AS p,
    CASE WHEN o.o_orderstatus IN ('F', 'O') THEN 'Delivered' WHEN o.o_orderkey % 4 = 0 THEN 'Failed'
         ELSE 'Cancelled' END AS st
  FROM {orders} o
  LEFT JOIN li ON li.l_orderkey = o.o_orderkey
  LEFT JOIN {supplier} s ON s.s_suppkey = li.sk
  LEFT JOIN {nation} n ON n.n_nationkey = s.s_nationkey
), t1 AS (
  SELECT b.*,
    CASE k % 6 WHEN 0 THEN 'Bank Transfer' WHEN 1 THEN 'Card' WHEN 2 THEN 'Gift Voucher' WHEN 3 THEN 'Phone Wallet'
         WHEN 4 THEN 'Cash' ELSE 'Pay Later' END AS pay,
    CASE WHEN st <> 'Failed' THEN p + interval '1' second * cast(60 * (1 + k % 8) + k % 60 AS int) END AS acc
  FROM b
), t2 AS (
  SELECT t1.*,
    CASE WHEN st = 'Delivered' THEN acc + interval '1' second * cast(60 * (10 + k % 26) + k % 50 AS int) END AS rdy
  FROM t1
), t3 AS (
  SELECT t2.*,
    CASE WHEN st = 'Delivered' THEN rdy + interval '1' second * cast(60 + k % 240 AS int) END AS pck,
    CASE WHEN st = 'Delivered' THEN rdy + interval '1' second * cast(60 * (2 + k % 14 + k % 40) AS int) END AS dlv
  FROM t2
), r AS (
  SELECT k AS order_id, CASE WHEN k % 97 = 5 THEN NULL ELSE ck END AS user_id, sk AS restaurant_id,
    CASE WHEN st <> 'Delivered' AND k % 2 = 0 THEN NULL ELSE 1 + k % 60 END AS delivery_partner_id,
    cast(p AS string) AS order_placed_time,
    cast(acc AS string) AS order_accepted_time,
    cast(p + interval '1' minute * cast(40 + 10 * (k % 4) AS int) AS string) AS promised_delivery_time,
    cast(rdy AS string) AS ready_time,
    cast(pck AS string) AS pickup_time,
    cast(dlv AS string) AS delivered_time,
    st AS order_status,
    CASE WHEN st = 'Failed' THEN 'card declined'
         WHEN st = 'Cancelled' THEN CASE k % 5 WHEN 0 THEN 'kitchen closed' WHEN 1 THEN 'ordered twice'
              WHEN 2 THEN 'sold out' WHEN 3 THEN 'no courier' ELSE 'too slow' END
    END AS cancel_reason,
    n AS items_count,
    CASE WHEN k % 200 = 1 THEN NULL WHEN k % 300 = 2 THEN tp * 20 ELSE tp END AS order_value,
    CASE k % 6 WHEN 3 THEN tp * cast(0.1 AS double) WHEN 4 THEN tp * cast(0.15 AS double)
         WHEN 5 THEN tp * cast(0.2 AS double) ELSE cast(0 AS double) END AS discount_amount,
    CASE WHEN k % 100 = 3 THEN -(cast(k % 6000 AS double) / 100) ELSE cast(k % 6000 AS double) / 100 END AS delivery_fee,
    cast(18 + k % 100 AS double) AS delivery_cost_to_rider,
    tp * cast(0.02 AS double) AS payment_gateway_fee,
    CASE WHEN k % 13 = 0 THEN cast(123456 + coalesce(sk, 0) % 14 AS double) / 1000000
         ELSE cast(12 + coalesce(sk, 0) % 14 AS double) / 100 END AS commission_rate,
    CASE WHEN k % 20 = 0 THEN lower(pay) ELSE pay END AS payment_method,
    CASE WHEN st = 'Failed' THEN 'Failed' ELSE 'Success' END AS payment_status,
    cast(1 + k % 15 AS double) + cast(k % 10 AS double) / 10 AS distance_km,
    CASE WHEN st = 'Cancelled' THEN tp ELSE cast(0 AS double) END AS refund_amount,
    CASE WHEN st = 'Delivered' AND k % 9 <> 0 THEN 1 + k % 5 END AS rating,
    CASE WHEN k % 31 = 0 THEN 1 ELSE 0 END AS complaint_flag,
    CASE WHEN st = 'Delivered' AND k % 29 = 0 THEN 1 ELSE 0 END AS wrong_item_flag,
    CASE WHEN k % 6 > 2 THEN 1 ELSE 0 END AS is_promo_used,
    CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS is_scheduled_order,
    CASE WHEN ck % 4 < 2 THEN 'Control' ELSE 'Treatment' END AS ab_test_group,
    CASE WHEN k % 2 = 0 THEN 'Android' ELSE 'iOS' END AS device_type,
    n_name AS city
  FROM t3
)
SELECT * FROM r UNION ALL SELECT * FROM r WHERE order_id % 100 = 50
UNION ALL SELECT
  order_id, user_id, restaurant_id, delivery_partner_id, order_placed_time, order_accepted_time,
  promised_delivery_time, ready_time, pickup_time, delivered_time, order_status, cancel_reason, items_count,
  cast(NULL AS double) AS order_value, discount_amount, delivery_fee, delivery_cost_to_rider,
  payment_gateway_fee, commission_rate, payment_method, payment_status, distance_km, refund_amount, rating,
  complaint_flag, wrong_item_flag, is_promo_used, is_scheduled_order, ab_test_group, device_type, city
FROM r WHERE order_id % 400 = 11
"""

RAW_EVENTS = """
WITH e AS (
  SELECT event_id,
    cast(user_id AS string) || '-' || cast(cast(ts AS date) AS string) AS session_id,
    user_id,
    CASE event_type WHEN 'signup' THEN 'app_open' WHEN 'view' THEN 'menu_view' WHEN 'click' THEN 'add_to_cart'
         WHEN 'error' THEN 'checkout_started' WHEN 'purchase' THEN 'payment_completed' END AS event_name,
    ts AS event_time,
    CASE WHEN event_id % 2 = 0 THEN 'Android' ELSE 'iOS' END AS device_type
  FROM {events}
)
SELECT * FROM e UNION ALL SELECT * FROM e WHERE event_id % 100 = 9
"""

RAW_NPS = """
SELECT c_custkey AS response_id,
  c_custkey AS user_id,
  cast(cast(date '1999-01-01' + interval '1' day * cast(c_custkey % 365 AS int) AS date) AS string) AS response_date,
  (c_custkey * 7) % 13 AS nps_score
FROM {customer}
"""

# marketplace table -> (adapter SQL, input tables it reads)
ADAPTER = {
    "users": (RAW_USERS, ("customer", "nation")),
    "restaurants": (RAW_RESTAURANTS, ("supplier", "nation")),
    "riders": (RAW_RIDERS, ("part",)),
    "orders": (RAW_ORDERS, ("orders", "lineitem", "supplier", "nation")),
    "events": (RAW_EVENTS, ("events",)),
    "nps": (RAW_NPS, ("customer",)),
}
SOURCE_TABLES = ("customer", "nation", "supplier", "part", "orders", "lineitem", "events")


def read_source_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in SOURCE_TABLES}


def load_raw(spark: SparkSession, sf_dir: str):
    """The six raw marketplace tables derived from the star-schema parquet files (lazy)."""
    from marketlens.model import Marketplace

    src = read_source_tables(spark, sf_dir)
    frames = {name: spark.sql(sql, **{t: src[t] for t in needs}) for name, (sql, needs) in ADAPTER.items()}
    return Marketplace(**frames)


def duckdb_sql(table: str) -> str:
    """The same adapter text bound to the oracle's pre-registered view names."""
    sql, needs = ADAPTER[table]
    return sql.format(**{t: t for t in needs})
