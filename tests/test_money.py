"""Exact money: dirty amounts never end a query, sums do not depend on order or layout."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketlens.functions.numeric import exact_sum, money, money_sum, rate, rejected, sum_or_zero
from marketlens.model import KpiConfig
from marketlens.operators.clean import clean
from marketlens.operators.cube import commission, net_revenue
from marketlens.plans import kpis as K
from marketlens.plans.quality import money_quality
from tests.builders import raw_marketplace


def test_amounts_and_what_is_none(spark):
    values = [0.125, 1e15, 9.9e15, 1e16, -1e300, math.nan, math.inf, -math.inf, 1.2345675, 0.1 + 0.2, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.m for r in df.select(money("v").alias("m")).collect()]
    assert got == [Decimal("0.125"), Decimal(10 ** 15), Decimal(99 * 10 ** 14), None, None, None, None, None, Decimal("1.234568"), Decimal("0.3"), None]
    assert df.agg(rejected("v").alias("n")).first().n == 5  # null is missing, not rejected
    rates = spark.createDataFrame([(v,) for v in [12.0, 0.123456, 9999.5, 10_000.0, math.nan]], "v double")
    assert [r.m for r in rates.select(rate("v").alias("m")).collect()] == [Decimal(12), Decimal("0.123456"), Decimal("9999.5"), None, None]


def test_sums_are_exact_in_any_order(spark):
    rnd = random.Random(2)
    values = [round(rnd.uniform(-1e9, 1e9), 6) for _ in range(2000)] + [9.9e15, -9.9e15, 1e-6]
    want = sum((Decimal(repr(v)).quantize(Decimal("0.000001")) for v in values), Decimal(0))
    for parts in (1, 7):
        rnd.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(parts)
        assert df.agg(money_sum("v").alias("s")).first().s == want


def test_a_sum_beyond_38_digits_is_null_and_an_empty_one_zero(spark):
    big = spark.range(20).select(F.lit("9" * 24).cast("decimal(38,14)").alias("d"))
    assert big.agg(exact_sum(F.col("d")).alias("s"), sum_or_zero(F.col("d")).alias("z")).first() == (None, None)
    none = spark.createDataFrame([(None,), (math.nan,)], "v double")
    assert none.agg(money_sum("v").alias("s")).first().s == 0


ORDER = dict(user_id=1, order_value=100.0, commission_rate=0.2, delivery_fee=20.0, delivery_cost_to_rider=30.0, payment_gateway_fee=2.0, discount_amount=0.0)


def test_net_revenue_keeps_fourteen_decimals(spark):
    m = clean(raw_marketplace(spark, users=[dict(user_id=1)], orders=[
        dict(ORDER, order_id=1, order_value=1.000001, commission_rate=0.00000001, delivery_fee=0.000001, delivery_cost_to_rider=0.0,
             payment_gateway_fee=0.0)]), stage=False)
    r = m.orders.select(commission().alias("c"), net_revenue().alias("n")).first()
    assert r.c == Decimal("0.00000001000001") and r.n == Decimal("0.00000101000001")


def test_dirty_orders_do_not_end_the_kpis(spark):
    orders = [dict(ORDER, order_id=1), dict(ORDER, order_id=2, commission_rate=12.0), dict(ORDER, order_id=3, delivery_fee=1e15),
              dict(ORDER, order_id=4, discount_amount=math.nan), dict(ORDER, order_id=5, payment_gateway_fee=0.000001),
              dict(ORDER, order_id=6, commission_rate=50_000.0), dict(ORDER, order_id=7, delivery_cost_to_rider=math.inf),
              dict(ORDER, order_id=8, order_value=math.nan)]
    m = clean(raw_marketplace(spark, users=[dict(user_id=1)], orders=orders), stage=False)
    k = K.kpi_families(m, ["revenue", "retention", "clv"], KpiConfig()).first()
    # order 8 has no value and is dropped; 4, 6 and 7 have no margin, 6 has no commission
    assert k.gmv == 700.0 and k.aov == 100.0
    commissions, fees = Decimal(5 * 20 + 1200), Decimal(10 ** 15 + 6 * 20)
    assert k.take_rate == pytest.approx(float(commissions) / 700 * 100) and k.arpu == float(commissions + fees)
    margins = [Decimal(8), Decimal(1188), Decimal(10 ** 15 - 12), Decimal("9.999999")]
    assert k.avg_contribution_margin == pytest.approx(float(sum(margins) / 4), rel=1e-15)
    assert k.avg_ltv == float(round(sum(margins), 4))
    q = {r.column_name: (r.rows, r.missing, r.rejected, r.negative) for r in money_quality(m).collect()}
    assert q["commission_rate"] == (7, 0, 1, 0) and q["discount_amount"] == (7, 0, 1, 0) and q["delivery_cost_to_rider"] == (7, 0, 1, 0)
    assert q["delivery_fee"] == (7, 0, 0, 0) and q["order_value"] == (7, 0, 0, 0)
