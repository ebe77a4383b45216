"""What the money columns hold that is no amount."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.numeric import MONEY, RATE, count_if, money, rejected
from marketlens.model import Marketplace

MONEY_COLUMNS = {"order_value": MONEY, "discount_amount": MONEY, "delivery_fee": MONEY, "delivery_cost_to_rider": MONEY,
                 "payment_gateway_fee": MONEY, "refund_amount": MONEY, "commission_rate": RATE}


def money_quality(m: Marketplace) -> DataFrame:
    """One row a money column of orders: rows, missing (null), rejected (present but no amount, so it counts as missing
    in every KPI) and negative amounts. One aggregate over orders."""
    counts = []
    for c, kind in MONEY_COLUMNS.items():
        counts.append(F.struct(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("rows"), count_if(F.isnull(c)).alias("missing"),
            rejected(c, kind).alias("rejected"), count_if(F.coalesce(money(c) < 0, F.lit(False))).alias("negative")))
    return m.orders.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")
