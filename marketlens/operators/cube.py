"""Order facts: what every order adds to the KPIs, and the cube that sums them up.

An order adds whole numbers and exact amounts to sums and counts. ``order_facts`` computes these per
order; ``order_cube`` adds them up by every dimension a filter or a chart can name (day, month, city, device,
test group, restaurant, user). Sums of the cube's rows are sums over the orders, so everything that reads
facts reads either; a filter on a dimension keeps or drops whole rows of both. The cube is stored with the
cleaned tables: a changed selection reads it and no order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.dates import whole_minutes
from marketlens.functions.numeric import exact_sum, money, rate
from marketlens.model import CANCELLED, DELIVERED, Marketplace
from marketlens.sources.tables import RANGE_ROWS, staged

#: A cell of more orders is hot: its orders are added up where they stand.
HOT_CELL = RANGE_ROWS // 16
DIMENSIONS = ("order_date", "order_month", "city", "device_type", "ab_test_group", "restaurant_id", "user_id")


def commission() -> Column:
    """Commission earned on an order, exact (DECIMAL)."""
    return money("order_value") * rate("commission_rate")


def net_revenue() -> Column:
    """Commission + delivery fee - rider cost - gateway fee - discount, exact (DECIMAL): the amounts of six
    decimals first, so the one addition with the commission keeps its fourteen."""
    return commission() + ((money("delivery_fee") - money("delivery_cost_to_rider"))
                           - (money("payment_gateway_fee") + money("discount_amount")))


def _one_if(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("long")


#: Means over delivered orders (or all): what is averaged. A fact has its sum and the number of values.
MEANS = ("avg_delivery_time", "_on_time", "avg_prep_time", "_wrong", "overall_avg_rating", "avg_basket_size")


def _measures() -> dict[str, Column]:
    d = F.col("order_status") == DELIVERED

    def if_d(c: Column) -> Column:
        return F.when(d, c)

    value, net = money("order_value"), net_revenue()
    out = {
        "n": F.lit(1).cast("long"), "n_delivered": _one_if(d), "n_cancelled": _one_if(F.col("order_status") == CANCELLED),
        "n_promo": _one_if(F.col("is_promo_used")), "n_scheduled": _one_if(F.col("is_scheduled_order")),
        "id_sum": F.col("order_id").cast("decimal(20,0)"),
        # all orders
        "value": value, "net": net,
        # delivered ones
        "gmv": if_d(value), "n_value": _one_if(d & value.isNotNull()), "square": if_d(value * value),
        "commission": if_d(commission()), "fees": if_d(money("delivery_fee")), "rider": if_d(money("delivery_cost_to_rider")),
        "margin": if_d(net), "n_margin": _one_if(d & net.isNotNull()),
    }
    means = {
        "avg_delivery_time": if_d(whole_minutes("order_placed_time", "delivered_time")),
        "_on_time": if_d(F.col("delivered_time") <= F.col("promised_delivery_time")),
        "avg_prep_time": if_d(whole_minutes("order_accepted_time", "ready_time")),
        "_wrong": if_d(F.col("wrong_item_flag")), "overall_avg_rating": if_d(F.col("rating")), "avg_basket_size": F.col("items_count"),
    }
    for name in MEANS:
        whole = means[name].cast("int").cast("long")
        out |= {f"{name}_s": whole, f"{name}_n": _one_if(whole.isNotNull())}
    return out


def order_facts(orders: DataFrame) -> DataFrame:
    """The dimensions and measures of every order."""
    return orders.select(*DIMENSIONS, *[c.alias(n) for n, c in _measures().items()])


def total(name: str, kind: str) -> Column:
    """Sum of a measure: exact where it is an amount."""
    return exact_sum(F.col(name)) if kind.startswith("decimal") else F.sum(name)


def _summed(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*DIMENSIONS).agg(*[total(n, kind).alias(n) for n, kind in facts.dtypes if n not in DIMENSIONS])


def order_cube(orders: DataFrame) -> DataFrame:
    """Facts summed up by all dimensions. The sums of a group are combined map-side, so a user or restaurant with a
    third of all orders sends a row a task and cell, and the shuffle is by all dimensions together."""
    return _summed(order_facts(orders))


def ranged_cube(orders: DataFrame, ranges: int) -> DataFrame:
    """``order_cube`` of stored orders, in ``ranges`` ranges of the dimensions, dates first.

    Most cells hold an order or two, so sums made before the shuffle would fill memory and save nothing. Orders
    move once, as the columns that facts are made of, and each task adds up the cells of its own range. Cells of more
    than HOT_CELL orders, told by a count of hashes, are few: those are combined map-side.
    """
    cell, by = F.xxhash64(*DIMENSIONS), [c for c in DIMENSIONS if c != "order_month"]  # the month follows from the date
    counts = orders.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    hot = staged(counts.where(F.col("_n") > HOT_CELL).select("_cell"), "hot-cells")

    def ranged(rows: DataFrame) -> DataFrame:
        return _summed(order_facts(rows.repartitionByRange(ranges, *by)))

    if hot.isEmpty():
        return ranged(orders)
    keyed = orders.withColumn("_cell", cell)
    return ranged(keyed.join(F.broadcast(hot), "_cell", "left_anti")).unionByName(
        order_cube(keyed.join(F.broadcast(hot), "_cell", "left_semi")))


def facts_of(m: Marketplace) -> DataFrame:
    """Fact rows of the marketplace's orders: of the cube where there is one."""
    return m.cube if m.cube is not None else order_facts(m.orders)
