"""Append and refresh equals a full recompute: late, undated, repeated and corrected orders included."""

import pytest
from pyspark.sql import functions as F

from marketlens.incremental import IncrementalOrders
from marketlens.operators.clean import clean_orders
from marketlens.plans import charts as CH
from marketlens.plans import kpis as K
from marketlens.sources.adapter import load_raw
from marketlens.sources.tables import staged
from tests.conftest import SF_SMALL


def few(df, label="arrivals"):
    """Stored, so that a plan over many arrivals stays small."""
    return staged(df.coalesce(1), label)


def rows(df):
    return sorted(map(repr, df.collect()))


def same_as_batch(state, raw, arrived, kpis=True):
    """The state against the batch job over everything that arrived."""
    orders = few(clean_orders(arrived))
    whole = raw.with_(orders=orders)
    now = state.marketplace(whole)
    assert now.cube is not None
    assert rows(now.orders.select(*sorted(now.orders.columns))) == rows(whole.orders.select(*sorted(whole.orders.columns)))
    for chart in (CH.gmv_trend_daily, CH.orders_trend_daily):
        assert rows(chart(now)) == rows(chart(whole))
    if kpis:
        assert rows(K.kpi_all(now)) == rows(K.kpi_all(whole))


@pytest.fixture(scope="module")
def raw(spark, small):
    """Clean tables beside raw orders, a twentieth of them."""
    return small.with_(orders=few(load_raw(spark, SF_SMALL).orders.where("order_id % 20 = 4")))


def test_append_and_refresh_equals_recompute(spark, raw):
    o = raw.orders
    first = o.where("order_id % 3 <> 0")
    state = IncrementalOrders.start(first)
    same_as_batch(state, raw, first, kpis=False)
    months = set(state.state.orders)

    # late orders of all months, an undated one, corrections that change the value, the month and the user, a copy
    # without its value, exact repeats
    late = o.where("order_id % 3 = 0 AND order_placed_time < '1996-03-01'")
    corrected = first.where("order_id % 400 IN (4, 204)").withColumn("user_id", F.lit(None).cast("bigint")).unionByName(
        first.where("order_id % 400 IN (44, 244)").withColumn("restaurant_id", F.col("restaurant_id") - 1).withColumn("order_placed_time", F.lit("1998-07-05 10:00:00")))
    undated = o.where("order_id % 3 = 0 AND order_placed_time LIKE '1997-%'").withColumn("order_placed_time", F.lit("no time"))
    empty = first.where("order_id % 400 IN (84, 284)").withColumn("order_value", F.lit(None).cast("double"))
    arrived = few(late.unionByName(corrected).unionByName(undated).unionByName(empty).unionByName(first.where("order_id % 400 IN (124, 324)")))
    touched = state.refresh(arrived)
    assert "" in touched and "1998-07" in touched and not set(state.state.orders) - set(touched) - months
    assert months - set(touched)  # some months stay as they are
    held = first.unionByName(arrived)
    same_as_batch(state, raw, held)

    # one month only: the others keep their version
    august = few(o.where("order_id % 3 = 0 AND order_id % 5 <> 0").withColumn("order_placed_time", F.lit("1997-08-03 12:00:00")).limit(3)
                 .withColumn("order_id", F.col("order_id") + 500_000))
    assert state.refresh(august) == ["1997-08"]
    assert {v for m, v in state.state.orders.items() if m != "1997-08"} <= {0, 1} and state.state.orders["1997-08"] == 2
    held = held.unionByName(august)
    same_as_batch(state, raw, held, kpis=False)

    # values so small that the fence falls below the threshold: every cube is summed again
    tiny = few(o.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(6)))).withColumns(
        {"order_id": F.col("i") * 1_000_000 + F.col("order_id"), "order_value": F.lit(0.01)}).drop("i"))
    before = state.state.threshold
    state.refresh(tiny)
    assert state.state.threshold < before and set(state.state.cubes.values()) == {state.state.version}
    same_as_batch(state, raw, held.unionByName(tiny))

    # another application reads the manifest
    again = IncrementalOrders.load(spark, raw.orders.schema, state.state.root)
    assert again.state == state.state
    assert again.refresh(first.limit(0)) == []
