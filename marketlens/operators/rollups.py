"""Shared rollups of fact rows (``operators.cube``) and events: per-(user, year), per-user, per-session and per-restaurant.

Every KPI family reads one of these instead of re-scanning orders once per metric. All of them are
plain ``groupBy`` aggregates, so partial aggregation shrinks a hot key map-side before any shuffle.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.dates import whole_seconds
from marketlens.functions.numeric import exact_sum, sum_or_zero
from marketlens.model import DELIVERED


def is_delivered() -> Column:
    return F.col("order_status") == DELIVERED


def delivered(orders: DataFrame) -> DataFrame:
    return orders.where(is_delivered())


#: Days of a year in words of DAY_BITS bits; the sign bit is never set, so bit arithmetic cannot overflow.
DAY_WORDS, DAY_BITS = 6, 62


def _day_words(c: Column) -> list[Column]:
    """One BIGINT a word with the bit of the date's day of the year, 0 in the other words."""
    day = F.dayofyear(c) - 1
    word, bit = F.floor(day / DAY_BITS), F.pmod(day, F.lit(DAY_BITS))
    return [F.when(word == i, F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))).otherwise(F.lit(0).cast("long")) for i in range(DAY_WORDS)]


def calendar_bitmaps(c: str = "order_date") -> dict[str, Column]:
    """Aggregates for a group of one calendar year: the days (b0 to b5), the ISO week numbers (weeks) and the months
    that occur, each as a bitmap. A bitmap merges with ``bit_or``, so rows may be combined in any order."""
    one, date = F.lit(1).cast("long"), F.col(c)
    marks = {f"b{i}": w for i, w in enumerate(_day_words(date))}
    marks["weeks"] = F.call_function("shiftleft", one, F.weekofyear(date))
    marks["months"] = F.call_function("shiftleft", one, F.month(date))
    return {name: F.coalesce(F.bit_or(F.coalesce(mark, F.lit(0).cast("long"))), F.lit(0).cast("long")) for name, mark in marks.items()}


def bits(*names: str) -> Column:
    """Set bits of several bitmaps."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(n)).cast("long") for n in names])


DAYS = tuple(f"b{i}" for i in range(DAY_WORDS))


def user_years(facts: DataFrame) -> DataFrame:
    """One row per (user, calendar year) of fact rows: bitmaps of active days, weeks and months, order counts and exact
    money sums. A year without a date is a row of its own, null."""
    return facts.groupBy("user_id", F.year("order_date").alias("year")).agg(
        *[c.alias(n) for n, c in calendar_bitmaps().items()],
        F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date"),
        F.sum("n").alias("n"), F.sum("n_delivered").alias("dn"),
        sum_or_zero(F.col("value")).alias("monetary"), sum_or_zero(F.col("net")).alias("ltv"), sum_or_zero(F.col("gmv")).alias("dgmv"),
        F.max((F.col("n_scheduled") > 0).cast("int")).alias("sched"))


def second_day() -> Column:
    """Day of the year (from 0) of the second active day of a ``user_years`` row; null if there is none."""
    words = [F.col(n) for n in DAYS]
    before = [F.lit(0).cast("long")]
    for w in words[:-1]:
        before.append(before[-1].bitwiseOR(w))
    # the first non-empty word loses its lowest bit
    rest = [F.when((b == 0) & (w != 0), w.bitwiseAND(w - 1)).otherwise(w) for b, w in zip(before, words)]
    lowest = [F.when(r != 0, F.bit_count(r.bitwiseAND(-r) - 1) + DAY_BITS * i) for i, r in enumerate(rest)]
    return F.coalesce(*lowest)


NEVER = 1 << 20  # days, longer than any window asked for


def days_to_return() -> Column:
    """Aggregate over a user's ``user_years``: days from the first active day to the next one, NEVER or more if none.

    Within the first year it is the gap to the second bit. A next day in the following year is the first day of
    the earliest year of the other parity: a year of that parity that is no neighbour lies over a year away,
    beyond any window. All minima of numbers: no set, no window, no sort.
    """
    first = F.datediff("first_date", F.lit(dt.date(1970, 1, 1))).cast("long")
    gap = F.coalesce(second_day() - (F.dayofyear("first_date") - 1), F.lit(NEVER)).cast("long")
    odd = F.pmod(F.col("year"), F.lit(2)) == 1
    a, b = F.min(F.when(odd, first)), F.min(F.when(~odd, first))
    earliest = F.min(F.when(first.isNotNull(), first * (2 * NEVER) + gap))  # the first year's gap comes with its day
    return F.least(F.pmod(earliest, F.lit(2 * NEVER)), F.coalesce(F.abs(a - b), F.lit(NEVER)))


def user_rollup_from_years(years: DataFrame) -> DataFrame:
    """One row per ordering user (null user included as a group).

    Columns: user_id, n_orders, first_order_date, last_order_date, active_days, active_weeks (calendar year and ISO
    week), active_months, monetary (DECIMAL, all statuses), ltv (DECIMAL net revenue, all statuses),
    gmv_delivered (DECIMAL), n_delivered, has_scheduled, retained_d7, retained_d30. An undated order is one more
    day, week and month.
    """
    undated = F.col("year").isNull().cast("long")
    back = days_to_return()
    return years.groupBy("user_id").agg(
        F.sum("n").alias("n_orders"),
        F.min("first_date").alias("first_order_date"),
        F.max("last_date").alias("last_order_date"),
        F.sum(bits(*DAYS) + undated).alias("active_days"),
        F.sum(bits("weeks") + undated).alias("active_weeks"),
        F.sum(bits("months") + undated).alias("active_months"),
        exact_sum(F.col("monetary")).alias("monetary"),
        exact_sum(F.col("ltv")).alias("ltv"),
        exact_sum(F.col("dgmv")).alias("gmv_delivered"),
        F.sum("dn").alias("n_delivered"),
        F.coalesce(F.max("sched"), F.lit(0)).alias("has_scheduled"),
        (back <= 7).cast("int").alias("retained_d7"),
        (back <= 30).cast("int").alias("retained_d30"))


def user_rollup(facts: DataFrame) -> DataFrame:
    return user_rollup_from_years(user_years(facts))


def iso_weeks(orders: DataFrame, *keys: str) -> DataFrame:
    """Distinct ISO weeks (ISO year and week) per ``keys``, as bitmaps by ISO year: keys, iso_weeks."""
    d = F.col("order_date")
    iso_year = F.year(F.date_add(d, F.lit(3) - F.weekday(d)))
    years = orders.groupBy(*keys, iso_year.alias("year")).agg(calendar_bitmaps()["weeks"].alias("weeks"))
    return years.groupBy(*keys).agg(F.sum(bits("weeks") + F.col("year").isNull().cast("long")).alias("iso_weeks"))


def delivered_by(facts: DataFrame, key: str) -> DataFrame:
    """Delivered orders pre-aggregated per key: n (orders), nv (orders with a value), gmv (DECIMAL).

    Used before joining a dimension (users, restaurants): the join then moves one row per key
    instead of one row per order, and partial aggregation has already collapsed hot keys.
    """
    return facts.where(F.col("n_delivered") > 0).groupBy(key).agg(
        F.sum("n_delivered").alias("n"), F.sum("n_value").alias("nv"), sum_or_zero(F.col("gmv")).alias("gmv"))


def session_rollup(events: DataFrame) -> DataFrame:
    """One row per session: start, end, whole-second duration."""
    return (events.groupBy("session_id")
            .agg(F.min("event_time").alias("start"), F.max("event_time").alias("end"))
            .withColumn("duration_sec", whole_seconds("start", "end")))


def restaurant_rollup(facts: DataFrame, split_date: dt.date) -> DataFrame:
    """One row per restaurant with orders: delivered GMV (DECIMAL) and first/second-half activity."""
    first_half = F.col("order_date") < F.lit(split_date)
    return facts.groupBy("restaurant_id").agg(
        sum_or_zero(F.col("gmv")).alias("gmv"),
        F.max(F.when(F.col("n_delivered") > 0, 1).otherwise(0)).alias("has_delivered"),
        F.max(F.when(first_half, 1).otherwise(0)).alias("in_h1"),
        F.max(F.when(first_half, 0).otherwise(1)).alias("in_h2"))
