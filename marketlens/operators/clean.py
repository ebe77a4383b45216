"""Cleaning jobs for the six tables (deduplication, lenient parsing, label normalisation,
median imputation, upper-fence winsorising)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.dates import lenient_date, lenient_timestamp, signup_date
from marketlens.functions.text import strip_ws, title_case
from marketlens.model import (AGE_BANDS, AGE_LAST_BAND, DEMOGRAPHIC_COLUMNS, IQR_MULTIPLIER, ORDER_FLAG_COLUMNS,
                              ORDER_TIME_COLUMNS, TABLE_NAMES, UNKNOWN, Marketplace)
from marketlens.operators.cube import ranged_cube
from marketlens.operators.dedup import distinct_rows, keep_first
from marketlens.operators.joins import scalars
from marketlens.operators.rank import quantile_nearest
from marketlens.sources.tables import ranges_for, shared_folder, staged, stored


def ensure_bool(df: DataFrame, columns: list[str]) -> DataFrame:
    """0/1 integers (or their strings) -> boolean, for present non-boolean columns; junk -> null."""
    fixes = {c: (F.col(c).try_cast(T.LongType()) != 0) for c in columns
             if c in df.columns and not isinstance(df.schema[c].dataType, T.BooleanType)}
    return df.withColumns(fixes) if fixes else df


def add_missing(df: DataFrame, columns: list[str], value: str = UNKNOWN) -> DataFrame:
    missing = {c: F.lit(value) for c in columns if c not in df.columns}
    return df.withColumns(missing) if missing else df


def age_band(age: Column) -> Column:
    """Fixed bands; a null age falls through to the last band."""
    out = None
    for bound, label in AGE_BANDS:
        out = F.when(age < bound, label) if out is None else out.when(age < bound, label)
    return out.otherwise(AGE_LAST_BAND)


def dedup_users(users: DataFrame) -> DataFrame:
    return keep_first(add_missing(users, DEMOGRAPHIC_COLUMNS), "user_id")


def clean_users(users: DataFrame) -> DataFrame:
    """Standalone user cleaning (``clean`` stages the deduplicated users)."""
    return finish_users(dedup_users(users))


def median_age(users: DataFrame) -> DataFrame:
    """One row: the exact median (mean of the two middle values for an even count). Its aggregation buffer is a
    value -> count map, bounded here by the handful of distinct ages, merged map-side."""
    return users.agg(F.median(F.col("age").cast("double")).alias("_median_age"))


def finish_users(users: DataFrame) -> DataFrame:
    return fill_ages(conform_users(users), scalars(median_age(users))["_median_age"])


def conform_users(users: DataFrame) -> DataFrame:
    """Everything that needs the row alone."""
    users = users.withColumns({
        "city": title_case(strip_ws("city")),
        "signup_date": signup_date(users),
        "device_type": F.coalesce(F.col("device_type"), F.lit(UNKNOWN)),
        "age": F.col("age").cast("double"),
        "gender": F.coalesce(title_case(strip_ws("gender")), F.lit(UNKNOWN)),
        "profession": F.coalesce(title_case(strip_ws("profession")), F.lit(UNKNOWN)),
        "income_bracket": F.coalesce(F.col("income_bracket"), F.lit(UNKNOWN)),
    })
    return ensure_bool(users, ["is_subscriber"])


def fill_ages(users: DataFrame, median: Column) -> DataFrame:
    return users.withColumn("age", F.coalesce("age", median)).withColumn("age_group", age_band(F.col("age")))


def dedup_orders(orders: DataFrame) -> DataFrame:
    """Dedup, parse and fix signs; rows without an order value (or with one that is not a number) are dropped
    (before the fence)."""
    return parse_orders(keep_first(orders, "order_id"))


def parse_orders(orders: DataFrame) -> DataFrame:
    """Parse and fix signs of deduplicated orders; those without a value go."""
    fixes = {c: lenient_timestamp(orders, c) for c in ORDER_TIME_COLUMNS if c in orders.columns}
    fixes["payment_method"] = title_case("payment_method")
    fixes["delivery_fee"] = F.abs("delivery_fee")
    return orders.withColumns(fixes).where(F.col("order_value").isNotNull() & ~F.isnan(F.col("order_value").cast("double")))


def order_value_fence(orders: DataFrame) -> DataFrame:
    """One row: q1, q3 ("nearest" quantiles), upper_fence = q3 + 1.5 * (q3 - q1)."""
    qs = quantile_nearest(orders, "order_value", [0.25, 0.75])
    row = qs.agg(F.max(F.when(F.col("q") == 0.25, F.col("value"))).alias("q1"),
                 F.max(F.when(F.col("q") == 0.75, F.col("value"))).alias("q3"))
    return row.withColumn("upper_fence", F.col("q3") + IQR_MULTIPLIER * (F.col("q3") - F.col("q1")))


def finish_orders(deduplicated: DataFrame) -> DataFrame:
    """Calendar columns and boolean flags, values capped at the upper fence."""
    return cap_values(dated(deduplicated), scalars(order_value_fence(deduplicated).select("upper_fence"))["upper_fence"])


def dated(orders: DataFrame) -> DataFrame:
    """Everything that needs the row alone."""
    orders = orders.withColumns({
        "order_date": F.to_date("order_placed_time"),
        "order_month": F.date_format("order_placed_time", "yyyy-MM"),
    })
    return ensure_bool(orders, ORDER_FLAG_COLUMNS)


def cap_values(orders: DataFrame, fence: Column) -> DataFrame:
    """Winsorise at the upper fence."""
    return orders.withColumn("order_value", F.when(F.col("order_value") > fence, fence).otherwise(F.col("order_value")))


def clean_orders(orders: DataFrame) -> DataFrame:
    """Standalone order cleaning (``clean`` stages the deduplicated orders)."""
    return finish_orders(dedup_orders(orders))


def clean_events(events: DataFrame) -> DataFrame:
    events = distinct_rows(events)
    return events.withColumn("event_time", lenient_timestamp(events, "event_time"))


def clean_nps(nps: DataFrame) -> DataFrame:
    nps = keep_first(nps, "response_id")
    return (nps.withColumn("response_date", lenient_date(nps, "response_date"))
            .where(F.col("nps_score").between(0, 10)))


@dataclass(frozen=True)
class Cleaned:
    """Stored clean tables, and the one-row table of the fence they were capped at."""

    tables: Marketplace
    fence: DataFrame


def clean(raw: Marketplace, stage: bool = True) -> Marketplace:
    """All cleaning jobs; restaurants and riders pass through unchanged. With ``stage`` the tables are stored
    (``clean_stored``), otherwise they stay plans."""
    if stage:
        return clean_stored(raw).tables
    return raw.with_(users=clean_users(raw.users), orders=clean_orders(raw.orders),
                     events=clean_events(raw.events), nps=clean_nps(raw.nps))


def clean_stored(raw: Marketplace, root: str | None = None, land: bool = False) -> Cleaned:
    """All cleaning jobs, every table written once under ``root``.

    Orders are deduplicated, dated and written by month; the fence is then selected from that one column, and the
    cap is an expression over the stored rows, as is a missing age over stored users, so neither is written
    again. The cube of the capped orders is stored beside them; a task of its write, and with ``land`` of that of
    the orders, holds a bounded number of rows. Nothing is cached on executors: a lost one costs no second
    deduplication. ``land`` stores raw orders and users first, for sources that are costly to read three times
    (views over other tables).
    """
    spark = raw.orders.sparkSession
    root = root or shared_folder(spark, "clean")

    def landed(name: str) -> DataFrame:
        return staged(getattr(raw, name), f"raw-{name}") if land else getattr(raw, name)

    def users() -> DataFrame:
        kept = stored("users", conform_users(dedup_users(landed("users"))), root)
        return fill_ages(kept, F.lit(median_age(kept).first()[0]).cast("double"))

    def orders() -> tuple[DataFrame, DataFrame, DataFrame]:
        source = landed("orders")
        kept = stored("orders", dated(dedup_orders(source)), root, source.count() if land else 0)
        fence = stored("order_value_fence", order_value_fence(kept), root)
        capped = cap_values(kept, F.lit(fence.first()["upper_fence"]).cast("double"))
        cube = ranged_cube(capped, ranges_for(spark, kept.count()))
        return capped, fence, stored("cube", cube, root, placed=True)

    def other(name: str, df: DataFrame) -> DataFrame:
        return stored(name, df, root)

    with ThreadPoolExecutor(max_workers=len(TABLE_NAMES)) as pool:  # independent jobs, submitted together
        capped, adults = pool.submit(orders), pool.submit(users)
        rest = {name: pool.submit(other, name, df) for name, df in (
            ("events", clean_events(raw.events)), ("nps", clean_nps(raw.nps)), ("restaurants", raw.restaurants), ("riders", raw.riders))}
        order_table, fence, cube = capped.result()
        return Cleaned(Marketplace(users=adults.result(), orders=order_table, cube=cube, **{n: f.result() for n, f in rest.items()}), fence)
