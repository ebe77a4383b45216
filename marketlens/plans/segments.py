"""Cohort retention and RFM segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.dates import month_key
from marketlens.functions.numeric import exact_sum, round_pct, to_double
from marketlens.model import OTHER_SEGMENT, RFM_MAX_BINS, SEGMENT_RULES, Marketplace
from marketlens.operators.cube import facts_of
from marketlens.operators.joins import scalars
from marketlens.operators.rank import frequency_bins
from marketlens.operators.rollups import calendar_bitmaps, user_rollup
from marketlens.sources.tables import staged

def cohort_retention(m: Marketplace) -> DataFrame:
    """T11 (long form): cohort_month, month_offset >= 0, active_users, cohort_size, retention_pct (1 dp).

    Orders are first reduced to one bitmap of active months per (user, year), map-side; the join with users moves
    only those. Active users of a month are then the sum of one bit, twelve sums per (cohort, year).
    """
    active = facts_of(m).groupBy("user_id", F.year("order_date").alias("year")).agg(calendar_bitmaps()["months"].alias("months"))
    signups = m.users.select("user_id", "signup_date")
    per_month = {i: F.sum(F.call_function("shiftright", F.col("months"), F.lit(i)).bitwiseAND(F.lit(1))) for i in range(1, 13)}
    cohorts = active.join(signups, "user_id").groupBy(F.trunc("signup_date", "month").alias("cohort"), "year").agg(
        *[c.alias(f"m{i}") for i, c in per_month.items()])
    months = F.array(*[F.struct(F.lit(i).alias("month"), F.col(f"m{i}").alias("active_users")) for i in per_month])
    each = (cohorts.select("cohort", "year", F.explode(months).alias("m"))
            .select(F.date_format("cohort", "yyyy-MM").alias("cohort_month"), "m.active_users",
                    ((F.col("year") - F.year("cohort")) * 12 + F.col("m.month") - F.month("cohort")).alias("month_offset"))
            .where((F.col("month_offset") >= 0) & (F.col("active_users") > 0)))
    sizes = m.users.groupBy(month_key("signup_date").alias("cohort_month")).agg(F.count(F.lit(1)).alias("cohort_size"))
    return (each.join(sizes, "cohort_month")
            .select("cohort_month", "month_offset", "active_users", "cohort_size",
                    round_pct(F.col("active_users"), F.col("cohort_size"), 1).alias("retention_pct")))


def cohort_matrix(m: Marketplace) -> DataFrame:
    """T12 as a full grid: (cohort_month, month_offset, retention_pct) for every cohort and every offset
    from 0 to the largest; missing = null. The long form, one row per cohort and month, is written once, so
    the grid reads no order again."""
    long = staged(cohort_retention(m), "cohorts")
    top = scalars(long.agg(F.max("month_offset").alias("_top")))["_top"]
    grid = long.select("cohort_month").distinct().select("cohort_month", F.explode(F.sequence(F.lit(0), top)).alias("month_offset"))
    return grid.join(long.select("cohort_month", "month_offset", "retention_pct"), ["cohort_month", "month_offset"], "left")


def cohort_heat(m: Marketplace) -> DataFrame:
    """The same, one row a cohort: heat_cols (the offsets) and heat_data (retention by offset)."""
    cells = F.sort_array(F.collect_list(F.struct("month_offset", "retention_pct")))
    return cohort_matrix(m).groupBy("cohort_month").agg(cells.alias("c")).select(
        "cohort_month", F.col("c.month_offset").alias("heat_cols"), F.col("c.retention_pct").alias("heat_data"))


def segment_label(r: Column, f: Column, bins: Column) -> Column:
    """First rule that the R and F scores meet, as fractions of their range, else ``OTHER_SEGMENT``."""
    def frac(score: Column) -> Column:
        return F.when(bins > 1, (score - 1) / (bins - 1)).otherwise(F.lit(1.0))

    rf, ff = frac(r), frac(f)
    out = None
    for label, least_r, most_r, least_f, most_f in SEGMENT_RULES:
        rule = rf.between(least_r, most_r) & ff.between(least_f, most_f)
        out = F.when(rule, label) if out is None else out.when(rule, label)
    return out.otherwise(OTHER_SEGMENT)


def order_keys(c: str, descending: bool = False) -> list[Column]:
    """A long column as keys of an ordering, nulls before all values (after them if descending)."""
    flag, value = F.col(c).isNotNull().cast("long"), F.coalesce(F.col(c).cast("long"), F.lit(0))
    return [-flag, -value] if descending else [flag, value]


def decimal_keys(c: str) -> list[Column]:
    """The same for an exact sum of money: whole 10^8 first, then what is left in 10^-6."""
    amount = F.col(c).cast("decimal(38,6)")
    high = F.floor(amount / F.lit(10 ** 8)).cast("long")
    low = ((amount - high.cast("decimal(30,0)") * F.lit(10 ** 8)) * F.lit(10 ** 6)).cast("long")
    return [F.col(c).isNotNull().cast("long"), F.coalesce(high, F.lit(0)), F.coalesce(low, F.lit(0))]


def _rfm(m: Marketplace, max_bins: int = RFM_MAX_BINS) -> DataFrame:
    """Per user recency_days, frequency, monetary, R/F/M scores (1..bins) and segment_label.

    Each score is an equal-frequency bin (ties broken by user_id; recency ranked descending so recent
    buyers score high), found from its cut rows: the per-user table is written once, the cuts are
    selected from it, and the scores are plain expressions over it.
    """
    snapshot = scalars(facts_of(m).agg(F.max("order_date").alias("_snapshot")))["_snapshot"]
    base = staged(user_rollup(facts_of(m))
                  .select("user_id", F.datediff(snapshot, F.col("last_order_date")).alias("recency_days"),
                          F.col("n_orders").alias("frequency"), F.col("monetary").alias("_monetary_dec")), "rfm")
    user = order_keys("user_id")
    scored, bins = frequency_bins(base, {
        "R_score": [*order_keys("recency_days", descending=True), *user], "F_score": [*order_keys("frequency"), *user],
        "M_score": [*decimal_keys("_monetary_dec"), *user]}, max_bins)
    return scored.select("user_id", "recency_days", "frequency", "_monetary_dec",
                         to_double(F.col("_monetary_dec")).alias("monetary"), "R_score", "F_score", "M_score",
                         segment_label(F.col("R_score"), F.col("F_score"), F.lit(bins)).alias("segment_label"))


def rfm_scores(m: Marketplace, max_bins: int = RFM_MAX_BINS, ranked: DataFrame | None = None) -> DataFrame:
    return (ranked if ranked is not None else _rfm(m, max_bins)).drop("_monetary_dec")


def rfm_ranked(m: Marketplace, max_bins: int = RFM_MAX_BINS) -> DataFrame:
    """RFM scores with the exact monetary column, to share one ranking between T13 and T14."""
    return _rfm(m, max_bins)


def segment_summary(m: Marketplace, ranked: DataFrame | None = None) -> DataFrame:
    """Users per segment with mean spend and mean recency (0 dp)."""
    return (ranked if ranked is not None else _rfm(m)).groupBy("segment_label").agg(
        F.count(F.lit(1)).alias("users"),
        F.round(to_double(exact_sum(F.col("_monetary_dec"))) / F.count("_monetary_dec"), 0).alias("avg_spend"),
        F.round(F.avg("recency_days"), 0).alias("avg_recency_days"))


def first_order_flag(m: Marketplace) -> DataFrame:
    """is_first_order per order = earliest (placed time, order_id) of its user; orders without a user are one group.

    The per-user minimum is a partial aggregate. Its order ids are joined back on order_id, which no two orders
    share, so a user with a third of all orders is no hot key.
    """
    first = (m.orders.groupBy("user_id").agg(F.min(F.struct("order_placed_time", "order_id")).alias("_first"))
             .select(F.col("_first.order_id").alias("_oid"), F.lit(True).alias("_is")))
    orders = m.orders.select("order_id", "user_id")
    return orders.join(first, orders["order_id"].eqNullSafe(first["_oid"]), "left").select(
        "order_id", "user_id", F.coalesce("_is", F.lit(False)).alias("is_first_order"))
