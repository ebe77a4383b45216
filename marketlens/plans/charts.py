"""Chart tables: the data behind every dashboard chart, as plain DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.numeric import n_unique, round_pct, sum_or_zero, to_double
from marketlens.model import AGE_BANDS, AGE_LAST_BAND, CANCELLED, FUNNEL_STAGES, UNKNOWN, Marketplace
from marketlens.operators.cube import facts_of
from marketlens.operators.joins import scalars
from marketlens.operators.rollups import delivered, delivered_by
from marketlens.plans.kpis import demo_breakdown, stage_sessions


def _count(name: str):
    return F.count(F.lit(1)).alias(name)


def channel_acq(m: Marketplace) -> DataFrame:
    """New users per acquisition channel with share of all users (1 dp)."""
    g = m.users.groupBy("acquisition_channel").agg(_count("new_users"))
    total = scalars(g.agg(F.sum("new_users").alias("_total")))["_total"]
    return g.select("acquisition_channel", "new_users", round_pct(F.col("new_users"), total, 1).alias("share_pct"))


def monthly_active(m: Marketplace) -> DataFrame:
    """Distinct ordering users per month."""
    return facts_of(m).groupBy("order_month").agg(n_unique("user_id").alias("mau"))


def funnel_counts(m: Marketplace) -> DataFrame:
    """The five fixed stages with distinct sessions (0 if absent) and conversion from the top stage."""
    stages = m.orders.sparkSession.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("stage"), F.lit(s).alias("event_name")) for i, s in enumerate(FUNNEL_STAGES)])).alias("s")
    ).select("s.stage", "s.event_name")
    counts = stages.join(F.broadcast(stage_sessions(m.events).where(F.col("event_name").isin(FUNNEL_STAGES))),
                         "event_name", "left").withColumn("sessions", F.coalesce(F.col("sessions"), F.lit(0)).cast("long"))
    top = scalars(counts.agg(F.max(F.when(F.col("stage") == 1, F.col("sessions"))).alias("_top")))["_top"]
    top_or_one = F.when(top == 0, F.lit(1)).otherwise(top)
    return counts.select("stage", "event_name", "sessions",
                                        round_pct(F.col("sessions"), top_or_one, 1).alias("conversion_from_top_pct"))


def gmv_by(m: Marketplace, period: str) -> DataFrame:
    return delivered_by(facts_of(m), period).select(period, to_double(F.col("gmv")).alias("gmv"))


def gmv_trend(m: Marketplace) -> DataFrame:
    """T4: delivered GMV per month."""
    return gmv_by(m, "order_month")


def gmv_trend_daily(m: Marketplace) -> DataFrame:
    """T5: delivered GMV per day."""
    return gmv_by(m, "order_date")


def orders_trend_daily(m: Marketplace) -> DataFrame:
    """Orders (all statuses) per day."""
    return facts_of(m).groupBy("order_date").agg(F.sum("n").alias("orders"))


def cancel_reasons(m: Marketplace) -> DataFrame:
    """Cancelled orders per reason."""
    return m.orders.where(F.col("order_status") == CANCELLED).groupBy("cancel_reason").agg(_count("count"))


def restaurant_gmv(m: Marketplace) -> DataFrame:
    """Delivered GMV per restaurant (the page shows the top 10)."""
    return delivered_by(facts_of(m), "restaurant_id").select("restaurant_id", to_double(F.col("gmv")).alias("restaurant_gmv"))


def restaurant_top(m: Marketplace, k: int = 10) -> DataFrame:
    """T8 as shown on the page: the k restaurants with the highest delivered GMV, ranked 1..k
    (ties: smaller restaurant id first). Ranking the k survivors sorts one bounded array, no window."""
    from marketlens.plans.kpis import top_restaurant_gmv

    top = top_restaurant_gmv(m, k).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("gmv")).alias("neg"), F.col("restaurant_id").alias("rid")))).alias("a"))
    return top.select(F.posexplode("a").alias("pos", "s")).select(
        F.col("s.rid").alias("restaurant_id"), to_double(-F.col("s.neg")).alias("restaurant_gmv"),
        (F.col("pos") + 1).cast("long").alias("rank"))


def cuisine_perf(m: Marketplace) -> DataFrame:
    """Delivered orders and GMV (0 dp) per cuisine."""
    rest = m.restaurants.select("restaurant_id", "cuisine_type")
    per = delivered_by(facts_of(m), "restaurant_id").join(rest, "restaurant_id")
    return per.groupBy("cuisine_type").agg(F.sum("n").alias("orders"), F.round(F.sum("gmv"), 0).cast("double").alias("gmv"))


def city_perf(m: Marketplace) -> DataFrame:
    """Delivered orders and GMV (0 dp) per order city."""
    return delivered_by(facts_of(m), "city").select("city", F.col("n").alias("orders"), F.round("gmv", 0).cast("double").alias("gmv"))


def rating_dist(m: Marketplace) -> DataFrame:
    """Delivered orders per non-null rating."""
    return delivered(m.orders).where(F.col("rating").isNotNull()).groupBy("rating").agg(_count("count"))


def demo_gender(m: Marketplace) -> DataFrame:
    return demo_breakdown(m, "gender")


def demo_age_group(m: Marketplace) -> DataFrame:
    return demo_breakdown(m, "age_group")


def demo_profession(m: Marketplace) -> DataFrame:
    return demo_breakdown(m, "profession")


def demo_income_bracket(m: Marketplace) -> DataFrame:
    return demo_breakdown(m, "income_bracket")


def gender_age_cross(m: Marketplace) -> DataFrame:
    """Delivered GMV by gender x age band, one column for each band in order; missing = 0."""
    d = delivered_by(facts_of(m), "user_id").join(m.users.select("user_id", "gender", "age_group"), "user_id")
    return d.groupBy("gender").agg(*[
        F.coalesce(to_double(F.sum(F.when(F.col("age_group") == b, F.col("gmv")))), F.lit(0.0)).alias(b) for b in (*(label for _, label in AGE_BANDS), AGE_LAST_BAND)])


def users_by(m: Marketplace, dim: str) -> DataFrame:
    return m.users.groupBy(dim).agg(_count("users"))


def users_by_gender(m: Marketplace) -> DataFrame:
    return users_by(m, "gender")


def users_by_profession(m: Marketplace) -> DataFrame:
    return users_by(m, "profession")


def users_by_income(m: Marketplace) -> DataFrame:
    return users_by(m, "income_bracket")


def unknown_share(m: Marketplace) -> DataFrame:
    """Share of users whose gender / profession is Unknown, and whether either is above one half."""
    s = m.users.agg(F.avg((F.col("gender") == UNKNOWN).cast("int")).alias("gender_unknown_share"),
                    F.avg((F.col("profession") == UNKNOWN).cast("int")).alias("profession_unknown_share"))
    return s.withColumn("mostly_unknown", (F.col("gender_unknown_share") > 0.5) | (F.col("profession_unknown_share") > 0.5))


def growth_trend(m: Marketplace, metric: str | None = None, grain: str | None = None) -> DataFrame:
    """(metric, grain, period, value) for GMV/Orders x Daily/Monthly (all four when not chosen).

    One scan: a grouping-sets aggregate by day and by month gives order counts and delivered GMV
    for both grains; GMV rows exist only for periods with delivered orders, as in the GMV charts.
    Orders x Monthly is the true monthly order count (distinct users per month is ``monthly_active``).
    """
    chosen = [(mt, gr) for mt in ("GMV", "Orders") for gr in ("Daily", "Monthly")
              if (metric is None or mt == metric) and (grain is None or gr == grain)]
    if not chosen:
        raise ValueError(f"unknown trend {metric!r}/{grain!r}")
    g = facts_of(m).groupingSets([["order_date"], ["order_month"]], "order_date", "order_month").agg(
        F.sum("n").alias("orders"), F.sum("n_delivered").alias("_nd"), sum_or_zero(F.col("gmv")).alias("_gmv"),
        F.grouping("order_date").alias("_by_month"))
    g = g.select(F.when(F.col("_by_month") == 0, F.lit("Daily")).otherwise(F.lit("Monthly")).alias("grain"),
                 F.when(F.col("_by_month") == 0, F.col("order_date").cast("string")).otherwise(F.col("order_month")).alias("period"),
                 "orders", "_nd", "_gmv")
    rows = F.array(F.struct(F.lit("GMV").alias("metric"), to_double(F.col("_gmv")).alias("value"), (F.col("_nd") > 0).alias("keep")),
                   F.struct(F.lit("Orders").alias("metric"), F.col("orders").cast("double").alias("value"), F.lit(True).alias("keep")))
    out = g.select("grain", "period", F.explode(rows).alias("r")).where(F.col("r.keep"))
    out = out.select(F.col("r.metric").alias("metric"), "grain", "period", F.col("r.value").alias("value"))
    keep = reduce(lambda a, b: a | b, [(F.col("metric") == mt) & (F.col("grain") == gr) for mt, gr in chosen])
    return out.where(keep)
