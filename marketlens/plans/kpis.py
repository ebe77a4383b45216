"""Scalar KPI families A-L: each is a one-row DataFrame whose columns are the KPI names.

KPIs are computed from a few fused one-row "parts" instead of one aggregate per metric:

- ``orders``: one pass over fact rows, of the stored cube where there is one (counts, exact money sums, times,
  A/B moments): serves revenue, operations, product, conversion, A/B and most of marketplace;
- ``users`` / ``user_rollup``: one pass over users, one over the per-user rollup (retention, LTV,
  scheduled adoption, distinct ordering users);
- ``sessions``, ``restaurants``, ``nps``, ``demographics``; DAU/WAU/MAU come from the calendar bitmaps of the
  user rollup (distinct user-period pairs) and of the orders aggregate (periods), with no extra pass.

A family computes only the parts it needs; ``kpi_all`` computes every part once and combines them
without joins, so each base table is scanned a handful of times for all 61 KPIs. Nothing is
collected.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.dates import month_key, whole_seconds
from marketlens.functions.numeric import count_if, exact_sum, n_unique, pct, pct_or_zero, ratio, sum_or_zero, to_double
from marketlens.functions.stats import normal_two_sided_p, student_t_two_sided_p
from marketlens.model import AB_GROUPS, KpiConfig, Marketplace
from marketlens.operators.cube import MEANS, facts_of
from marketlens.operators.joins import one_row_of, scalars
from marketlens.operators.rollups import DAYS, bits, calendar_bitmaps, delivered_by, iso_weeks, restaurant_rollup, user_rollup

DEMO_KPI_PREFIX = {"gender": "top_gender", "profession": "top_profession", "income_bracket": "top_income",
                   "age_group": "top_age_group"}


def _one(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side (each is a global aggregate, so exactly one row), combined
    without a join: see ``operators.joins.one_row_of``."""
    return one_row_of(*frames)


def _d(a: Column, b: Column) -> Column:
    """a / b, null when b is 0 (ANSI mode would raise)."""
    return F.try_divide(a, b)


def _dsum(c: Column) -> Column:
    return sum_or_zero(c)


# ---- parts -------------------------------------------------------------------------------------
def part_orders(m: Marketplace, cfg: KpiConfig = KpiConfig()) -> DataFrame:
    """One hash aggregate of fact rows by calendar year, whose rows (as many as years) are then summed up. The
    days, weeks and months with orders are bitmaps of the year, so nothing is collected."""
    facts = facts_of(m)
    counts = {"n_orders": "n", "n_delivered": "n_delivered", "n_cancelled": "n_cancelled", "_n_margin": "n_margin",
              "_n_value": "n_value", "_promo": "n_promo"}
    amounts = {"_gmv": "gmv", "_commission": "commission", "_fees": "fees", "_margin": "margin", "_rider": "rider"}
    sums = {name: F.col(c) for name, c in {**counts, **amounts}.items()}
    for prefix, group in zip(("c", "t"), AB_GROUPS):
        g = F.col("ab_test_group") == group
        for name, c in {"n": "n", "x": "n_delivered", "k": "n_value", "s1": "gmv", "s2": "square"}.items():
            sums[f"{prefix}_{name}"] = F.when(g, F.col(c))
    sums |= {f"{name}_{x}": F.col(f"{name}_{x}") for name in MEANS for x in "sn"}
    exact = {*amounts, "c_s1", "c_s2", "t_s1", "t_s2"}
    years = facts.groupBy(F.year("order_date").alias("year")).agg(
        *[(exact_sum(c) if n in exact else F.sum(c)).alias(n) for n, c in sums.items()],
        *[c.alias(n) for n, c in calendar_bitmaps().items()],
        F.min("order_date").alias("_first"), F.max("order_date").alias("_last"))
    whole = {n: exact_sum(F.col(n)) if n == "_margin" else sum_or_zero(F.col(n)) if n in exact else F.coalesce(F.sum(n), F.lit(0))
             for n in sums if not n.startswith(MEANS)}
    whole |= {n: _d(F.sum(f"{n}_s").cast("double"), F.sum(f"{n}_n").cast("double")) for n in MEANS}
    # periods with orders, an undated order being one more: the denominators of DAU / WAU / MAU
    undated = F.col("year").isNull().cast("long")
    periods = {"_day_periods": bits(*DAYS), "_week_periods": bits("weeks"), "_month_periods": bits("months")}
    row = years.agg(
        *[c.alias(n) for n, c in whole.items()], F.datediff(F.max("_last"), F.min("_first")).alias("_days"),
        *[F.sum(c + undated).alias(n) for n, c in periods.items()])
    if cfg.week_key == "iso":
        return _one(row.drop("_week_periods"), iso_weeks(facts).withColumnRenamed("iso_weeks", "_week_periods"))
    return row


def part_users(m: Marketplace) -> DataFrame:
    return m.users.agg(F.count(F.lit(1)).alias("n_users"), n_unique(month_key("signup_date")).alias("_months"))


def _rollup(m: Marketplace, cfg: KpiConfig = KpiConfig()) -> DataFrame:
    rollup = user_rollup(facts_of(m))
    if cfg.week_key == "reference":
        return rollup
    if cfg.week_key != "iso":
        raise ValueError(f"unknown week key mode {cfg.week_key!r}")
    weeks = iso_weeks(facts_of(m), "user_id").select(F.col("user_id").alias("_u"), "iso_weeks")
    return (rollup.join(weeks, F.col("user_id").eqNullSafe(F.col("_u")), "left").drop("_u")
            .withColumn("active_weeks", F.col("iso_weeks")).drop("iso_weeks"))


def _user_rollup_aggs() -> dict[str, Column]:
    ttfo = F.datediff("first_order_date", "signup_date")
    user = F.col("user_id").isNotNull()
    return {
        "n_order_users": F.count(F.lit(1)),
        # orders without a user are one group in the counts of customers, but cannot return: the
        # first-order join and the list of retained users match no null
        "_d7": count_if(user & (F.col("retained_d7") == 1)), "_d30": count_if(user & (F.col("retained_d30") == 1)),
        "_repeat": count_if(F.col("n_orders") >= 2),
        "_ret_orders": F.coalesce(F.sum(F.when(user & (F.col("active_months") >= 2), F.col("n_orders"))), F.lit(0)),
        "_ret_users": count_if(F.col("active_months") >= 2),
        "_sched": count_if(F.col("has_scheduled") == 1),
        "_ltv": exact_sum(F.col("ltv")),
        "avg_ttfo": F.avg(F.when(ttfo >= 0, ttfo)),
        "_subs": count_if(F.col("is_subscriber")),
        "_user_days": F.sum("active_days"), "_user_weeks": F.sum("active_weeks"), "_user_months": F.sum("active_months"),
    }


def part_user_rollup(m: Marketplace, cfg: KpiConfig) -> DataFrame:
    """Per-user rollup aggregated to one row; joined once with users (left, so every ordering user
    counts) to also give time-to-first-order and subscriber adoption without another orders pass."""
    ur = _rollup(m, cfg).join(m.users.select("user_id", "signup_date", "is_subscriber"), "user_id", "left")
    r = ur.agg(*[c.alias(n) for n, c in _user_rollup_aggs().items()])
    if cfg.ltv_delivered_only:
        users = facts_of(m).where(F.col("n_delivered") > 0).groupBy("user_id").agg(exact_sum(F.col("margin")).alias("ltv"))
        ltv = users.agg(exact_sum(F.col("ltv")).alias("_ltv"), F.count(F.lit(1)).alias("_ltv_n"))
        return _one(r.drop("_ltv"), ltv)
    return r.withColumn("_ltv_n", F.col("n_order_users"))


def stage_sessions(events: DataFrame) -> DataFrame:
    """Distinct sessions per event name (stages counted independently, not as a sequence)."""
    return events.groupBy("event_name").agg(n_unique("session_id").alias("sessions"))


KPI_STAGES = ("menu_view", "add_to_cart", "checkout_started")


def part_sessions(m: Marketplace) -> DataFrame:
    """Session KPIs from one aggregate of events by (user, session).

    Its rows are the distinct pairs; by session they give the first and last event time and the
    stages that occur. The mean number of distinct sessions per user is pairs / distinct users, null
    counted as a value on both sides, which equals the mean of the per-user distinct counts.
    """
    flags = [f"_has_{st}" for st in KPI_STAGES]
    pairs = m.events.groupBy("user_id", "session_id").agg(
        F.min("event_time").alias("_start"), F.max("event_time").alias("_end"),
        *[F.max((F.col("event_name") == st).cast("int")).alias(f) for st, f in zip(KPI_STAGES, flags)])
    sessions = pairs.groupBy("session_id").agg(
        F.min("_start").alias("_start"), F.max("_end").alias("_end"), *[F.max(f).alias(f) for f in flags])
    per_session = sessions.agg(
        F.avg(whole_seconds("_start", "_end")).alias("avg_session_duration_sec"), F.count(F.lit(1)).alias("_total_sessions"),
        *[count_if(F.col(f) == 1).alias(f"_{st}") for st, f in zip(KPI_STAGES, flags)])
    users = pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("_sessions"))
    per_user = users.agg(_d(F.sum("_sessions").cast("double"), F.count(F.lit(1)).cast("double")).alias("avg_session_frequency"))
    return _one(per_session, per_user)


def top_restaurant_gmv(m: Marketplace, k: int = 10) -> DataFrame:
    per = delivered_by(facts_of(m), "restaurant_id").select("restaurant_id", "gmv")
    return per.orderBy(F.desc("gmv"), F.asc("restaurant_id")).limit(k)


TOP_K = 10
TOP_BUCKETS = 4096  # candidates for the global top-k: at most TOP_K per hash bucket


def part_restaurants(m: Marketplace, cfg: KpiConfig) -> DataFrame:
    """Restaurant counts, first/second-half churn and the top-10 GMV sum from ONE consumer of the
    per-restaurant rollup (two consumers would each re-aggregate orders).

    The top 10 comes from a partitioned window: restaurants are ranked inside hash buckets, only
    each bucket's best 10 are collected (at most 10 x TOP_BUCKETS candidates, a fixed bound), and
    the global best 10 of those are summed exactly. Ties at the 10th place cannot change the sum.
    """
    rest = restaurant_rollup(facts_of(m), cfg.split_date).withColumn(
        "_b", F.pmod(F.xxhash64("restaurant_id"), F.lit(TOP_BUCKETS)))
    in_bucket = F.row_number().over(Window.partitionBy("_b").orderBy(F.desc("gmv"), F.asc("restaurant_id")))
    ranked = rest.withColumn("_rb", in_bucket)
    cand = F.when(F.col("_rb") <= TOP_K, F.struct((-F.col("gmv")).alias("neg"), F.col("restaurant_id").alias("id")))
    agg = ranked.agg(
        F.count(F.lit(1)).alias("active_restaurants"), count_if(F.col("in_h1") == 1).alias("_h1"),
        count_if((F.col("in_h1") == 1) & (F.col("in_h2") == 0)).alias("_lost"),
        F.collect_list(cand).alias("_cands"))
    best = F.slice(F.array_sort(F.col("_cands")), 1, TOP_K)
    top = F.aggregate(best, F.lit(0).cast("decimal(38,6)"), lambda acc, x: (acc - x["neg"]).cast("decimal(38,6)"))
    counts = agg.select("active_restaurants", "_h1", "_lost", top.alias("_top"))
    total = m.restaurants.agg(n_unique("restaurant_id").alias("total_restaurants"))
    return _one(counts, total)


def part_nps(m: Marketplace) -> DataFrame:
    return m.nps.agg(count_if(F.col("nps_score") >= 9).alias("_prom"), count_if(F.col("nps_score") <= 6).alias("_detr"),
                     F.count(F.lit(1)).alias("_resp"))


def demo_long(m: Marketplace) -> DataFrame:
    """Delivered GMV per (dimension, value) for the four user attributes in one grouping-sets pass."""
    d = delivered_by(facts_of(m), "user_id").join(m.users.select("user_id", *DEMO_KPI_PREFIX), "user_id")
    g = d.groupingSets([[c] for c in DEMO_KPI_PREFIX], *DEMO_KPI_PREFIX).agg(
        _dsum(F.col("gmv")).alias("_gmv"), *[F.grouping(c).alias(f"_g_{c}") for c in DEMO_KPI_PREFIX])
    dim = reduce(lambda acc, c: acc.when(F.col(f"_g_{c}") == 0, F.lit(c)), list(DEMO_KPI_PREFIX)[1:],
                 F.when(F.col(f"_g_{list(DEMO_KPI_PREFIX)[0]}") == 0, F.lit(list(DEMO_KPI_PREFIX)[0])))
    value = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.col(c)) for c in DEMO_KPI_PREFIX])
    return g.select(dim.alias("dimension"), value.alias("value"), to_double(F.col("_gmv")).alias("gmv"))


def part_demographics(m: Marketplace) -> DataFrame:
    """Best value by GMV per attribute (ties -> smaller label); the window sees one row per label."""
    best = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("gmv"), F.asc("value")))
    top = demo_long(m).withColumn("_rn", best).where(F.col("_rn") == 1)
    cols = []
    for dim, prefix in DEMO_KPI_PREFIX.items():
        cols += [F.max(F.when(F.col("dimension") == dim, F.col("value"))).alias(prefix),
                 F.max(F.when(F.col("dimension") == dim, F.col("gmv"))).alias(f"_{prefix}")]
    return top.agg(*cols)


# ---- derived columns ---------------------------------------------------------------------------
def _cac(cfg: KpiConfig) -> Column:
    return _d(F.lit(float(cfg.monthly_marketing_spend)) * F.col("_months"), F.col("n_order_users"))


def _gmv() -> Column:
    return to_double(F.col("_gmv"))


def _aov() -> Column:
    return ratio(_gmv(), F.col("_n_value"))


def _margin() -> Column:
    return ratio(to_double(F.col("_margin")), F.col("_n_margin"))


def _platform() -> Column:
    return to_double(F.col("_commission") + F.col("_fees"))


def _d30() -> Column:
    return pct(F.col("_d30"), F.col("n_users"))


def _avg_ltv() -> Column:
    return ratio(to_double(F.col("_ltv")), F.col("_ltv_n"))


def _avg_active(period: str) -> Column:
    """Mean distinct ordering users per period = distinct (user, period) pairs / distinct periods, both counted from
    bitmaps: the pairs by the user rollup, the periods by the orders aggregate."""
    return _d(F.col(f"_user_{period}s").cast("double"), F.col(f"_{period}_periods").cast("double"))


def ab_moments() -> dict[str, Column]:
    """Means, Welch statistic and dof, and the pooled z, from the c_*/t_* moments of ``part_orders``
    (c = Control, t = Treatment). The p-values are added on top of these plain columns."""
    mean = {g: _d(to_double(F.col(f"{g}_s1")), F.col(f"{g}_k")) for g in ("c", "t")}
    var = {g: _d(to_double(F.col(f"{g}_s2")) - _d(to_double(F.col(f"{g}_s1")) * to_double(F.col(f"{g}_s1")), F.col(f"{g}_k")),
                 F.col(f"{g}_k") - 1) for g in ("c", "t")}
    sa, sb = _d(var["t"], F.col("t_k")), _d(var["c"], F.col("c_k"))
    se2 = sa + sb
    p1, p2 = _d(F.col("c_x"), F.col("c_n")), _d(F.col("t_x"), F.col("t_n"))
    pool = _d(F.col("c_x") + F.col("t_x"), F.col("c_n") + F.col("t_n"))
    se = F.when((pool > 0) & (pool < 1), F.sqrt(pool * (1 - pool) * (_d(F.lit(1), F.col("c_n")) + _d(F.lit(1), F.col("t_n"))))
                ).otherwise(F.lit(0.0))
    available = (F.col("c_n") > 0) & (F.col("t_n") > 0) & (F.col("c_k") >= 2) & (F.col("t_k") >= 2)
    return {"ab_available": available, "p1": p1, "p2": p2,
            "z": F.when(se != 0, _d(p2 - p1, se)).otherwise(F.lit(0.0)), "_se": se,
            "control_mean": mean["c"], "treat_mean": mean["t"],
            "t": F.when(se2 > 0, _d(mean["t"] - mean["c"], F.sqrt(se2))),
            "df": F.when(se2 > 0, _d(se2 * se2, _d(sa * sa, F.col("t_k") - 1) + _d(sb * sb, F.col("c_k") - 1)))}


_P_VALUE_COLUMNS: dict[str, dict[str, Column]] = {}


def _p_value_columns(spark_context) -> dict[str, Column]:
    """The two p-value expressions over the projected columns z, t, df. They are built once per
    SparkContext: each is a few hundred Py4J calls, and they never change."""
    key = spark_context.applicationId  # unique per context (object ids can be reused)
    if key not in _P_VALUE_COLUMNS:
        _P_VALUE_COLUMNS.clear()  # a new context: earlier JVM objects are gone
        _P_VALUE_COLUMNS[key] = {
            "p_completion": F.when(F.col("_se") != 0, normal_two_sided_p(F.col("z"))).otherwise(F.lit(1.0)),
            "p_aov": F.when(F.col("df").isNotNull(), student_t_two_sided_p(F.col("t"), F.col("df")))}
    return _P_VALUE_COLUMNS[key]


def with_ab_tests(row: DataFrame) -> DataFrame:
    """Add both tests to a one-row frame holding the c_*/t_* moments of ``part_orders``: first the
    plain statistics, then the p-value integrals, which read those projected columns only."""
    stats = row.withColumns(ab_moments())
    return stats.withColumns(_p_value_columns(row.sparkSession.sparkContext)).drop("_se")


def ab_tests(m: Marketplace) -> DataFrame:
    """One row with both tests' statistics, from the single orders aggregate."""
    return with_ab_tests(part_orders(m))


# ---- families: (parts, columns) ----------------------------------------------------------------
def _families(cfg: KpiConfig) -> dict[str, tuple[list[str], Callable[[], list[Column]]]]:
    """family -> (parts it reads, builder of its output columns)."""
    def gated(c: Column, name: str) -> Column:
        return F.when(F.col("ab_available"), c).alias(name)

    demo_cols = []
    for prefix in DEMO_KPI_PREFIX.values():
        share = F.when(_gmv() == 0, F.lit(0.0)).otherwise(_d(F.col(f"_{prefix}"), _gmv()) * 100)
        demo_cols += [F.col(prefix), F.when(F.col(prefix).isNotNull(), share).alias(f"{prefix}_gmv_share")]
    years = F.greatest(F.col("_days") / 365.25, F.lit(1 / 365.25))
    return {
        "acquisition": (["orders", "users", "user_rollup"], lambda: [
            pct(F.col("n_order_users"), F.col("n_users")).alias("activation_rate"), F.col("avg_ttfo"),
            _cac(cfg).alias("cac")]),
        "engagement": (["orders", "user_rollup", "sessions"], lambda: [
            _avg_active("day").alias("avg_dau"), _avg_active("week").alias("avg_wau"), _avg_active("month").alias("avg_mau"),
            (_d(_avg_active("day"), _avg_active("month")) * 100).alias("stickiness"),
            ratio(F.col("n_orders"), F.col("n_order_users")).alias("orders_per_user"),
            F.col("avg_session_frequency"), F.col("avg_session_duration_sec")]),
        "conversion": (["orders", "sessions"], lambda: [
            pct_or_zero(F.col("n_orders"), F.col("_total_sessions")).alias("visitor_to_order_conv"),
            pct_or_zero(F.col("_add_to_cart"), F.col("_menu_view")).alias("menu_to_cart_rate"),
            F.when(F.col("_add_to_cart") == 0, F.lit(0.0))
             .otherwise((1 - _d(F.col("_checkout_started"), F.col("_add_to_cart"))) * 100).alias("cart_abandonment"),
            pct(F.col("n_delivered"), F.col("n_orders")).alias("order_completion_rate")]),
        "revenue": (["orders", "users", "user_rollup"], lambda: [
            _gmv().alias("gmv"), _aov().alias("aov"), ratio(_platform(), F.col("n_users")).alias("arpu"),
            ratio(_platform(), F.col("n_order_users")).alias("arppu"),
            pct(to_double(F.col("_commission")), _gmv()).alias("take_rate"), _margin().alias("avg_contribution_margin")]),
        "retention": (["users", "user_rollup", "nps"], lambda: [
            pct(F.col("_d7"), F.col("n_users")).alias("d7"), _d30().alias("d30"), (100 - _d30()).alias("churn_d30"),
            pct(F.col("_repeat"), F.col("n_order_users")).alias("repeat_rate"),
            F.when(F.col("_ret_users") == 0, F.lit(0.0)).otherwise(ratio(F.col("_ret_orders"), F.col("_ret_users")))
             .alias("order_frequency_retained"),
            _avg_ltv().alias("avg_ltv"), _d(_avg_ltv(), _cac(cfg)).alias("ltv_cac_ratio"),
            F.when(F.col("_resp") == 0, F.lit(0.0))
             .otherwise((_d(F.col("_prom"), F.col("_resp")) - _d(F.col("_detr"), F.col("_resp"))) * 100).alias("nps_score")]),
        "operations": (["orders"], lambda: [
            pct(F.col("n_cancelled"), F.col("n_orders")).alias("cancellation_rate"), F.col("avg_delivery_time"),
            (F.col("_on_time") * 100).alias("on_time_rate"), F.col("avg_prep_time"),
            ((1 - F.col("_wrong")) * 100).alias("order_accuracy_rate"),
            ratio(to_double(F.col("_rider")), F.col("n_delivered")).alias("cost_per_delivery")]),
        "marketplace": (["orders", "restaurants"], lambda: [
            F.col("active_restaurants"), F.col("total_restaurants"),
            ratio(F.col("n_delivered"), F.col("active_restaurants")).alias("restaurant_utilization"),
            pct_or_zero(F.col("_lost"), F.col("_h1")).alias("restaurant_churn_rate"), F.col("overall_avg_rating"),
            pct(to_double(F.col("_top")), _gmv()).alias("top10_share")]),
        "product": (["orders", "user_rollup"], lambda: [
            pct(F.col("_sched"), F.col("n_order_users")).alias("scheduled_order_adoption"),
            pct(F.col("_subs"), F.col("n_order_users")).alias("subscriber_adoption"),
            pct(F.col("_promo"), F.col("n_orders")).alias("promo_dependency"), F.col("avg_basket_size")]),
        "clv": (["orders", "user_rollup"], lambda: [
            (_aov() * _d(ratio(F.col("n_orders"), F.col("n_order_users")), years) * _d(_margin(), _aov())
             * F.lit(cfg.lifespan_years)).alias("clv_formulaic"),
            F.lit(cfg.lifespan_years).alias("assumed_lifespan_years")]),
        "ab_test": (["orders"], lambda: [
            F.col("ab_available"), gated(F.col("p1"), "ab_p1"), gated(F.col("p2"), "ab_p2"),
            gated(F.col("p_completion"), "ab_p_value_completion"),
            gated(F.col("control_mean"), "ab_control_aov_mean"), gated(F.col("treat_mean"), "ab_treat_aov_mean"),
            gated(F.col("p_aov"), "ab_p_value_aov")]),
        "demographics": (["orders", "demographics"], lambda: demo_cols),
    }


def _parts(m: Marketplace, cfg: KpiConfig, names: list[str], ab: bool = False) -> DataFrame:
    builders = {
        "orders": lambda: part_orders(m, cfg), "users": lambda: part_users(m),
        "user_rollup": lambda: part_user_rollup(m, cfg),
        "sessions": lambda: part_sessions(m), "restaurants": lambda: part_restaurants(m, cfg),
        "nps": lambda: part_nps(m), "demographics": lambda: part_demographics(m),
    }
    row = _one(*[builders[n]() for n in names])
    # the A/B tests are projections of the orders aggregate's moments: no second pass over orders
    return with_ab_tests(row) if ab else row


def kpi_family(m: Marketplace, family: str, cfg: KpiConfig = KpiConfig()) -> DataFrame:
    parts, cols = _families(cfg)[family]
    return _parts(m, cfg, parts, ab=family == "ab_test").select(*cols())


def kpi_families(m: Marketplace, families: list[str], cfg: KpiConfig = KpiConfig()) -> DataFrame:
    """Several families side by side, each part computed once."""
    specs = _families(cfg)
    needed = list(dict.fromkeys(p for f in families for p in specs[f][0]))
    return _parts(m, cfg, needed, ab="ab_test" in families).select(*[c for f in families for c in specs[f][1]()])


def kpi_acquisition(m, cfg=KpiConfig()): return kpi_family(m, "acquisition", cfg)  # noqa: E704
def kpi_engagement(m, cfg=KpiConfig()): return kpi_family(m, "engagement", cfg)  # noqa: E704
def kpi_conversion(m, cfg=KpiConfig()): return kpi_family(m, "conversion", cfg)  # noqa: E704
def kpi_revenue(m, cfg=KpiConfig()): return kpi_family(m, "revenue", cfg)  # noqa: E704
def kpi_retention(m, cfg=KpiConfig()): return kpi_family(m, "retention", cfg)  # noqa: E704
def kpi_operations(m, cfg=KpiConfig()): return kpi_family(m, "operations", cfg)  # noqa: E704
def kpi_marketplace(m, cfg=KpiConfig()): return kpi_family(m, "marketplace", cfg)  # noqa: E704
def kpi_product(m, cfg=KpiConfig()): return kpi_family(m, "product", cfg)  # noqa: E704
def kpi_clv(m, cfg=KpiConfig()): return kpi_family(m, "clv", cfg)  # noqa: E704
def kpi_ab_test(m, cfg=KpiConfig()): return kpi_family(m, "ab_test", cfg)  # noqa: E704
def kpi_demographics(m, cfg=KpiConfig()): return kpi_family(m, "demographics", cfg)  # noqa: E704


def p_text(p: Column) -> Column:
    """'< 0.0001' or four decimals."""
    return F.when(p < 0.0001, F.lit("< 0.0001")).otherwise(F.format_string("%.4f", F.round(p, 4)))


def ab_verdict(m: Marketplace, cfg: KpiConfig = KpiConfig()) -> DataFrame:
    k = kpi_ab_test(m, cfg)
    sig = (F.col("ab_p_value_completion") < cfg.significance) & (F.col("ab_p_value_aov") < cfg.significance)
    return k.select(
        "ab_available",
        p_text(F.col("ab_p_value_completion")).alias("completion_p_text"),
        p_text(F.col("ab_p_value_aov")).alias("aov_p_text"),
        F.when(F.col("ab_available"), sig).alias("both_significant"),
        F.when(~F.col("ab_available"), F.lit("not available"))
         .when(sig, F.lit("significant lift on both metrics"))
         .otherwise(F.lit("not all metrics significant")).alias("verdict"))


def demo_breakdown(m: Marketplace, dim: str) -> DataFrame:
    """Delivered orders by a user attribute: users (distinct), orders, gmv, aov (2 dp), share of GMV in %."""
    d = delivered_by(facts_of(m), "user_id").join(m.users.select("user_id", dim), "user_id")
    # one row per user after the pre-aggregation, so distinct users = rows
    g = d.groupBy(dim).agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("orders"),
                           _dsum(F.col("gmv")).alias("_gmv"), F.sum("nv").alias("_n"))
    total = scalars(g.agg(F.sum("_gmv").alias("_total")))["_total"]
    return g.select(dim, "users", "orders", to_double(F.col("_gmv")).alias("gmv"),
                    F.round(_d(to_double(F.col("_gmv")), F.col("_n")), 2).alias("aov"),
                    F.round(_d(to_double(F.col("_gmv")), to_double(total)) * 100, 6).alias("gmv_share"))


# ---- long form --------------------------------------------------------------------------------
FAMILY_ORDER = ["acquisition", "engagement", "conversion", "revenue", "retention", "operations", "marketplace",
                "product", "clv", "ab_test", "demographics"]


def to_long(wide: DataFrame, family_of: dict[str, str]) -> DataFrame:
    """(family, kpi, value, value_text): numbers and booleans in value, labels in value_text.
    One ``stack`` expression, so the unpivot is a single generator over the one-row frame."""
    args = []
    for f in wide.schema.fields:
        name = f"`{f.name}`"
        if f.dataType.simpleString() == "string":
            value, text = "CAST(NULL AS DOUBLE)", name
        else:
            value, text = f"CAST({name} AS DOUBLE)", "CAST(NULL AS STRING)"
        args += [f"'{family_of[f.name]}'", f"'{f.name}'", value, text]
    return wide.selectExpr(f"stack({len(wide.schema.fields)}, {', '.join(args)}) AS (family, kpi, value, value_text)")


def family_of_columns(cfg: KpiConfig, columns: list[str]) -> dict[str, str]:
    """KPI column -> family, for the wide row of all families in FAMILY_ORDER."""
    specs = _families(cfg)
    family_of, i = {}, 0
    for fam in FAMILY_ORDER:
        k = len(specs[fam][1]())  # cheap: plain column builders
        family_of.update({name: fam for name in columns[i:i + k]})
        i += k
    return family_of


def kpi_all(m: Marketplace, cfg: KpiConfig = KpiConfig()) -> DataFrame:
    """All 61 KPIs in long form from one wide row (every part computed once)."""
    wide = kpi_families(m, FAMILY_ORDER, cfg)
    return to_long(wide, family_of_columns(cfg, wide.columns))
