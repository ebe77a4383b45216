"""The reference's public surface, Spark-first: DataFrames in, DataFrames out.

``compute_all_kpis`` returns (kpi, charts) like the reference, but kpi is a one-row DataFrame
(one column per KPI) and every chart is a DataFrame; nothing is collected unless the caller does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.model import FilterSpec, KpiConfig, Marketplace
from marketlens.operators.clean import clean, ensure_bool  # noqa: F401  (re-exported)
from marketlens.operators.filters import apply_filters, filter_options, require_kpi_ready
from marketlens.plans import charts as CH
from marketlens.plans import kpis as K
from marketlens.plans import segments as SG
from marketlens.sources.jdbc import JdbcConfig, load_from_database  # noqa: F401  (re-exported)


def clean_data(raw: Marketplace) -> Marketplace:
    return clean(raw)


def get_filter_options(m: Marketplace) -> DataFrame:
    """Long form (dimension, value), including date_min and date_max."""
    return filter_options(m)


def filter_data(m: Marketplace, spec: FilterSpec | None = None, **selection) -> Marketplace:
    """Filtered, consistent slice; pass a FilterSpec or its fields as keywords."""
    return apply_filters(m, spec or FilterSpec(**selection))


#: Chart -> columns it is shown by; "-" means descending, ties by the label. restaurant_gmv is left as it
#: comes: only its top ten are shown, in restaurant_top10.
CHART_ORDER = {
    "channel_acq": "-new_users acquisition_channel", "monthly_active": "order_month", "funnel_counts": "stage",
    "gmv_trend": "order_month", "gmv_trend_daily": "order_date", "orders_trend_daily": "order_date",
    "cancel_reasons": "-count cancel_reason", "restaurant_top10": "rank", "cuisine_perf": "-gmv cuisine_type",
    "city_perf": "-gmv city", "cohort_retention": "cohort_month month_offset", "cohort_matrix": "cohort_month month_offset",
    "cohort_heat": "cohort_month", "segment_summary": "-users segment_label", "rating_dist": "rating", "gender_age_cross": "gender",
    "users_by_gender": "-users gender", "users_by_profession": "-users profession", "users_by_income": "-users income_bracket",
    "growth_trend": "metric grain period",
}


def in_order(name: str, chart: DataFrame) -> DataFrame:
    columns = CHART_ORDER.get(name, "").split()
    return chart.orderBy(*[F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in columns]) if columns else chart


def compute_all_kpis(m: Marketplace, cfg: KpiConfig = KpiConfig(), check: bool = True
                     ) -> tuple[DataFrame, dict[str, DataFrame | dict[str, DataFrame]]]:
    """(kpi, charts). With ``check`` the slice is validated first (one small action) and an
    empty slice or a slice without delivered orders raises ValueError, as in the reference."""
    if check:
        require_kpi_ready(m)
    kpi = K.kpi_families(m, K.FAMILY_ORDER, cfg)
    ranked = SG.rfm_ranked(m)  # one ranking serves both RFM tables
    charts: dict[str, DataFrame | dict[str, DataFrame]] = {
        "channel_acq": CH.channel_acq(m), "monthly_active": CH.monthly_active(m), "funnel_counts": CH.funnel_counts(m),
        "gmv_trend": CH.gmv_trend(m), "gmv_trend_daily": CH.gmv_trend_daily(m),
        "orders_trend_daily": CH.orders_trend_daily(m), "cancel_reasons": CH.cancel_reasons(m),
        "restaurant_gmv": CH.restaurant_gmv(m), "restaurant_top10": CH.restaurant_top(m),
        "cuisine_perf": CH.cuisine_perf(m), "city_perf": CH.city_perf(m),
        "cohort_retention": SG.cohort_retention(m), "cohort_matrix": SG.cohort_matrix(m), "cohort_heat": SG.cohort_heat(m),
        "rfm_scores": SG.rfm_scores(m, ranked=ranked), "segment_summary": SG.segment_summary(m, ranked=ranked),
        "rating_dist": CH.rating_dist(m),
        "demo_breakdown": {d: K.demo_breakdown(m, d).orderBy(F.desc("gmv"), d) for d in ("gender", "age_group", "profession", "income_bracket")},
        "gender_age_cross": CH.gender_age_cross(m), "users_by_gender": CH.users_by_gender(m),
        "users_by_profession": CH.users_by_profession(m), "users_by_income": CH.users_by_income(m),
        "unknown_share": CH.unknown_share(m), "growth_trend": CH.growth_trend(m),
    }
    return kpi, {name: c if isinstance(c, dict) else in_order(name, c) for name, c in charts.items()}
