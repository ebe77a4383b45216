"""Activity, retention and cohorts from calendar bitmaps, against plain Python over dates."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketlens.model import KpiConfig
from marketlens.operators.rollups import iso_weeks, user_rollup
from marketlens.plans import kpis as K
from marketlens.plans import segments as SG
from marketlens.plans.inspect import physical_plan
from marketlens.plans.registry import QUERIES
from tests.conftest import SF_SMALL

#: Every kind of year's end: weeks 52, 53 and 1 across it, leap days, the first and last bit of each word.
EDGES = [dt.date(y, 1, 1) + dt.timedelta(days=d) for y in (1969, 1970, 2000, 2015, 2016, 2020, 2021, 2023, 2024, 2025)
         for d in (-32, -31, -30, -8, -7, -4, -3, -2, -1, 0, 1, 2, 3, 6, 7, 29, 30, 31, 59, 61, 62, 123, 124, 364, 365)]


def orders_of(spark, days: dict):
    """Fact rows of plain orders."""
    rows = [(u, d) for u, dates in days.items() for d in dates]
    return spark.createDataFrame(rows, "user_id long, order_date date").select(
        "user_id", "order_date", F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("n_delivered"), F.lit(0).cast("long").alias("n_scheduled"),
        *[F.lit(1).cast("decimal(22,6)").alias(c) for c in ("value", "net", "gmv")])


def expected(dates):
    known = sorted({d for d in dates if d})
    undated = any(d is None for d in dates)
    offsets = [(d - known[0]).days for d in known]
    return (len(dates), known[0] if known else None, known[-1] if known else None, len(known) + undated,
            len({(d.year, d.isocalendar()[1]) for d in known}) + undated, len({(d.year, d.month) for d in known}) + undated,
            int(any(1 <= o <= 7 for o in offsets)), int(any(1 <= o <= 30 for o in offsets)))


@pytest.fixture(scope="module")
def days():
    rnd = random.Random(4)
    out = {u: [rnd.choice(EDGES) for _ in range(rnd.randint(1, 6))] + [None] * (u % 9 == 0) for u in range(300)}
    # pairs a known number of days apart, over every edge
    out |= {1000 + i: [d, d + dt.timedelta(days=g)] for i, (d, g) in enumerate((d, g) for d in EDGES[::3] for g in (0, 1, 7, 8, 30, 31))}
    out |= {5000: [None, None], None: [EDGES[0], EDGES[3], None]}
    return out


def test_rollup_equals_plain_dates(spark, days):
    got = {r.user_id: (r.n_orders, r.first_order_date, r.last_order_date, r.active_days, r.active_weeks, r.active_months, r.retained_d7, r.retained_d30)
           for r in user_rollup(orders_of(spark, days)).collect()}
    assert got == {u: expected(d) for u, d in days.items()}


def test_iso_weeks_cross_the_year(spark, days):
    got = {r.user_id: r.iso_weeks for r in iso_weeks(orders_of(spark, days), "user_id").collect()}
    assert got == {u: len({d.isocalendar()[:2] if d else None for d in dates}) for u, dates in days.items()}


@pytest.mark.parametrize("mode", ["reference", "iso"])
def test_active_means_equal_plain_sets(spark, small, mode):
    rows = [(r.user_id, r.order_date) for r in small.orders.select("user_id", "order_date").collect()]
    k = K.kpi_engagement(small, KpiConfig(week_key=mode)).first()

    def mean(period):
        pairs = {(u, period(d) if d else None) for u, d in rows}
        return len(pairs) / len({p for _, p in pairs})

    week = (lambda d: (d.year, d.isocalendar()[1])) if mode == "reference" else (lambda d: d.isocalendar()[:2])
    assert (k.avg_dau, k.avg_wau, k.avg_mau) == pytest.approx((mean(lambda d: d), mean(week), mean(lambda d: (d.year, d.month))), rel=1e-14)


def test_unknown_week_mode_is_refused(small):
    with pytest.raises(ValueError):
        K.kpi_engagement(small, KpiConfig(week_key="lunar"))


@pytest.mark.parametrize("key", ["kpi_engagement", "kpi_retention", "cohort_retention", "cohort_matrix", "rfm_scores"])
def test_no_sets_and_no_windows(spark, key):
    plan = physical_plan(QUERIES[key](spark, SF_SMALL))
    assert "ObjectHashAggregate" not in plan and "Window" not in plan and "collect_set" not in plan


def test_cohort_heat_is_the_matrix(spark, small):
    heat = {r.cohort_month: dict(zip(r.heat_cols, r.heat_data)) for r in SG.cohort_heat(small).collect()}
    grid = {}
    for r in SG.cohort_matrix(small).collect():
        grid.setdefault(r.cohort_month, {})[r.month_offset] = r.retention_pct
    assert heat == grid and len({tuple(v) for v in heat.values()}) == 1
