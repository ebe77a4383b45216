"""The drill-down cube: KPIs of a selection come from it, equal those from orders, and scan no order."""

import pytest
from pyspark.sql import functions as F

from marketlens.model import FilterSpec, KpiConfig
from marketlens.operators import cube as cube_module
from marketlens.operators.cube import DIMENSIONS, order_cube, order_facts, ranged_cube
from marketlens.operators.filters import apply_filters, check_slice, population_counts, scope
from marketlens.plans import charts as CH
from marketlens.plans import kpis as K
from marketlens.plans.inspect import scan_lines
from marketlens.plans.registry import QUERIES, SLICES
from marketlens.sources import tables
from tests.conftest import SF_SMALL

SPECS = [FilterSpec(), SLICES["kpi"], SLICES["orders_in"], SLICES["demographics"], FilterSpec(cities=["none such"])]


@pytest.fixture(scope="module")
def without(small):
    return small.with_(orders=small.orders)


def test_replaced_orders_leave_no_stale_cube(small, without):
    assert small.cube is not None and without.cube is None


@pytest.mark.parametrize("i", range(len(SPECS)))
def test_kpis_of_a_selection_equal_those_from_orders(small, without, i):
    a, b = (apply_filters(m, SPECS[i]) for m in (small, without))
    cfg = KpiConfig(ltv_delivered_only=i == 1)
    families = ["revenue", "retention", "operations", "ab_test", "marketplace", "product"]
    assert K.kpi_families(a, families, cfg).collect() == K.kpi_families(b, families, cfg).collect()
    for counts in (population_counts, check_slice):
        assert sorted(map(tuple, counts(a).collect())) == sorted(map(tuple, counts(b).collect()))
    assert scope(small, SPECS[i]).first() == scope(without, SPECS[i]).first()


@pytest.mark.parametrize("chart", ["gmv_trend_daily", "orders_trend_daily", "city_perf", "cuisine_perf", "restaurant_gmv", "growth_trend", "monthly_active"])
def test_charts_equal_those_from_orders(small, without, chart):
    fn = getattr(CH, chart)
    assert sorted(map(repr, fn(small).collect())) == sorted(map(repr, fn(without).collect()))


@pytest.mark.parametrize("key", ["kpi_filtered", "scope", "filter_population", "kpi_all", "kpi_revenue", "gmv_trend_daily", "growth_trend"])
def test_no_order_is_scanned(spark, key):
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else the paths are cut off
    try:
        lines = scan_lines(QUERIES[key](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", before)
    assert any("/cube]" in line for line in lines) and not any("/orders]" in line for line in lines)


def test_cube_has_one_row_a_cell_and_keeps_null_dimensions(small):
    cube = order_cube(small.orders)
    assert cube.count() == cube.select(*DIMENSIONS).distinct().count()
    facts = order_facts(small.orders)
    for c in ("user_id", "city", "restaurant_id"):
        want = facts.where(F.col(c).isNull()).agg(F.sum("n"), F.sum("value")).first()
        assert want[0] and cube.where(F.col(c).isNull()).agg(F.sum("n"), F.sum("value")).first() == want


@pytest.mark.parametrize("hot_cell", [None, 1])
def test_cube_by_ranges_equals_the_cube(small, monkeypatch, hot_cell):
    """The same cells and sums, whether all of them are added up in their range or those of several orders before."""
    if hot_cell:
        monkeypatch.setattr(cube_module, "HOT_CELL", hot_cell)
    twice = small.orders.unionByName(small.orders.where("order_id % 3 = 0"))
    got, want = ranged_cube(twice, 5), order_cube(twice)
    assert got.dtypes == want.dtypes and got.count() == want.count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_cube_by_ranges_moves_the_orders_once(small):
    """One shuffle, by range, and all aggregation behind it: no task adds up more than its range."""
    plan = ranged_cube(small.orders, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "rangepartitioning(order_date" in plan
    assert plan.index("HashAggregate") < plan.index("Exchange ")


def test_ranges_follow_the_number_of_rows(spark, monkeypatch, tmp_path):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [tables.ranges_for(spark, n) for n in (0, 1, 10**9)] == [least, least, 5000]
    monkeypatch.setattr(tables, "RANGE_ROWS", 50)
    orders = spark.range(1000).selectExpr("id AS order_id", "date_add(date'2020-01-01', cast(id AS int)) AS order_date").selectExpr(
        "*", "date_format(order_date, 'yyyy-MM') AS order_month")
    back = tables.stored("orders", orders, str(tmp_path), rows=1000)
    files = {f.rsplit("/", 1)[1].split("-")[1] for f in back.inputFiles()}
    assert len(files) > 10 and back.exceptAll(orders).isEmpty() and back.count() == 1000
