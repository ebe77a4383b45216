"""Every registered query against its DuckDB oracle on sf0.001 (the driver's gate, run at sf0.01)."""

import os

import pytest

import __spark_entry__ as entry
from marketlens.plans.registry import QUERIES
from tests.conftest import SF_SMALL
from tools.check_oracle import TABLES, digest

KEYS = sorted(QUERIES)
CANON = {"bigint": "int64", "int": "int32", "integer": "int32", "double": "float64", "string": "string",
         "varchar": "string", "boolean": "bool", "date": "date", "timestamp_ntz": "timestamp", "timestamp": "timestamp"}


def _canon(t: str) -> str:
    return CANON.get(t.lower(), t.lower())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_every_query_has_an_oracle():
    assert set(KEYS) <= set(entry.oracle_sql()) and set(KEYS) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(KEYS) == 61


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    sdf = entry.queries()[key](spark, SF_SMALL)
    s_names, s_rows = sdf.columns, [tuple(r) for r in sdf.collect()]
    cur = duck.execute(entry.oracle_sql()[key])
    d_names, d_rows = [c[0] for c in cur.description], cur.fetchall()
    assert sorted(s_names) == sorted(d_names)
    assert len(s_rows) == len(d_rows)
    assert digest(s_names, s_rows, None) == digest(d_names, d_rows, None)
    rel = duck.sql(entry.oracle_sql()[key])
    d_types = {n: _canon(str(t)) for n, t in zip(rel.columns, rel.types)}
    assert {f.name: _canon(f.dataType.simpleString()) for f in sdf.schema.fields} == d_types


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["family", "kpi", "value", "value_text"]
    assert df.count() == 61
