"""The operators that SQL can express against DuckDB on sf0.001."""

import pytest

from marketlens.llm.oracle import ORACLE_SQL
from marketlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_operator_matches_sql(spark, key):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    con.execute(f"CREATE VIEW result AS {ORACLE_SQL[key]}")
    got = QUERIES[key](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM result").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
