"""Batch refresh job: the Spark counterpart of the dashboard's daily reload.

raw tables -> cleaned, stored tables -> every KPI and chart table for one filter selection ->
parquet, one folder per result. Writes are independent jobs and are submitted together.

    spark-submit ... -m marketlens.jobs --tables /shared/raw --out /shared/marketlens/2026-12-02
    python -m marketlens.jobs --sf-dir /root/testdata/sf0.1 --out /tmp/marketlens

Raw tables come from Parquet folders named after the six tables (--tables), from a database
(--jdbc-host and the like; the password from --jdbc-password-file), or from the star-schema test
tables (--sf-dir). Under spark-submit the session is the cluster's; otherwise it is a local one.
"""

from __future__ import annotations

import argparse
from concurrent.futures import ThreadPoolExecutor

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

from marketlens import api
from marketlens.model import FilterSpec, KpiConfig, Marketplace
from marketlens.plans.kpis import FAMILY_ORDER, family_of_columns, to_long
from marketlens.session import build_session
from marketlens.sources.adapter import load_raw
from marketlens.sources.jdbc import JdbcConfig, load_from_database
from marketlens.sources.tables import materialize, read_marketplace, write_table


def results(m: Marketplace, spec: FilterSpec | None = None, cfg: KpiConfig = KpiConfig()) -> dict[str, DataFrame]:
    """Named result tables for a slice: kpi (wide, one row) and every chart (demo breakdowns flattened).
    The slice is written once; every chart reads it instead of filtering the tables again."""
    kpi, charts = api.compute_all_kpis(m if spec is None else materialize(api.filter_data(m, spec)), cfg)
    out = {"kpi": kpi}
    for name, chart in charts.items():
        if isinstance(chart, dict):
            out.update({f"{name}_{k}": v for k, v in chart.items()})
        else:
            out[name] = chart
    return out


def refresh(raw: Marketplace, out_root: str, spec: FilterSpec | None = None, cfg: KpiConfig = KpiConfig(),
            threads: int = 8) -> dict[str, str]:
    """Clean and store the tables, compute and write all results; returns name -> path.

    The wide KPI row is written first; the long form is derived from that written row, so the 61
    KPIs are computed once."""
    m = api.clean_data(raw)
    tables = results(m, spec, cfg)
    root = out_root.rstrip("/")
    paths = {name: f"{root}/{name}" for name in tables}
    write_table(tables.pop("kpi"), paths["kpi"])
    spark = m.orders.sparkSession
    wide = spark.read.parquet(paths["kpi"])
    tables["kpi_long"] = to_long(wide, family_of_columns(cfg, wide.columns))
    paths["kpi_long"] = f"{root}/kpi_long"
    with ThreadPoolExecutor(max_workers=threads) as pool:
        list(pool.map(lambda n: write_table(tables[n], paths[n]), tables))
    return paths


def raw_tables(spark: SparkSession, args: argparse.Namespace) -> Marketplace:
    if args.tables:
        return read_marketplace(spark, args.tables)
    if args.jdbc_host:
        with open(args.jdbc_password_file, encoding="utf-8") as f:
            password = f.read().strip()
        return load_from_database(spark, JdbcConfig(host=args.jdbc_host, port=args.jdbc_port, database=args.jdbc_database,
                                                    user=args.jdbc_user, password=password))
    return load_raw(spark, args.sf_dir)


def session() -> SparkSession:
    """That of spark-submit where it names a master, else a local one."""
    return SparkSession.builder.getOrCreate() if SparkConf().contains("spark.master") else build_session()


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    source = ap.add_mutually_exclusive_group(required=True)
    source.add_argument("--tables", help="folder with the six raw tables as Parquet")
    source.add_argument("--jdbc-host", help="database host")
    source.add_argument("--sf-dir", help="folder with the star-schema parquet tables")
    ap.add_argument("--jdbc-port", type=int, default=3306)
    ap.add_argument("--jdbc-database", default="")
    ap.add_argument("--jdbc-user", default="")
    ap.add_argument("--jdbc-password-file", default="")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    return ap.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    paths = refresh(raw_tables(session(), args), args.out)
    print(f"wrote {len(paths)} tables ({', '.join(FAMILY_ORDER)} KPIs and charts) under {args.out}")


if __name__ == "__main__":
    main()
