"""Parquet tables: write results, and materialise the cleaned marketplace in shared storage.

Writing the cleaned tables once cuts the lineage (a lost executor re-reads parquet instead of
re-running deduplication and the fence), and every later query starts from a parquet scan with
column pruning, pushed-down filters and, for orders, month partitions that date filters prune.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from marketlens.model import TABLE_NAMES, Marketplace
from marketlens.session import checkpoint_dir


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's checkpoint folder (shared storage on a cluster)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/marketlens-{label}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Read a table written by ``write_table`` back with the original schema and column order."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, its lineage cut there."""
    path = shared_folder(df.sparkSession, label)
    write_table(df, path)
    return read_table(df.sparkSession, path, df)


#: Orders, or cells of their cube, that a task of a ranged write holds: it sorts and adds them up in memory.
RANGE_ROWS = 200_000
TIES = {"orders": ("order_id",), "cube": ("user_id", "restaurant_id")}


def ranges_for(spark: SparkSession, rows: int) -> int:
    """Ranges for so many rows: the session's shuffle partitions, more where those would hold over RANGE_ROWS rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))


def stored(name: str, df: DataFrame, root: str, rows: int = 0, placed: bool = False) -> DataFrame:
    """``df`` written as table ``name`` under ``root`` and read back.

    Dated orders, and their cube, are range-partitioned on the date and a tie-break before the write, so each task
    holds a contiguous date range and writes few month folders (no small-file explosion), and a hot day is
    split across tasks. Where the number of ``rows`` is known, a task holds a bounded number of them; those that
    are ``placed`` by date already are written where they stand.
    """
    spark, path = df.sparkSession, f"{root}/{name}"
    if name in TIES and "order_month" in df.columns:
        ranged = df if placed else df.repartitionByRange(ranges_for(spark, rows), "order_date", *TIES[name])
        write_table(ranged, path, ["order_month"])
    else:
        write_table(df, path)
    return read_table(spark, path, df)


def materialize(m: Marketplace, root: str | None = None) -> Marketplace:
    """Write every table of ``m`` as parquet and return the tables read back. The six writes are independent
    jobs and are submitted together, so small tables do not wait behind orders."""
    root = root or shared_folder(m.orders.sparkSession, "clean")
    with ThreadPoolExecutor(max_workers=len(TABLE_NAMES)) as pool:
        tables = pool.map(lambda name: stored(name, getattr(m, name), root), TABLE_NAMES)
        out = Marketplace(**dict(zip(TABLE_NAMES, tables, strict=True)))
    return out if m.cube is None else out.with_(cube=stored("cube", m.cube, root))


def source_version(spark: SparkSession, paths: list[str]) -> tuple:
    """(path, length, modification time) of every file under ``paths``, by one listing: changes when a source does."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            continue
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def write_results(results: dict[str, DataFrame], root: str) -> dict[str, str]:
    """Write named result tables (KPI rows, chart tables) as parquet; returns name -> path."""
    paths = {}
    for name, df in results.items():
        paths[name] = f"{root.rstrip('/')}/{name}"
        write_table(df, paths[name])
    return paths


def read_marketplace(spark: SparkSession, root: str) -> Marketplace:
    """Six raw tables stored as parquet folders named after the Marketplace fields."""
    return Marketplace(**{name: spark.read.parquet(f"{root.rstrip('/')}/{name}") for name in TABLE_NAMES})
