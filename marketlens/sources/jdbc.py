"""JDBC source for the six marketplace tables (the reference's live-database path).

Each table is read with Spark's JDBC data source. Large tables are read in parallel: a numeric
key is split into ``numPartitions`` ranges (bounds from one pushed-down min/max query), any other
key into ranges between sampled keys, which its index serves, so no single task pulls a whole table and
no part scans more than its own rows.
Filters and column pruning of later queries are pushed into the database by Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession

from marketlens.model import Marketplace

# Logical table -> physical table name of the database (overridable per call)
TABLE_MAP = {
    "users": "users_tbl",
    "restaurants": "restaurants_tbl",
    "delivery_partners": "delivery_partners_tbl",
    "orders": "orders_tbl",
    "app_events": "event_id_tbl",
    "nps_responses": "nps_responses_tbl",
}
# logical table -> Marketplace field
FIELD_OF = {"users": "users", "restaurants": "restaurants", "delivery_partners": "riders", "orders": "orders",
            "app_events": "events", "nps_responses": "nps"}
# key used to split each table's read; None = single partition (small dimension tables)
SPLIT_KEYS = {"users": "user_id", "orders": "order_id", "app_events": "event_id", "nps_responses": "response_id",
              "restaurants": None, "delivery_partners": None}
CONNECT_TIMEOUT_SECONDS = 8


@dataclass(frozen=True)
class JdbcConfig:
    host: str
    port: int
    database: str
    user: str
    password: str
    dialect: str = "mysql"
    driver: str = "com.mysql.cj.jdbc.Driver"
    partitions: int = 64  # of a table split by a range of a numeric key, which an index serves
    sample_per_part: int = 200  # keys drawn for each part of a table split by ranges of a string key
    keyset: bool = True  # False where the database has no window functions: string keys are then split by a hash
    hash_partitions: int = 4  # of a table split by a hash: each is a scan of the whole table in the database
    fetch_size: int = 10_000
    numeric_keys: frozenset[str] = field(default_factory=frozenset)  # logical tables whose split key is numeric

    @property
    def url(self) -> str:
        return (f"jdbc:{self.dialect}://{self.host}:{self.port}/{self.database}"
                f"?connectTimeout={CONNECT_TIMEOUT_SECONDS * 1000}")


def base_options(cfg: JdbcConfig, table: str) -> dict[str, str]:
    return {"url": cfg.url, "dbtable": table, "user": cfg.user, "password": cfg.password, "driver": cfg.driver,
            "fetchsize": str(cfg.fetch_size)}


def hash_predicates(key: str, n: int) -> list[str]:
    """One WHERE clause per partition, splitting rows by a hash of a (string) key inside MySQL; rows
    without a key are read by the first."""
    return [f"MOD(CRC32({key}), {n}) = {i}" + (f" OR {key} IS NULL" if i == 0 else "") for i in range(n)]


def key_literal(key: str | int, dialect: str) -> str:
    """``key`` as a literal: a number as it is, a string in quotes; MySQL also reads backslashes as escapes."""
    if isinstance(key, int):
        return str(key)
    return "'" + (key.replace("\\", "\\\\") if dialect == "mysql" else key).replace("'", "''") + "'"


def key_sample_query(key: str, table: str, share: float, dialect: str) -> str:
    """About that share of the keys, read from the key's index alone, with their place in the database's own
    order: only its collation tells which key is smaller."""
    draw = "RANDOM()" if dialect == "postgresql" else "RAND()"
    return (f"(SELECT {key} AS k, ROW_NUMBER() OVER (ORDER BY {key}) AS place FROM {table} "
            f"WHERE {key} IS NOT NULL AND {draw} < {share:.12f}) s")


def split_points(ordered: list[str], n: int) -> list[str]:
    """At most n - 1 keys that cut ``ordered`` into n parts of about one size; a key that is more than
    a part of its own cuts once."""
    cuts = [ordered[i * len(ordered) // n] for i in range(1, n)] if ordered else []
    return list(dict.fromkeys(cuts))


def keyset_predicates(key: str, cuts: list[str], dialect: str = "mysql") -> list[str]:
    """One WHERE clause per range between neighbouring cuts. Every row meets exactly one of them, as long as
    the cuts ascend in the database's order; rows without a key are read by the first."""
    if not cuts:
        return []
    at = [key_literal(c, dialect) for c in cuts]
    return [f"{key} < {at[0]} OR {key} IS NULL", *(f"{key} >= {a} AND {key} < {b}" for a, b in zip(at[:-1], at[1:], strict=True)),
            f"{key} >= {at[-1]}"]


def range_options(key: str, lower: int, upper: int, n: int) -> dict[str, str]:
    return {"partitionColumn": key, "lowerBound": str(lower), "upperBound": str(upper + 1), "numPartitions": str(n)}


def read_table(spark: SparkSession, cfg: JdbcConfig, logical: str, physical: str) -> DataFrame:
    opts = base_options(cfg, physical)
    key = SPLIT_KEYS.get(logical)
    reader = spark.read.format("jdbc").options(**opts)
    ranged = logical in cfg.numeric_keys
    if key is None or (cfg.partitions if ranged or cfg.keyset else cfg.hash_partitions) <= 1:
        return reader.load()
    if ranged:
        bounds = (spark.read.format("jdbc")
                  .options(**{**opts, "dbtable": f"(SELECT min({key}) AS lo, max({key}) AS hi FROM {physical}) b"})
                  .load().first())
        if bounds is None or bounds["lo"] is None:
            return reader.load()
        return reader.options(**range_options(key, int(bounds["lo"]), int(bounds["hi"]), cfg.partitions)).load()
    predicates = sampled_ranges(spark, cfg, opts, key, physical) if cfg.keyset else hash_predicates(key, cfg.hash_partitions)
    if not predicates:
        return reader.load()
    props = {k: v for k, v in opts.items() if k not in ("url", "dbtable")}
    return spark.read.jdbc(cfg.url, physical, predicates=predicates, properties=props)


def sampled_ranges(spark: SparkSession, cfg: JdbcConfig, opts: dict[str, str], key: str, physical: str) -> list[str]:
    """Ranges of a string key from a sample of about ``partitions * sample_per_part`` keys."""
    def ask(query: str) -> list[Row]:
        return spark.read.format("jdbc").options(**{**opts, "dbtable": query}).load().collect()

    keys = ask(f"(SELECT count({key}) AS n FROM {physical}) c")[0]["n"]
    share = min(1.0, cfg.partitions * cfg.sample_per_part / max(1, keys))
    drawn = sorted(ask(key_sample_query(key, physical, share, cfg.dialect)), key=lambda r: r["place"])
    return keyset_predicates(key, split_points([r["k"] for r in drawn], cfg.partitions), cfg.dialect)


def load_from_database(spark: SparkSession, cfg: JdbcConfig, table_map: dict[str, str] | None = None) -> Marketplace:
    """The six raw tables; raises (from the driver or the server) when a table cannot be read."""
    table_map = table_map or TABLE_MAP
    frames = {FIELD_OF[logical]: read_table(spark, cfg, logical, physical) for logical, physical in table_map.items()}
    return Marketplace(**frames)
