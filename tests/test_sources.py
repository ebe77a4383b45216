"""Sources and sinks: adapter shape, JDBC option building (no server here), parquet round trips."""

from pyspark.sql import functions as F

from marketlens.sources.adapter import load_raw
from marketlens.sources import jdbc
from marketlens.sources.jdbc import (CONNECT_TIMEOUT_SECONDS, TABLE_MAP, JdbcConfig, base_options, hash_predicates,
                                     key_literal, key_sample_query, keyset_predicates, range_options, split_points)
from marketlens.sources.tables import materialize, read_marketplace, shared_folder, write_results, write_table
from tests.conftest import SF_SMALL


def test_adapter_injects_dirt_and_duplicates(spark):
    raw = load_raw(spark, SF_SMALL)
    users = raw.users
    assert users.count() > users.select("user_id").distinct().count()
    assert users.where(F.col("signup_date").contains("/")).count() > 0
    assert users.where(F.col("gender") == "male").count() > 0
    orders = raw.orders
    assert orders.where(F.col("delivery_fee") < 0).count() > 0
    assert orders.where(F.col("order_value").isNull()).count() > 0
    assert raw.nps.where(F.col("nps_score") > 10).count() > 0


def test_jdbc_options():
    cfg = JdbcConfig(host="db", port=3306, database="shop", user="u", password="p", partitions=4)
    assert cfg.url == f"jdbc:mysql://db:3306/shop?connectTimeout={CONNECT_TIMEOUT_SECONDS * 1000}"
    opts = base_options(cfg, TABLE_MAP["orders"])
    assert opts["dbtable"] == "orders_tbl" and opts["driver"] == "com.mysql.cj.jdbc.Driver"
    assert hash_predicates("user_id", 3) == ["MOD(CRC32(user_id), 3) = 0 OR user_id IS NULL", "MOD(CRC32(user_id), 3) = 1",
                                             "MOD(CRC32(user_id), 3) = 2"]
    assert range_options("order_id", 1, 99, 4) == {"partitionColumn": "order_id", "lowerBound": "1",
                                                   "upperBound": "100", "numPartitions": "4"}


def parts_of(df, key, predicates):
    """How many predicates each row meets, and the rows of each."""
    met = [F.expr(p) for p in predicates]
    times = df.select(sum(F.coalesce(m, F.lit(False)).cast("int") for m in met).alias("n")).groupBy("n").count().collect()
    sizes = df.agg(*[F.count_if(m).alias(f"p{i}") for i, m in enumerate(met)]).first()
    return {r["n"]: r["count"] for r in times}, list(sizes)


def test_ranges_of_a_string_key_meet_every_row_once(spark):
    orders = load_raw(spark, SF_SMALL).orders.select(F.concat(F.lit("O-"), "order_id").alias("order_id"))
    ordered = sorted(r.order_id for r in orders.collect() if r.order_id is not None)
    predicates = keyset_predicates("order_id", split_points(ordered[::7], 8))
    times, sizes = parts_of(orders, "order_id", predicates)
    assert len(predicates) == 8 and times == {1: orders.count()}
    assert max(sizes) < 2 * min(sizes)


def test_ranges_with_nulls_quotes_and_a_hot_key(spark):
    keys = ["it's", "back\\slash", "", "a", "A", "é", "~", None, None] + ["hot"] * 40 + [f"k{i:03d}" for i in range(40)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    ordered = sorted((k for k in keys if k is not None), key=str.encode)
    for n in (2, 5, 30, 200):
        predicates = keyset_predicates("k", split_points(ordered, n))
        times, sizes = parts_of(df, "k", predicates)
        assert times == {1: len(keys)} and len(predicates) <= n
        assert n < 5 or sum(size >= 40 for size in sizes) == 1  # the hot key is one range and cannot be split
    assert split_points([], 4) == [] and keyset_predicates("k", []) == []
    assert split_points(["same"] * 9, 4) == ["same"]


def test_keys_as_literals_and_the_sample():
    assert key_literal(17, "mysql") == "17" and key_literal("it's", "mysql") == "'it''s'"
    assert key_literal("a\\", "mysql") == "'a\\\\'" and key_literal("a\\", "postgresql") == "'a\\'"
    query = key_sample_query("order_id", "orders_tbl", 0.25, "mysql")
    assert "ORDER BY order_id" in query and "IS NOT NULL AND RAND() < 0.25" in query
    assert "RANDOM() < " in key_sample_query("order_id", "orders_tbl", 0.25, "postgresql")


class Answers:
    """Stands in for a session: answers the two queries of a split, the sample out of order."""

    def __init__(self, keys):
        self.keys, self.asked = keys, []

    @property
    def read(self):
        return self

    def format(self, name):
        return self

    def options(self, **options):
        self.asked.append(options["dbtable"])
        return self

    def load(self):
        return self

    def collect(self):
        if "count(" in self.asked[-1]:
            return [{"n": len(self.keys)}]
        return [{"k": k, "place": i + 1} for i, k in enumerate(self.keys)][::-1]


def test_ranges_keep_the_order_of_the_database():
    """Under a collation that ignores case, b stands before C: cuts follow the places, not the code points."""
    cfg = JdbcConfig(host="db", port=3306, database="shop", user="u", password="p", partitions=2)
    session = Answers(["a", "b", "C", "d"])
    assert jdbc.sampled_ranges(session, cfg, base_options(cfg, "orders_tbl"), "order_id", "orders_tbl") == [
        "order_id < 'C' OR order_id IS NULL", "order_id >= 'C'"]
    assert "RAND() < 1.0" in session.asked[1]
    assert jdbc.sampled_ranges(Answers([]), cfg, base_options(cfg, "orders_tbl"), "order_id", "orders_tbl") == []


def test_materialize_round_trip(spark, small):
    again = materialize(small, shared_folder(spark, "test"))
    for name in ("users", "orders", "events", "nps"):
        a, b = getattr(small, name), getattr(again, name)
        # a stored table has no column that forbids null, a computed column may
        assert [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema]
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_write_results_and_read_marketplace(spark):
    root = shared_folder(spark, "results")
    paths = write_results({"one": spark.range(3)}, root)
    assert spark.read.parquet(paths["one"]).count() == 3
    raw = load_raw(spark, SF_SMALL)
    folder = shared_folder(spark, "raw")
    for name in ("users", "restaurants", "riders", "orders", "events", "nps"):
        write_table(getattr(raw, name), f"{folder}/{name}")
    back = read_marketplace(spark, folder)
    assert back.orders.count() == raw.orders.count()


def test_cluster_conf_scales_partitions():
    from marketlens.session import cluster_conf

    big = cluster_conf(100 * 10**12, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 10**12 // (256 << 20) == 372_529
    mid = cluster_conf(10 * 10**12, 8000)
    assert int(mid["spark.sql.shuffle.partitions"]) == 10 * 10**12 // (256 << 20)
    small = cluster_conf(10**9, 64)
    assert int(small["spark.sql.shuffle.partitions"]) == 200


def test_refresh_job_writes_every_result(spark):
    from marketlens.jobs import refresh

    out = shared_folder(spark, "refresh")
    paths = refresh(load_raw(spark, SF_SMALL), out)
    assert {"kpi", "kpi_long", "cohort_matrix", "demo_breakdown_gender", "growth_trend"} <= set(paths)
    assert spark.read.parquet(paths["kpi_long"]).count() == 61
    assert spark.read.parquet(paths["kpi"]).count() == 1
    shown = [r.new_users for r in spark.read.parquet(paths["channel_acq"]).collect()]
    assert shown == sorted(shown, reverse=True)


def test_refresh_reads_stored_tables(spark):
    from marketlens.jobs import arguments, raw_tables

    raw, root = load_raw(spark, SF_SMALL), shared_folder(spark, "raw")
    for name in ("users", "restaurants", "riders", "orders", "events", "nps"):
        getattr(raw, name).write.parquet(f"{root}/{name}")
    got = raw_tables(spark, arguments(["--tables", root, "--out", "unused"]))
    assert got.orders.count() == raw.orders.count() and got.nps.columns == raw.nps.columns


def test_cleaning_caches_nothing(spark):
    from marketlens.operators.clean import clean

    m = clean(load_raw(spark, SF_SMALL))
    assert not any(df.is_cached for df in (m.orders, m.users, m.events, m.nps))
    back = materialize(m, shared_folder(spark, "cleaned"))
    assert back.orders.count() == m.orders.count()


def test_adapter_keeps_every_order(spark):
    """Orders without line items stay, with no restaurant; copies without their value never survive."""
    from marketlens.operators.dedup import keep_first

    raw = load_raw(spark, SF_SMALL).orders
    total = spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()
    kept = keep_first(raw, "order_id")
    assert kept.count() == total
    assert raw.where("restaurant_id IS NULL AND items_count = 0").count() > 0
    assert raw.where("user_id IS NULL").count() > 0
    without = raw.where("order_value IS NULL AND order_id % 400 = 11 AND order_id % 200 <> 1").select("order_id")
    assert without.count() > 0
    assert kept.join(without, "order_id").where("order_value IS NULL").count() == 0


def test_later_copies_lose_by_arrival(spark):
    from marketlens.operators.dedup import keep_first

    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "z"), (2, 5, None), (2, 6, "a")], "k long, seen long, v string")
    assert {r.k: r.v for r in keep_first(df, "k", ["seen"]).collect()} == {1: "z", 2: None}
    assert {r.k: r.v for r in keep_first(df.drop("seen"), "k").collect()} == {1: "b", 2: "a"}
