"""Incremental refresh of orders: new files are merged in, and only the months they touch are written again.

The state is a folder of versions and a manifest. A version holds, for the months it wrote, the surviving raw
orders (with their month) and the cube of their facts; the manifest says which version each month is
current in, and is replaced last, so a refresh that dies leaves the state as it was. Orders may come late, undated
(they live in the null month) or as corrections: a copy of a stored order is merged with it by the rule of
the batch job, whatever month either of them lies in, so state and batch recompute hold the same rows.

The upper fence is a quantile of all values, so it moves with every batch. The cube therefore sums only orders up to
``threshold``, which lies below the fence; the few above it are capped and added when read. Should the
fence fall below the threshold, all months' cubes are summed again with a lower one.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.dates import lenient_timestamp
from marketlens.model import Marketplace
from marketlens.operators.clean import cap_values, dated, order_value_fence, parse_orders
from marketlens.operators.cube import order_cube, order_facts
from marketlens.operators.dedup import keep_first, smallest_row
from marketlens.sources.tables import shared_folder, staged

MARGIN = 0.9  # threshold as a share of the fence when the cube is summed


@dataclass(frozen=True)
class OrderState:
    """What the manifest says. Months are their text, "" for the null month."""

    root: str
    version: int
    orders: dict[str, int] = field(default_factory=dict)  # month -> version that holds it
    cubes: dict[str, int] = field(default_factory=dict)
    fence: float | None = None
    threshold: float = 0.0


def _with_month(raw: DataFrame) -> DataFrame:
    """Raw orders and the month they are stored under."""
    return raw.withColumn("order_month", F.date_format(lenient_timestamp(raw, "order_placed_time"), "yyyy-MM"))


def _month(c: str = "order_month"):
    return F.coalesce(F.col(c), F.lit(""))


def _read(spark: SparkSession, state: OrderState, name: str, like: DataFrame, months: list[str] | None = None) -> DataFrame:
    """Current rows of table ``name``, of some months or all."""
    held = getattr(state, name)
    wanted: dict[int, list[str]] = {}
    for month, version in held.items():
        if months is None or month in months:
            wanted.setdefault(version, []).append(month)
    out = spark.createDataFrame([], like.schema)
    for version, some in sorted(wanted.items()):
        part = spark.read.schema(like.schema).parquet(f"{state.root}/v{version}/{name}").select(*like.columns)
        named = [m for m in some if m]
        keep = F.col("order_month").isin(named) if named else F.lit(False)
        out = out.unionByName(part.filter(keep | F.col("order_month").isNull()) if "" in some else part.filter(keep))
    return out


def _write(df: DataFrame, state: OrderState, name: str) -> None:
    (df.repartition("order_month", F.pmod(F.xxhash64("user_id", "restaurant_id"), F.lit(8)))  # a hot month is eight files
     .write.mode("overwrite").partitionBy("order_month").parquet(f"{state.root}/v{state.version}/{name}"))


def _usable(raw: DataFrame) -> DataFrame:
    """Stored raw orders as the batch job parses them, not capped."""
    return dated(parse_orders(raw.drop("order_month")))


class IncrementalOrders:
    """Orders kept clean by increments. ``raw`` gives the columns of the raw table."""

    def __init__(self, spark: SparkSession, raw_schema, state: OrderState):
        self.spark, self.schema, self.state = spark, raw_schema, state
        self._raw = _with_month(spark.createDataFrame([], raw_schema))
        self._cube = order_cube(_usable(self._raw))

    @classmethod
    def start(cls, raw: DataFrame, root: str | None = None) -> IncrementalOrders:
        spark = raw.sparkSession
        made = cls(spark, raw.schema, OrderState(root or shared_folder(spark, "incremental"), -1))
        made.refresh(raw)
        return made

    @classmethod
    def load(cls, spark: SparkSession, raw_schema, root: str) -> IncrementalOrders:
        text = "\n".join(r["value"] for r in spark.read.text(f"{root}/manifest").orderBy("value").collect())
        latest = max((json.loads(line) for line in text.splitlines()), key=lambda s: s["version"])
        return cls(spark, raw_schema, OrderState(root, **latest))

    def raw_orders(self, months: list[str] | None = None) -> DataFrame:
        return _read(self.spark, self.state, "orders", self._raw, months)

    def refresh(self, arrived: DataFrame) -> list[str]:
        """Merge ``arrived`` raw orders; the months written. A month that none of them touches is not read but for the
        order ids and values, nor written."""
        before = self.state
        now = replace(before, version=before.version + 1, orders=dict(before.orders), cubes=dict(before.cubes))
        new = staged(_with_month(keep_first(arrived, "order_id")), "arrived")
        ids = new.select(F.col("order_id").alias("_id"))
        stored = self.raw_orders()
        same = F.col("order_id").eqNullSafe(F.col("_id"))
        again = staged(stored.join(ids, same, "left_semi"), "corrected")
        touched = sorted({r["m"] for r in new.unionByName(again).select(_month().alias("m")).distinct().collect()})  # calendar months
        if not touched:
            return []
        merged = smallest_row(new.unionByName(again), "order_id")
        rest = self.raw_orders(touched).join(ids, same, "left_anti")
        _write(rest.unionByName(merged), now, "orders")
        now.orders.update(dict.fromkeys(touched, now.version))
        self.state = now
        self._sum_up(touched)
        line = {k: v for k, v in vars(self.state).items() if k != "root"}
        self.spark.createDataFrame([(json.dumps(line),)], "value string").coalesce(1).write.mode("append").text(f"{now.root}/manifest")
        return touched

    def _sum_up(self, touched: list[str]) -> None:
        """The fence of all values, and the cubes of the touched months (of all, if the fence fell below the threshold)."""
        fence = order_value_fence(_usable(self.raw_orders())).first()["upper_fence"]
        months, threshold = touched, self.state.threshold
        if fence is None or fence < threshold or not self.state.cubes:
            months, threshold = list(self.state.orders), (fence or 0.0) * MARGIN
        self.state = replace(self.state, fence=fence, threshold=threshold)
        low = _usable(self.raw_orders(months)).filter(F.col("order_value") <= threshold)
        _write(order_cube(low), self.state, "cubes")
        self.state.cubes.update(dict.fromkeys(months, self.state.version))

    def orders(self) -> DataFrame:
        """Clean orders, capped at the fence of now."""
        return cap_values(_usable(self.raw_orders()), F.lit(self.state.fence).cast("double"))

    def facts(self) -> DataFrame:
        """Fact rows of all orders: the stored cubes, and the orders above the threshold as they are."""
        high = self.orders().filter(F.col("order_value") > self.state.threshold)
        return _read(self.spark, self.state, "cubes", self._cube).unionByName(order_facts(high))

    def marketplace(self, others: Marketplace) -> Marketplace:
        """``others`` with these orders and their facts."""
        return others.with_(orders=self.orders(), cube=self.facts())
