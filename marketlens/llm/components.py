"""Connected components of a graph that only ever exists as a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.store import written


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a long, b long); component is the smallest node
    reachable, itself included.

    Alternating large-star and small-star steps: every step only replaces links by links to smaller
    nodes, so their number stays bounded by that of the first, and the number of rounds grows with
    the logarithm of the longest path; links that are stars already need none. Each step's smallest
    neighbour is an aggregate combined on the map side, so a node with a third of all links is
    one row per task there, and the joins back are ones whose skewed partitions Spark splits. Each
    round is written, nothing is collected.
    """
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .filter("a <> b").distinct(), "links")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = written(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = written(small, "small-star")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _stars(links: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or none, and none has both a smaller and a larger."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    per_node = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return per_node.filter("down > 1 OR (down = 1 AND up = 1)").isEmpty()
