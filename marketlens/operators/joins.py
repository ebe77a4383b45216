"""Join helpers. Sides that may grow carry no broadcast hint: AQE decides from measured sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def scalars(one: DataFrame) -> dict[str, Column]:
    """The columns of a one-row aggregate as scalar subqueries: computed once before the main query,
    inlined as constants (no join, nothing pairs up). Catalyst merges scalar subqueries that read
    the same source into one aggregate pass."""
    packed = one.select(F.struct(*[F.col(f"`{c}`") for c in one.columns]).alias("_s")).scalar()
    return {c: packed[c] for c in one.columns}


def one_row_of(*frames: DataFrame) -> DataFrame:
    """Several one-row aggregates side by side, without a join: stack them (each row carries only
    its own columns, the rest null) and collapse with one aggregate over at most len(frames) rows.
    Each input stays an independent stage, so AQE runs them concurrently."""
    if len(frames) == 1:
        return frames[0]
    names = [c for f in frames for c in f.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in names])
