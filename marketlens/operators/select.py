"""Exact selection by rank: a radix select over order-preserving integer keys.

To find the row of a given rank nothing is sorted, ranked or shuffled as rows. A pass is one hash
aggregate that counts the rows of at most BUCKETS equal key intervals (and keeps each interval's least
and largest keys); the wanted rank lies in one of them, which the next pass cuts again. A pass narrows
an interval by BUCKETS, so a 64-bit key needs at most six passes at any number of rows. What
reaches the driver is at most BUCKETS counts an open interval.

Keys are lists of longs compared in order: the rank among equal first keys is settled by the second
one, and so on, so a value that fills half the column costs no more than any other.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
_NAN = (1 << 63) - 1


def ordered_long(c: Column) -> Column:
    """A double as the 64-bit integer that orders like it: the bits of its magnitude, negated for negative
    values; -0.0 equals 0.0, NaN is the largest. Arithmetic only, exact: dividing by a power of two loses nothing."""
    a = F.abs(c)
    guess = F.floor(F.log2(a)).cast("int")
    power = F.pow(F.lit(2.0), guess)  # the logarithm is rounded, so the exponent may be one off
    exponent = F.when(power > a, guess - 1).when(power * 2 <= a, guess + 1).otherwise(guess)
    fraction = (a / F.pow(F.lit(2.0), exponent) - 1) * float(1 << 52)
    normal = F.shiftleft((exponent + 1023).cast("long"), 52) + fraction.cast("long")
    tiny = (a * 2.0 ** 537 * 2.0 ** 537).cast("long")
    magnitude = (F.when(a == 0, F.lit(0)).when(a < 2.0 ** -1022, tiny).when(a == float("inf"), F.lit(0x7FF << 52)).otherwise(normal)).cast("long")
    return F.when(F.isnan(c), F.lit(_NAN)).when(c < 0, -magnitude).otherwise(magnitude)


def double_of(key: int) -> float:
    """The double that ``ordered_long`` maps to ``key``."""
    if key == _NAN:
        return math.nan
    value = struct.unpack("<d", struct.pack("<Q", abs(key)))[0]
    return -value if key < 0 else value


@dataclass
class _Open:
    """A rank still looked for: it is row ``rank`` of the rows with keys ``path`` and then one in [low, high]."""

    rank: int
    path: tuple[int, ...]
    bounds: list[tuple[int, int]]  # of the level's key and all after it

    @property
    def interval(self) -> tuple:
        return (*self.path, self.bounds[0])

    def descend(self) -> None:
        """Keys that the interval leaves no choice about are settled."""
        while self.bounds and self.bounds[0][0] == self.bounds[0][1]:
            self.path += (self.bounds.pop(0)[0],)


def select_keys(df: DataFrame, keys: list[Column], ranks, buckets: int = BUCKETS) -> tuple[list[tuple[int, ...]], int, int]:
    """(key tuple of the row at each of ``ranks``, number of rows, passes). ``ranks`` are 0-based, or a function
    of the number of rows that gives them; ``keys`` are non-null longs. No rows: no keys."""
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)])
    ends = [f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)]

    def bounds(r) -> list[tuple[int, int]]:
        return [(r[f"min_{n}"], r[f"max_{n}"]) for n in names]

    whole = rows.agg(F.count(F.lit(1)).alias("rows"), *ends).first()
    n, passes = whole["rows"], 1
    wanted = ranks(n) if callable(ranks) else list(ranks)
    if n == 0:
        return [], 0, passes
    targets = [_Open(r, (), bounds(whole)) for r in wanted]
    for t in targets:
        t.descend()
    while some := [t for t in targets if t.bounds]:
        intervals = {t.interval: t for t in some}
        place = F.lit(None).cast("long")  # interval * buckets + bucket; rows of no open interval share the group null
        for i, t in enumerate(intervals.values()):
            level, (low, high) = len(t.path), t.bounds[0]
            shift = 0
            while (high >> shift) - (low >> shift) >= buckets:
                shift += 1
            key = F.col(names[level])
            inside = key.between(low, high)
            for name, settled in zip(names, t.path, strict=False):
                inside = inside & (F.col(name) == settled)
            place = F.when(inside, F.shiftright(key, shift) - (low >> shift) + i * buckets).otherwise(place)
        found = rows.withColumn("place", place).groupBy("place").agg(F.count(F.lit(1)).alias("rows"), *ends).collect()
        passes += 1
        counted: dict[tuple, list] = {}
        order = list(intervals)
        for r in sorted((r for r in found if r["place"] is not None), key=lambda r: r["place"]):
            counted.setdefault(order[r["place"] // buckets], []).append(r)
        for t in some:
            for r in counted[t.interval]:
                if t.rank < r["rows"]:
                    t.bounds = bounds(r)[len(t.path):]
                    break
                t.rank -= r["rows"]
            t.descend()
    return [t.path for t in targets], n, passes
