"""Numeric helpers that keep results exact and engine-independent.

Money is summed as DECIMAL (exact, order-independent) and only turned into a double at the end;
rounded percentages of counts use integer arithmetic, so the half-way rule is exact half-up.

Dirty amounts have a defined result and never end a query: what is no amount (NaN, infinite, 10^16 and more, a
rate of 10,000 and more) counts as missing, and ``rejected`` tells how many there are; a sum that passes 24
digits is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(22,6)"
RATE = "decimal(12,8)"  # MONEY x RATE has 35 digits and MONEY x MONEY 32 before the point: both fit 38


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """Monetary double -> DECIMAL(22,6): six decimals, rounded half up beyond; null if it is no amount."""
    return _col(c).try_cast(MONEY)


def rate(c: Column | str) -> Column:
    """A rate such as a commission share -> DECIMAL(12,8): eight decimals, products with money exact; null if it is none."""
    return _col(c).try_cast(RATE)


def rejected(c: Column | str, kind: str = MONEY) -> Column:
    """Number of rows whose value is present but no amount."""
    return count_if(_col(c).isNotNull() & _col(c).try_cast(kind).isNull())


def exact_sum(c: Column) -> Column:
    """Exact sum of a DECIMAL; null for an empty input or beyond 38 digits."""
    return F.try_sum(c)


def money_sum(c: Column | str) -> Column:
    """Exact sum of a monetary column; 0 for an empty input (as an empty sum is 0, not null)."""
    return sum_or_zero(money(c))


def sum_or_zero(c: Column) -> Column:
    """Exact sum of a DECIMAL; 0 where there is nothing to add, null beyond 38 digits."""
    return F.when(F.count(c) == 0, F.lit(0).cast(MONEY)).otherwise(exact_sum(c))


def to_double(dec: Column) -> Column:
    """Exact decimal -> double, rounded to 4 decimals first so the conversion is correctly rounded."""
    return F.round(dec, 4).cast("double")


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; null when den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def pct(num: Column, den: Column) -> Column:
    """num / den * 100; null when den is 0."""
    return ratio(num, den) * 100


def pct_or_zero(num: Column, den: Column) -> Column:
    """num / den * 100, or 0 when den is 0 (the reference's guarded rates)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double") * 100)


def round_pct(num: Column, den: Column, scale: int = 1, factor: int = 100) -> Column:
    """round(factor * num / den, scale), half-up, exact for non-negative integer num and den."""
    unit = 10 ** scale
    scaled = F.call_function("div", F.lit(2 * factor * unit) * num.cast("long") + den.cast("long"),
                             F.lit(2) * den.cast("long"))
    return F.when(den == 0, F.lit(None).cast("double")).otherwise(scaled.cast("double") / unit)


def n_unique(c: Column | str) -> Column:
    """Distinct values counting null as one value (count(distinct) alone ignores nulls)."""
    c = _col(c)
    return F.count_distinct(c) + F.coalesce(F.max(F.when(c.isNull(), 1).otherwise(0)), F.lit(0))


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def mean_bool(cond: Column) -> Column:
    """Mean of a boolean, nulls skipped."""
    return F.avg(cond.cast("int"))
