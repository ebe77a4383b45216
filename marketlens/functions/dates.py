"""Date and time column functions (ANSI mode stays on: every parse is a ``try_`` parse)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date_multi(c: Column | str, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd/MM/yyyy")) -> Column:
    """First format that parses wins; unparseable -> null."""
    c = _col(c)
    return F.coalesce(*[F.call_function("try_to_date", c, F.lit(fmt)) for fmt in formats])


def lenient_date(df: DataFrame, name: str) -> Column:
    """String -> date by the default parser, other types by cast; failures become null."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.DateType):
        return F.col(name)
    if isinstance(dtype, T.StringType):
        return F.col(name).try_cast(T.DateType())
    return F.col(name).try_cast(T.DateType())


def lenient_timestamp(df: DataFrame, name: str) -> Column:
    """String or timestamp -> zone-less timestamp; failures become null."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return F.col(name)
    return F.col(name).try_cast(T.TimestampNTZType())


def signup_date(df: DataFrame, name: str = "signup_date") -> Column:
    """Two-format parse for strings (``yyyy-MM-dd`` then ``dd/MM/yyyy``), cast otherwise."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return parse_date_multi(name)
    return lenient_date(df, name)


def week_key(d: Column | str, mode: str = "reference") -> Column:
    """Week label ``YYYY-Www``.

    ``reference``: calendar year of the date with its ISO week number (so 2024-12-30 -> 2024-W01),
    which is what ``%Y-W%V`` gives. ``iso``: ISO week-numbering year (2024-12-30 -> 2025-W01).
    """
    d = _col(d)
    week = F.lpad(F.weekofyear(d).cast("string"), 2, "0")
    if mode == "iso":
        year = F.year(F.date_add(d, F.lit(3) - F.weekday(d)))
    elif mode == "reference":
        year = F.year(d)
    else:
        raise ValueError(f"unknown week key mode {mode!r}")
    return F.concat(year.cast("string"), F.lit("-W"), week)


def whole_minutes(start: Column | str, end: Column | str) -> Column:
    """Elapsed whole minutes, truncated (null if either side is null)."""
    return F.timestamp_diff("MINUTE", _col(start), _col(end))


def whole_seconds(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("SECOND", _col(start), _col(end))


def month_key(d: Column | str) -> Column:
    return F.date_format(_col(d), "yyyy-MM")


def local_now(tz: str = "Asia/Kolkata") -> Column:
    """Wall-clock now in the dashboard's zone (used for the 'as of' stamp)."""
    # the NTZ cast renders the instant in the session zone, so convert from that zone
    return F.convert_timezone(F.current_timezone(), F.lit(tz), F.current_timestamp().cast("timestamp_ntz"))
