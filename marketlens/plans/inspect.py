"""Plan inspection helpers used by tests and when tuning: the physical plan as text, and the
operators that would pull every row into one task."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

_SPEC = "windowspecdefinition("


def _first_arg(text: str) -> str:
    """First top-level argument of a call whose opening parenthesis was already consumed."""
    depth = 0
    for i, ch in enumerate(text):
        if ch == "(":
            depth += 1
        elif ch == ")":
            if depth == 0:
                return text[:i]
            depth -= 1
        elif ch == "," and depth == 0:
            return text[:i]
    return text


def _unpartitioned(line: str) -> bool:
    """A window spec lists PARTITION BY expressions first, then sort keys (ASC/DESC), then the frame;
    it is unpartitioned when the first argument is already a sort key or the frame."""
    i = line.find(_SPEC)
    if i < 0:
        return False
    first = _first_arg(line[i + len(_SPEC):]).strip()
    return " ASC" in first or " DESC" in first or first.startswith("specifiedwindowframe")


def physical_plan(df: DataFrame) -> str:
    """Executed plan text (adaptive plans show their initial form before any stage runs)."""
    return df._jdf.queryExecution().executedPlan().toString()


def unpartitioned_windows(df: DataFrame) -> list[str]:
    """Window operators without a PARTITION BY (all rows of their input in one task)."""
    return [line.strip() for line in physical_plan(df).splitlines()
            if re.search(r"\bWindow \[", line) and _unpartitioned(line)]


def scan_lines(df: DataFrame) -> list[str]:
    return [line.strip() for line in physical_plan(df).splitlines() if "FileScan" in line or "Scan parquet" in line]
