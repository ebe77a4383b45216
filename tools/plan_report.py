"""Write PLANS.md: for every registered query, what its physical plan touches.

Columns: parquet scans per cleaned table, shuffle exchanges (hash / range / single-partition),
broadcast exchanges, windows (and whether any lacks a PARTITION BY), sort-based aggregates.
Single-partition exchanges only ever carry partial aggregates of global (one-row) results.

    python tools/plan_report.py [--sf /root/testdata/sf0.01]
"""

from __future__ import annotations

import argparse
import os
import re
import sys
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("users", "restaurants", "riders", "orders", "events", "nps")


def final_plan(df) -> str:
    """Run the query, then read its final adaptive plan: reused exchanges and subqueries are marked
    as such there, so each shuffle is counted once."""
    df.collect()
    return drop_initial_plans(df._jdf.queryExecution().executedPlan().treeString())


def _depth(line: str) -> int:
    """Column where the node marker ("+-") or the node text starts."""
    return len(line) - len(line.lstrip(" :|"))


def drop_initial_plans(text: str) -> str:
    """An executed adaptive plan prints its final plan and then its initial plan (so do adaptive
    subqueries); keep only the final ones."""
    out, skip_below = [], None
    for line in text.splitlines():
        if skip_below is not None:
            if _depth(line) > skip_below:
                continue
            skip_below = None
        if "== Initial Plan ==" in line:
            skip_below = _depth(line)
            continue
        out.append(line)
    return "\n".join(out)


def summarize(df) -> dict:
    from marketlens.plans.inspect import _unpartitioned

    text = final_plan(df)
    lines = text.splitlines()
    scans = Counter()
    for line in lines:
        if "Scan parquet" in line or "FileScan parquet" in line:
            m = re.search(r"marketlens-clean-[0-9a-f]+/(\w+)", line)
            scans[m.group(1) if m else "source"] += 1
        elif "Scan ExistingRDD" in line:
            scans["checkpoint"] += 1
    windows = [l for l in lines if re.search(r"\bWindow \[", l)]
    return {
        "scans": dict(scans),
        "hash": sum("Exchange hashpartitioning" in l and "Reused" not in l for l in lines),
        "range": sum("Exchange rangepartitioning" in l and "Reused" not in l for l in lines),
        "single": sum("Exchange SinglePartition" in l and "Reused" not in l for l in lines),
        "broadcast": sum("BroadcastExchange" in l and "Reused" not in l for l in lines),
        "reused": sum("ReusedExchange" in l or "ReusedSubquery" in l for l in lines),
        "windows": len(windows),
        "global_windows": sum(_unpartitioned(l) for l in windows),
        "sort_agg": sum("SortAggregate" in l for l in lines),
    }


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--out", default=os.path.join(ROOT, "PLANS.md"))
    args = ap.parse_args()
    from marketlens.plans.registry import QUERIES
    from marketlens.session import build_session

    spark = build_session(**{"spark.sql.maxMetadataStringLength": "1000"})
    lines = ["# Physical plans per query",
             "",
             f"Generated by `tools/plan_report.py` from the final adaptive plans at `{args.sf}` "
             "(local[8], 8 shuffle partitions), after the cleaned tables are materialised as parquet. "
             "Scans count parquet reads of each cleaned table (`source` = the raw star-schema files, "
             "`checkpoint` = reliable checkpoints of the distributed rank); reused exchanges and subqueries "
             "are counted once, in `reused`. Eager steps that run while a plan is built (rank "
             "checkpoints, fence brackets, bounded pivot values) are separate jobs and not in these counts. "
             "`single` exchanges carry only partial aggregates of one-row results. A global window "
             "(no PARTITION BY) appears only in `ordinal_rank`'s offsets, over one row per partition.",
             "",
             "| query | scans | hash shuffles | range shuffles | single | broadcasts | reused | windows (global) | sort aggs |",
             "|---|---|---|---|---|---|---|---|---|"]
    for name, fn in QUERIES.items():
        s = summarize(fn(spark, args.sf))
        scans = ", ".join(f"{t}×{n}" for t, n in sorted(s["scans"].items()))
        lines.append(f"| `{name}` | {scans} | {s['hash']} | {s['range']} | {s['single']} | {s['broadcast']} | "
                     f"{s['reused']} | {s['windows']} ({s['global_windows']}) | {s['sort_agg']} |")
    with open(args.out, "w") as fh:
        fh.write("\n".join(lines) + "\n")
    print(f"wrote {args.out}")


if __name__ == "__main__":
    main()
