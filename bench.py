"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed in full with the no-op sink (all rows and columns computed, nothing
collected). Cleaning and materialisation run once first ("clean"), as a dashboard refresh would;
then every query runs BENCH_REPEAT times (default 2) and its fastest run is reported. The first
pass over all queries (cold JIT, cold page cache) is reported too, as "cold_total".
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]

    from marketlens.session import build_session

    scratch = tempfile.mkdtemp(prefix="marketlens-bench-")
    spark = build_session(f"local[{cpus}]", "marketlens-bench", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
        "spark.local.dir": scratch,
    })
    from marketlens.plans.registry import QUERIES, marketplace

    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "2")))
    t0 = time.time()
    m = marketplace(spark, sf_dir)
    m.orders.write.format("noop").mode("overwrite").save()
    clean_sec = round(time.time() - t0, 3)
    runs: dict[str, list[float]] = {}
    for _ in range(repeat):
        for name, fn in QUERIES.items():
            if only and name not in only:
                continue
            t = time.time()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.setdefault(name, []).append(round(time.time() - t, 3))
    times = {"clean": clean_sec, **{name: min(v) for name, v in runs.items()}}
    cold = round(clean_sec + sum(v[0] for v in runs.values()), 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
                      "stat": f"clean once; each query best of {repeat} runs", "cold_total": cold,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": int(cpus),
                      "spark": spark.version, "shuffle_partitions": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
