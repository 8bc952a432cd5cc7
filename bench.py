"""Benchmark: every registered query over one scale folder.

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
``prepare`` (ingest, lookup join, label cleaning, written once to the
shared folder) is timed as its own entry; the analysis queries then start
from that table, as the analysis computes its cleaned frame once. Queries
over the raw tables (row ids, scans, names, dates) read the tables directly.
Each query runs to completion into Spark's no-op sink. Before timing, every
query runs once on sf0.001 to warm the JVM and Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from dealflow.plans.catalog import QUERIES
    from dealflow.plans.flow import analysis, forget, prepare
    from dealflow.session import get_session

    spark = get_session(f"local[{cpus}]", app="dealflow-bench",
                        shuffle_partitions=max(2 * cpus, 8),
                        conf={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")

    # warm-up: every query once on the smallest folder (JIT, class loading,
    # Python workers); not timed
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm) and os.environ.get("BENCH_WARMUP", "1") != "0":
        prepare(spark, warm)
        for name, fn in QUERIES.items():
            if not only or name in only:
                fn(spark, warm).write.format("noop").mode("overwrite").save()
        forget(spark, warm)

    timings: dict[str, float] = {}
    t0 = time.perf_counter()
    prepare(spark, sf_dir)
    timings["prepare"] = round(time.perf_counter() - t0, 3)
    failed = {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        t = time.perf_counter()
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - t, 3)
            analysis(spark, sf_dir).reset()  # no query rides on another's frames
        except Exception as e:  # noqa: BLE001
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    forget(spark, sf_dir)
    total = round(sum(timings.values()), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": total, "unit": "sec",
           "queries": timings, "sf": sf, "cpus": cpus}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
