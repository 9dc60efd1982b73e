"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of cores, ``BENCH_RUNS`` how often each
query runs after a warm-up (the median counts), ``BENCH_QUERIES`` a comma-separated choice.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "scan_candidates",
    "by_severity",
    "plan_items",
    "plan_summary",
    "fixed_docs",
    "fix_delta",
    "migrate_rendered",
    "migrate_collisions",
    "token_stats",
    "bm25_topk",
    "search_index",
    "cosine_topk",
    "embedding_cache",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from docwarden.plans.registry import QUERIES
    from docwarden.scratch import drop_scratch

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("docwarden-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="docwarden-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in names:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(took[1:] or took), 3)
        print(f"{name}: first {took[0]:.2f}s, then {timings[name]:.2f}s", file=sys.stderr, flush=True)
    drop_scratch(spark)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
        "spark": spark.version,
        "runs": runs,
        "state": "warm",
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
