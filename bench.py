"""Headline queries at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from waybill.plans import QUERIES  # noqa: E402

HEADLINE = (
    "routes_native",
    "routes_python",
    "hop_log",
    "parse_envelopes",
    "fanout_ids",
    "submit_requests",
    "status_fold",
    "progress_monotonic",
    "transitions",
    "history_since",
    "retention",
    "lineage_children",
    "attempts_redrive",
    "counters",
    "duration_histogram",
    "inflight_depth",
    "rate_5m",
    "latency_p95",
    "alerts",
    "terminal_roundtrip",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # one small run starts the JVM's compiler and the Python workers
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in ("routes_native", "routes_python"):
        QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
