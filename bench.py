"""Wall time of registered queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS, and optionally BENCH_QUERIES (names with commas) and BENCH_RUNS choose what is run.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from pyspark.sql import SparkSession

from idscreen.plans.catalogue import QUERIES

# The flagship and the queries that move the most data or do the most work per row.
HEADLINE = [
    "screen",
    "field_conflicts",
    "validate_order",
    "normalize_fields",
    "fuzzy_matches",
    "registry_check",
    "registry_as_of",
    "exact_reuse",
    "near_reuse",
    "near_reuse_minhash",
    "template_outliers",
    "match_one_to_one",
    "match_one_to_many",
    "near_vectors",
    "near_vectors_lsh",
    "collect_signals",
    "risk_score_skip",
    "detection_quality",
    "checkpoint_rollup",
    "stage_times",
    "case_timeline",
    "sessions",
    "trail_digest",
    "trail_diff",
    "live_window_counts",
    "live_join_within",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("idscreen-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    first: dict[str, float] = {}
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        first[name] = round(times[0], 3)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_run": first,
                "sf": float(scale.group(1)) if scale else None,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
