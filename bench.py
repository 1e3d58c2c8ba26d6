"""Times the headline queries on whole tables and prints one JSON line.

The documented model fits run for minutes and are timed once, without warm-up.
The scoring queries after them load the model that calibrate_isotonic stored.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, BENCH_REPEATS
the timed runs per query after one warm-up run (the median counts).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from riskloom.catalog import QUERIES
from riskloom.session import build_session

FITS = ["train_gbt", "calibrate_isotonic"]
HEADLINE = [
    "engineer_features",
    "median_by_group",
    "stratified_split",
    "sample_per_stratum",
    "standard_scaler_fit",
    "auroc",
    "best_f1_threshold",
    "latency_summary",
    "target_correlation",
    "doc_frequency",
    "tfidf",
    "section_attributions",
    "whatif_rescore",
    "flatten_records",
    "cache_lookup",
    "explain_batch",
]


def run(spark, folder: str, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = build_session(
        f"local[{cpus}]",
        name="bench",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in FITS:
        seconds[name] = round(run(spark, folder, name), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    for name in HEADLINE:
        run(spark, folder, name)
        seconds[name] = round(statistics.median(run(spark, folder, name) for _ in range(repeats)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
