"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. ``BENCH_QUERIES`` (comma
separated, or ``all``) picks other queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "run_statistics",
    "stage_stats_many_runs",
    "stage_stats_long",
    "throughput_stats",
    "mark_auto_warmup",
    "rolling_latency",
    "throughput_series",
    "resolution_sweep",
    "resource_stats",
    "compare_to_baseline",
    "strategy_comparison",
    "comparison_table",
    "route_comparison",
    "report_lines_text",
    "build_matrix",
    "validate_strategies",
    "build_tasks",
    "device_capability",
    "validate_configs",
    "check_values",
    "priority_batches",
    "chunk_with_padding",
    "gap_batches",
    "adaptive_batch_trace",
    "tile_grid",
    "tiles_per_image",
    "tile_weight_map",
    "score",
    "tiled_inference",
    "live_stage_stats",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from runlens.session import configured
    from workload import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else [n for n in asked.split(",") if n] or HEADLINE
    builder = (
        configured(SparkSession.builder)
        .master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["stage_ratios"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    taken = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total query time",
                "value": round(sum(taken.values()), 3),
                "unit": "sec",
                "queries": taken,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
