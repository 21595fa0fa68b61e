"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the input
and the cores. Each query runs once to warm up and once for the clock; results go to a
sink that computes every row.
"""

from __future__ import annotations

import json
import os
import time

from driftspark.plans.queries import queries
from driftspark.session import get_spark

HEADLINE = [
    "drift_report",
    "exact_histogram",
    "channel_drift",
    "constant_feature_drift",
    "rebinned_distances",
    "psi_of_values",
    "euclidean_of_values",
    "merge_sketches",
    "sketch_drift",
    "run_cycle",
    "run_sketch_cycle",
    "stored_cycle",
    "ingest_stream",
    "expand_bundles",
    "load_sketches",
    "register_bundles",
    "latest_per_sensor",
    "snapshot_docs",
    "assemble_overall",
    "metric_stats",
    "metric_distances",
    "project_data",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    named, timed = queries(), {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            named[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timed[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline queries, total wall time",
        "value": round(sum(timed.values()), 3),
        "unit": "sec",
        "queries": timed,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
