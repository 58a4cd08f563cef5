"""Bench: time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run to completion with the no-op sink (the whole plan executes,
nothing is collected).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sigwin.plans.registry import QUERIES  # noqa: E402
from sigwin.session import get_spark  # noqa: E402

HEADLINE = [
    "clean_events", "windows_wide", "m6a_train", "structure_train", "infer_m6a",
    "profile_dedup", "exact_split", "scaler_stats", "roc_auc", "average_precision",
    "metric_report", "ensemble_predict",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=cpus)
    # Warm-up: JVM, codegen caches, parquet footers.
    QUERIES["group_median"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
