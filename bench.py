"""Benchmark of the headline queries.

Runs on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line. Every query is timed from
plan construction to the last row written to a no-op sink, with the
session cache cleared before it, so no query profits from another one's
persisted intermediates. One untimed pass of the same queries over the
next smaller scale factor first warms the JVM (code generation, JIT).
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from tallyzone.plans.catalog import QUERIES  # noqa: E402
from tallyzone.session import local_session  # noqa: E402

HEADLINE = [
    "crashes_by_zip",      # scan, typing, classes, exact k-NN fill, repair, sum per area
    "knn_zip_vote",        # the k-NN vote alone
    "area_report_all",     # rank, likelihood, deciles for every scope
    "area_lookup_all",     # two-scope record of every zip
    "decile_rollup",       # per-decile sums and shares
    "layer_table",         # polygon layer: join, centroids, labels
]


def _run(spark, key, sf):
    t0 = time.time()
    QUERIES[key](spark, sf).write.format("noop").mode("overwrite").save()
    return time.time() - t0


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    label = os.path.basename(sf.rstrip("/"))
    smaller = {"sf0.1": "sf0.01", "sf0.01": "sf0.001"}.get(label)
    warm = os.path.join(os.path.dirname(sf.rstrip("/")), smaller) if smaller else None
    if warm and os.path.isdir(warm):
        for key in HEADLINE:
            spark.catalog.clearCache()
            _run(spark, key, warm)
    times = {}
    for key in HEADLINE:
        spark.catalog.clearCache()
        times[key] = round(_run(spark, key, sf), 3)
    spark.catalog.clearCache()
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": label.replace("sf", "") if label.startswith("sf") else label,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
