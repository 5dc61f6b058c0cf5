"""Time the headline queries; print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 4 -> local[4]), BENCH_SHUFFLE_PARTITIONS (default 2 x cpus). Each query runs to completion through the
``noop`` sink (full execution, nothing collected). Before the timings, the
code paths are warmed up once (JVM class loading / JIT, Python workers) by
running three of the queries on the smallest table set, untimed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "customer_features",
    "customer_segments",
    "segment_summary",
    "customer_value",
    "churn_watchlist",
    "cohort_retention",
    "campaign_audience",
    "action_plan_core",
    "ingest_dirty",
    "kmeans_sweep",
    "customer_clusters",
    "action_plan",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    names = sys.argv[1:] or list(HEADLINE)

    from retail_insight.plans.catalog import QUERIES
    from retail_insight.session import get_session

    shuffle = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(4, 2 * cpus))))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=shuffle,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g")})

    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in ("customer_segments", "cohort_retention", "kmeans_sweep"):
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()

    timings = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)

    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
