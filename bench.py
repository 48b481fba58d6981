"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "gap_sessions",
    "geo_clusters",
    "moments_rollup",
    "exact_copies",
    "near_documents",
    "document_groups",
    "library_groups",
    "nearest_class",
    "zero_shot_tags",
    "centroid_outliers",
    "best_of_year",
    "on_this_day",
    "event_occasions",
    "event_list",
    "library_stats",
    "browse_page",
    "snapshot_cdc",
    "snapshot_diff",
    "edit_overlay",
    "filename_dates",
    "age_labels",
    "quality_scores",
    "storyboard_plan",
    "life_stages",
]


def main() -> None:
    from tidemark.checks import QUERIES
    from tidemark.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, partitions=max(8, int(cpus) if cpus.isdigit() else 8))
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        spent = []
        for _ in range(runs + 1):  # the first run warms up
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        times[name] = round(statistics.median(spent[1:]), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
