"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local threads (default 8). Each query
runs to the last row, without collecting it. The time is the median of three runs after a first one; the first
run, which includes code generation, is reported apart.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from siren.plans import relations
from siren.plans.catalog import QUERIES
from siren.session import build_session

HEADLINE = [
    "enrich", "top_20_urgent", "clean_text", "keyword_score", "rule_classify", "gazetteer_match",
    "gazetteer_match_join", "extract_location", "dedup_first_seen", "relevance_filter", "cap_per_query",
    "attach_coordinates_shuffled", "search_reports", "top_urgent", "summary_stats", "value_counts",
    "describe_urgency", "urgency_histogram", "map_points", "stratified_split", "strip_tags", "read_rss_reports",
    "stream_counters",
]
WARM_RUNS = 3


def seconds(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    relations.stored(spark, sf_dir)
    cold, warm = {}, {}
    for name in names:
        cold[name] = round(seconds(spark, sf_dir, name), 3)
        warm[name] = round(statistics.median(seconds(spark, sf_dir, name) for _ in range(WARM_RUNS)), 3)
        print(f"{name}: cold {cold[name]} warm {warm[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total warm seconds of the headline queries",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": spark.sparkContext.defaultParallelism,
    }))


if __name__ == "__main__":
    main()
