"""Seconds per headline query on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is run once to warm up and then timed; every output row is produced (no-op sink), none is collected.
``python bench.py --all`` times every registered query, ``python bench.py name ...`` the named ones.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tidemark.plans.catalog import all_queries
from tidemark.plans.registry import Tables
from tidemark.session import local_session

HEADLINE = [
    "daily_pivot", "describe_series", "zscore_anomalies", "rolling_stats_14", "top_bottom_anomalies", "yoy_growth",
    "correlation_matrix", "histogram", "qcut_decile", "encoding_stability", "window_features", "feature_cross",
    "feature_matrix", "smoothed_target_encoding", "te_out_of_fold", "balanced_undersample", "stratified_split",
    "dedup_keep_first", "distinct_counts", "chunk_fixed", "chunk_pack", "normalized_tokens", "vocabulary_build",
    "dict_segment", "bm25_stats", "bm25_topk", "rrf_fusion", "two_stage_rerank", "dense_topk", "longest_alias",
    "nick_dept_lookup", "subordinates", "policy_router", "route_cascade", "grade_report", "normalized_cross_entropy",
    "classification_report",
]


def timed(build) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    registry = all_queries()
    names = sys.argv[1:] or HEADLINE
    if names == ["--all"]:
        names = list(registry)
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="tidemark-bench")
    tables = Tables(spark, folder)
    seconds = {}
    for name in names:
        build = lambda q=registry[name]: q.build(tables)
        timed(build)
        seconds[name] = round(statistics.median(timed(build) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
