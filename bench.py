"""Headline queries on one scale; prints one JSON line.

BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default 8) and BENCH_RUNS (default 1; the best
run of each query counts).
"""

from __future__ import annotations

import json
import os
import time

from evidence_spark import build_session
from evidence_spark.plans import catalog
from evidence_spark.session import scratch_scope

HEADLINE = [
    "flagship_alert_groups", "conform_unified", "security_flags", "zscores", "severity_trend", "top_reason_themes",
    "source_summary", "arrival_rate", "rolling_count", "rolling_count_by_supplier", "price_percentile",
    "correlate_latest", "activity_feed", "seal_log", "seal_lineitem", "verify_intact", "merkle_root_of_log",
    "verify_checkpoints", "graph_edges_all", "graph_nodes_all", "attack_paths", "ranked_snippets", "indexable_docs",
    "redacted_documents", "question_routes", "stream_trend", "forest_evaluation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["flagship_alert_groups"](spark, sf_dir).collect()  # warm the JVM before the first timing
    seconds = {}
    for name in (n for n in HEADLINE if n in catalog.QUERIES):
        best = None
        for _ in range(runs):
            started = time.perf_counter()
            with scratch_scope(spark):
                catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - started
            best = taken if best is None else min(best, taken)
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
