"""Times the registered headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_QUERIES (comma-separated names, default: the list below) steer it.
Every query is fully computed once; the first, untimed one warms the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from assayer.catalogue import QUERIES

HEADLINE = (
    "timeline", "timeline_split_entities", "anomaly_zscore", "anomaly_zscore_global", "anomaly_iqr",
    "anomaly_iqr_bracketed", "reconcile", "rule_sql", "rule_contradiction", "rule_join_limit",
    "rule_applicability", "profile_table", "profile_lineitem", "check_primary_key",
    "infer_relationships", "infer_relationships_star", "contextual_outliers", "merge_outlier_candidates",
    "impact_paths", "build_evidence", "verify_evidence", "dedupe_findings", "review_findings",
    "report_digest", "run_full_audit", "extract_html_text", "chunk_documents", "chunk_id", "embed",
    "vector_search", "vector_search_batch", "vector_search_blocked", "ground_findings",
    "semantic_constraint_match", "keyword_relevance", "redact_events",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("assayer-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("rule_limit_breach")
    times = {}
    for name in names:
        times[name] = run(name)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
