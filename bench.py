"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from loomgraph.plans import catalogue

HEADLINE = ["impact_report", "bfs_backward", "find_callers", "node_chunks", "shared_lines", "chunk_chars", "chunk_tokens", "contract_substring_join", "suffix_join", "knn_cosine", "hybrid_rerank", "segment_dedup", "debounce_sessions", "rule_plans", "service_dependencies", "pricing_summary", "extract_beans", "extract_entities", "extract_topics", "extract_client_calls", "code_handled_by", "code_service_dependencies", "code_client_edges", "frontend_edges", "describe_feature", "semantic_chunks", "session_lives", "reindex_pieces", "deep_search"]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{d}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        start = time.time()
        catalogue.queries()[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d)}))


if __name__ == "__main__":
    main()
