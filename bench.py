"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``, each once to warm up; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from quillwork.plans import load_all
from quillwork.plans.registry import QUERIES
from quillwork.session import build_session

HEADLINE = [
    "flagship_bm25_recall", "ret3_vector_topk", "ret12_hybrid_search", "chk7_chunk_documents", "doc2_markdown_nodes",
    "cln1_clean_nodes", "chk1_heading_path", "qlt1_quality", "dia6_health_report", "dia7_load_summary",
    "str1_rate_limit", "str1_rate_limit_stream", "str10_live_metrics_stream", "cch2_cache_shared", "fil8_upload_status", "snk2_upsert_tasks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
