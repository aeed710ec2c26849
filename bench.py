"""Benchmark: run the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is fully executed with the ``noop`` sink (every row produced, nothing collected to the driver)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from urlsift.plans.catalog import all_queries  # noqa: E402
from urlsift.session import get_session  # noqa: E402

HEADLINE = [
    "pending_metrics", "annotation_exists", "batch_summaries", "batches_aggregated", "batches_breakdown",
    "urls_pending_by_month", "backlog_by_month", "final_review_batch_info", "review_queue", "queue_html",
    "next_for_agency", "duplicates_by_batch", "insert_urls_summary", "tasks_with_counts", "parse_html",
    "agency_task_confirmed", "apply_approvals_confirmed", "apply_relevance_annotations", "stream_daily_event_counts",
]


MODEL_TABLES = [
    "agencies", "batches", "urls", "link_batch_urls", "duplicates", "user_relevant_suggestions",
    "user_record_type_suggestions", "user_url_agency_suggestions", "auto_relevant_suggestions",
    "auto_record_type_suggestions", "automated_url_agency_suggestions", "confirmed_url_agency", "tasks",
    "link_task_urls", "url_error_info", "url_data_sources", "backlog_snapshot", "logs", "url_checked_for_duplicate",
    "url_probed_for_404", "url_html_content", "url_compressed_html", "url_optional_data_source_metadata",
    "web_pages"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus * 2, app="urlsift-bench")
    qs = all_queries()
    # warm-up: JVM, Python workers and file listing
    qs["urls_aggregated"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    # the catalogue load (derive + store every model table once), timed on its own; queries then read tables
    t0 = time.perf_counter()
    from urlsift.sources.fixtures import load_model

    model = load_model(spark, sf_dir)
    for table in MODEL_TABLES:
        model[table]
    times["model_build"] = round(time.perf_counter() - t0, 3)
    for name in HEADLINE:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus,
                      "shuffle_partitions": cpus * 2}))
    spark.stop()


if __name__ == "__main__":
    main()
