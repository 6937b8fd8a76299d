"""Headline timings as one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the local cores.  The
raw zone is laid down first; ``stream_ingest`` then drains it through the
stream, and the queries run on the resulting tables.  Every figure is the better
of two runs; the stream gets one run before them to warm up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidelog.plans import catalog, zones  # noqa: E402
from tidelog.session import local_session  # noqa: E402
from tidelog.sources import raw_events  # noqa: E402
from tidelog.streaming import ingest_stream  # noqa: E402

HEADLINE = [
    "parse_log", "validate_log", "ingest_verdict", "split_valid_invalid",
    "keep_last_document", "search_match", "search_match_documents", "search_term", "search_range", "search_logs",
    "search_total_pages", "terms_by_service", "list_indices", "index_stats", "retention_plan",
    "logs_total", "logs_by_service", "logs_by_level", "errors_by_service", "unique_ips_daily", "live_metrics",
    "top_services", "top_errors", "top_n_per_tenant", "recent_errors", "errors_idle_5m", "errors_sliding_5m",
    "sink_metrics", "dlq_inspect", "failures_by_reason", "resolve_api_key", "unknown_services", "alert_evaluation",
    "metadata_audit", "apply_metadata_changes", "reconcile_counts", "latency_summary", "histogram_buckets",
    "counter_rate_1m", "ops_error_ratio", "ops_by_status", "ops_quantiles", "rate_limit_report",
]


def _drain(spark, sf_dir: str, name: str) -> float:
    root = zones.scratch(spark, sf_dir, name)
    raw = raw_events.stream_raw_files(spark, zones.raw_zone_path(spark, sf_dir))
    start = time.perf_counter()
    ingest_stream.drain(ingest_stream.start_ingest(raw, root, root + "-checkpoint", flush_interval=None))
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="tidelog-bench")
    seconds: dict[str, float] = {}

    events = zones.raw_zone(spark, sf_dir).count()
    _drain(spark, sf_dir, "bench-warm-up")
    seconds["stream_ingest"] = min(_drain(spark, sf_dir, f"bench-ingest-{run}") for run in range(2))
    zones.store_root(spark, sf_dir)

    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = min(runs)

    print(json.dumps({
        "metric": "headline_total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {name: round(value, 3) for name, value in seconds.items()},
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "ingest_events": events,
        "ingest_events_per_sec": round(events / seconds["stream_ingest"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
