"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs once in full, its result written to a sink that drops it, after
two untimed queries have started the JVM's and the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cinderlog import plans  # noqa: E402
from cinderlog.session import build_session  # noqa: E402

HEADLINE = [
    "page_logs", "filter_keyword", "filter_attr_contains", "hourly_counts", "merge_hourly_counts", "minute_gaps",
    "latency_summary", "page_index", "ingest_decode", "ingest_validate", "attr_sanitize", "assign_id_received",
    "sink_append", "dedup_idempotent", "reconcile_events", "build_term_index", "pack_batches_by_count",
    "wire_serialize", "trace_tree", "metric_rollup", "stream_hourly_counts", "stream_ingest",
]
# Table whose rows a query works on.
INPUT = {"filter_keyword": "documents", "build_term_index": "documents"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus), "spark.ui.enabled": "false",
            "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = plans.queries()
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("events", "documents")}
    for name in ("filter_attr_path", "attr_sanitize_warnings"):
        jobs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds, rates = {}, {}
    for name in names:
        began = time.perf_counter()
        jobs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        rates[name] = round(rows[INPUT.get(name, "events")] / seconds[name])
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": rates,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
