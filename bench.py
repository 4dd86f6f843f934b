"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quietlog.plans.registry import QUERIES  # noqa: E402
from quietlog.session import local_session  # noqa: E402

HEADLINE = (
    "usage_stats", "usage_hourly", "usage_by_client", "errors_by_model", "request_two_phase", "sessionize_requests",
    "usage_extract", "corpus_grade_report", "redact_text", "redaction_report", "restore_text", "payload_policy",
    "payload_write_back", "audit_dual_append", "context_select", "message_blocks_flatten", "chat_to_blocks",
    "stream_usage", "stream_to_block_events", "window_limit_audit", "token_bucket_audit", "hourly_stream",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cores, shuffle_partitions=cores)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # one small pass starts JVM and Python workers, so that the first query does not pay for them
    QUERIES["normalize_text"](spark, folder).limit(1).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
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
