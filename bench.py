"""Headline query times as one JSON line.

BENCH_SF_DIR names the tables and BENCH_CPUS the local threads.  Each query is
run once to warm the engine and once measured; results are fully computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import entry_queries  # noqa: E402
import entry_rules  # noqa: E402, F401 - these add their queries to those of entry_queries
import entry_store  # noqa: E402, F401
from worklore import session  # noqa: E402

HEADLINE = [
    "ingested_items", "extracted_items", "message_envelopes", "resolved_items", "tasks", "decisions",
    "daily_actor_groups", "daily_items", "daily_projects", "day_spine", "record_gaps", "record_evidence",
    "current_records", "recent_sessions", "retention_candidates", "directory_association", "redaction",
    "search_documents", "search_index", "document_sections", "packed_documents", "recent_context", "hourly_activity",
    "appended_tails", "stored_texts", "recorded_moves",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.local_session(cpus, "worklore-bench")
    times: dict[str, float] = {}
    names = sys.argv[1:] or HEADLINE
    for name in names:
        for _ in range(2):
            started = time.perf_counter()
            entry_queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
