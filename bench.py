"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, or ``all``
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import queries  # noqa: E402
from checks.fixtures import Tables  # noqa: E402
from watchloom.plans.ingest import ingest_files  # noqa: E402
from watchloom.session import build_session, scratch_path  # noqa: E402
from watchloom.sources.store import Store  # noqa: E402

HEADLINE = [
    "daily_summary", "monthly_summary", "watch_history", "channel_loyalty", "discovery_events",
    "channel_monthly", "hourly_distribution", "channel_funnel", "session_events",
    "session_overview", "viewer_sessions", "parsed_records", "class_counts", "ingest_events",
    "apply_metadata", "input_texts", "embed_job", "cosine_topk", "script_languages",
    "channel_language_review", "topic_keywords", "assign_topics", "channel_transitions",
    "cooccurrence", "top_channels", "quality_violations",
]


def timed(run) -> float:
    began = time.monotonic()
    run()
    return round(time.monotonic() - began, 3)


def ingest_run(spark, sf_dir: str) -> dict[str, float]:
    """Whole loads into a store: a first export, then one that repeats it and adds more."""
    tables = Tables(spark, sf_dir)
    store = Store(spark, scratch_path(spark, "bench-store"))
    landed = scratch_path(spark, "bench-exports")
    fields = ["title", "titleUrl", "time", "details", "subtitles"]
    tables.first_export().select(*fields).write.json(f"{landed}/first")
    tables.records().select(*fields).write.json(f"{landed}/second")
    return {
        f"etl_{part}": timed(lambda p=part: ingest_files(store, f"{landed}/{p}", lines=True))
        for part in ("first", "second")
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.log.level": "ERROR",
        },
    )
    known = queries.bound()
    names = list(known) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    # One untimed query, so that the first timing does not pay for the start of the JVM.
    known["class_counts"](spark, sf_dir).collect()
    times = {
        name: timed(lambda n=name: known[n](spark, sf_dir).write.format("noop").mode("overwrite").save())
        for name in names
    }
    if not chosen or chosen == "all":
        times.update(ingest_run(spark, sf_dir))
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
