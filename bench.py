"""Headline queries, timed. Prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local threads, ``BENCH_RUNS`` the timed runs
per query (the best counts, after one warm-up of the session). Results are produced in full and
discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from keepsake.plans import all_queries  # noqa: E402
from keepsake.session import build_session  # noqa: E402

HEADLINE = [
    "match_thoughts", "match_thoughts_filtered", "match_many", "similar_pairs", "novelty", "match_documents",
    "conversation_gate", "import_thoughts", "import_counters", "notes_to_thoughts", "tag_captures", "chunk_documents",
    "search_contacts", "contact_history", "follow_ups", "thoughts_about_contacts", "opportunities_by_stage",
    "upcoming_interviews", "application_overview", "compensation", "response_times",
    "maintenance_history", "spend_by_category", "task_state", "week_schedule", "schedule_conflicts", "shopping_list",
    "missing_ingredients", "thought_stats", "weekly_review", "daily_digest", "transcript_tail", "latest_edit",
    "merge_inventories", "load_opportunities", "scoped_membership", "capture_stream", "import_incremental",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session("keepsake-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    named = all_queries()
    for name in ("match_thoughts", "conversation_gate"):  # start the JVM code paths and the Python workers
        named[name](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            started = time.perf_counter()
            named[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds = time.perf_counter() - started
            best = seconds if best is None else min(best, seconds)
        took[name] = round(best, 3)
    conversations = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id").distinct().count()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "conversations_per_sec_imported": round(conversations / took["import_thoughts"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
