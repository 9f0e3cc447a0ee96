"""Bench: wall seconds per headline query.

Runs each query fully (``write.format("noop")``: every row computed, nothing
collected) on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` and prints one
JSON line.  The JVM, code generation and the Python workers are warmed up by
queries outside the list; no result is shared between queries, so each time
holds the query's whole work.  The reference publishes no numbers (see
join with the same predicate on the same input.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

WARM_UP = ["latest_serial", "alias_build", "archive_members"]
HEADLINE = [
    "project_suspicion",      # flagship: J1-J6 + A1
    "word_typosquat",         # J2 blocked fuzzy join on whole documents
    "action_parse",           # F4-F7
    "refresh_triggers",       # W1 blocked prefix scan
    "project_incarnations",   # W2
    "release_state",          # W3
    "project_roles",          # W4
    "project_merge",          # S19 / W5
    "download_tasks",         # J13 + W8
    "insert_ignore",          # S16
    "upsert_results",         # S17
    "json_metadata",          # S3-S5
    "html_anchor_text",       # S6
    "effective_lines",        # A4 over whole texts
    "issues",                 # X1-X18 taint scan over the corpus
    "package_metrics",        # A2/A3 roll-up (a scan of its own)
]


def seconds(df) -> float:
    t0 = time.time()
    df.write.format("noop").mode("overwrite").save()
    return round(time.time() - t0, 3)


def fuzzy_join_times(spark, sf_dir: str) -> dict[str, float]:
    """The blocked join and a cross join with the same predicate."""
    from pyspark.sql import functions as F

    from pkgsieve import tables as T
    from pkgsieve.functions.names import within_distance
    from pkgsieve.operators.signals import levenshtein_pairs

    names = T.derived(spark, sf_dir, "candidates").select(F.col("c_custkey").alias("nid"), F.col("project").alias("name"))
    popular = T.derived(spark, sf_dir, "popular").withColumnRenamed("project", "pname")
    brute = names.crossJoin(popular).where(within_distance("name", "pname", 1))
    return {"j2_blocked": seconds(levenshtein_pairs(names, popular, 1)), "j2_cross_join": seconds(brute)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pkgsieve.plans import QUERIES
    from pkgsieve.session import local_session, ship_code

    spark = local_session(cpus, app="pkgsieve-bench", **{"spark.sql.shuffle.partitions": str(max(8, int(cpus) * 2))})
    ship_code(spark)
    for name in WARM_UP:
        seconds(QUERIES[name](spark, sf_dir))
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.time()
        seconds(QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "compare": fuzzy_join_times(spark, sf_dir), "sf": sf}))


if __name__ == "__main__":
    main()
