"""Time the registered queries and print one JSON line.

BENCH_SF_DIR names the test tables, BENCH_CPUS the local cores, BENCH_QUERIES an optional
comma-separated choice. Every query runs once to warm the JVM up and is then timed over
BENCH_RUNS runs, of which the best counts. Building the plan is part of the time, since
some queries pin an intermediate result or drain a stream while they are built.
"""

from __future__ import annotations

import json
import os
import sys
import time

from boardpulse.registry import QUERIES, report
from boardpulse.session import build_session, clear_runs

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))
CHOSEN = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name] or list(QUERIES)

# The report as its sections one by one, each reading the facts for itself.
SECTIONS = (
    "base_kpis base_kpis_previous adoption top_dashboard over_time by_dashboard by_position "
    "engagement top_users"
).split()


def consume(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(job) -> float:
    job()
    best = float("inf")
    for _ in range(RUNS):
        start = time.perf_counter()
        job()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def separate_sections(spark) -> None:
    usage = report(spark, SF_DIR)
    for section in SECTIONS:
        consume(getattr(usage, section)())


def main() -> None:
    spark = build_session(
        app="boardpulse-bench",
        master=f"local[{CPUS}]",
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions=CPUS,
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in CHOSEN:
        seconds[name] = timed(lambda: consume(QUERIES[name](spark, SF_DIR)))
        print(f"{name} {seconds[name]}", file=sys.stderr)
        clear_runs(spark)
    result = {
        "metric": "total_seconds_all_queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")),
    }
    if len(CHOSEN) == len(QUERIES):
        result["report_as_separate_sections"] = timed(lambda: separate_sections(spark))
    print(json.dumps(result))


if __name__ == "__main__":
    main()
