"""Time the headline queries and print one JSON line.

Each query is run once to warm up (code generation, derived tables) and then
timed; the value is the sum of the timed runs.
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from testpulse.catalog import REGISTRY  # noqa: E402
from testpulse.session import local_session  # noqa: E402

HEADLINES = [
    "test_stats",                # counts, rates, dominant signature per test
    "error_signatures",          # normalize, hash, group
    "final_categories",          # rules and vote on top of both
    "classifications",           # verdicts copied to all failing executions
    "extracted_results",         # all line rules, one framework per log
    "failure_messages",          # failure blocks joined to results
    "document_signatures",       # normalize and hash whole texts
    "infra_matches",             # infra patterns over failing executions
    "data_quality",              # runs joined with archives
    "table_report",              # everything up to the report lines
    "response_verdicts",         # model answers to verdicts
    "streamed_test_stats",       # the same statistics from a stream
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    times, cold = {}, {}
    for name in HEADLINES:
        cold[name] = round(run(spark, name, folder), 3)
        times[name] = round(run(spark, name, folder), 3)
    executions = spark.read.parquet(f"{folder}/events.parquet").count()
    print(json.dumps({
        "metric": "sum of headline query times",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "cold": cold,
        "sf": pathlib.Path(folder).name.removeprefix("sf"),
        "executions": executions,
        "executions_per_sec": round(executions / times["final_categories"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
