"""Workflow runs: filters, slices, the ingest ledger and data quality."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from testpulse.operators.spread import (
    attach_per_key,
    keep_matching,
    number_rows,
)

RUN = ["repo", "run_id"]


def failed_runs(runs: DataFrame) -> DataFrame:
    """Exactly the conclusion ``failure``: cancelled or timed out is not one."""
    return runs.filter(F.col("conclusion") == "failure")


def of_workflow(runs: DataFrame, workflow: str | None) -> DataFrame:
    return runs if workflow is None else runs.filter(F.col("workflow_name") == workflow)


def since(runs: DataFrame, start: datetime | str | None) -> DataFrame:
    """Runs at or after a time; a time without zone is UTC."""
    if start is None:
        return runs
    moment = datetime.fromisoformat(start) if isinstance(start, str) else start
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    if isinstance(runs.schema["timestamp"].dataType, TimestampNTZType):
        naive = moment.astimezone(timezone.utc).replace(tzinfo=None)
        return runs.filter(F.col("timestamp") >= F.lit(naive.isoformat()).cast("timestamp_ntz"))
    return runs.filter(F.col("timestamp") >= F.lit(moment.isoformat()).cast("timestamp"))


def runs_with_logs_in_scope(runs: DataFrame, all_runs: bool = False) -> DataFrame:
    """Runs whose logs are wanted: the failed ones, or all."""
    return runs if all_runs else failed_runs(runs)


def in_runs(rows: DataFrame, runs: DataFrame, spread_on: Column) -> DataFrame:
    """Rows (logs, lines or results) of the given runs only."""
    return keep_matching(rows, runs, RUN, spread_on)


def newest_runs(runs: DataFrame, n: int) -> DataFrame:
    """The n newest runs of each repo, numbered from 1."""
    return runs_after_newest(runs, 0, n).withColumn("row_no", F.col("row_no") + 1)


def runs_after_newest(runs: DataFrame, skip: int, n: int | None) -> DataFrame:
    """Skip the ``skip`` newest runs of each repo, then take n."""
    return number_rows(
        runs,
        ["repo"],
        [F.col("timestamp").desc(), F.col("run_id").desc()],
        F.date_trunc("hour", "timestamp"),
        descending=True,
        low=skip,
        high=None if n is None else skip + n,
    )


def run_slice(runs: DataFrame, offset: int = 0, size: int | None = None) -> DataFrame:
    """Runs [offset, offset + size) of each repo by run id as text, which is
    the order of their file names."""
    as_text = F.col("run_id").cast("string")
    return number_rows(
        runs,
        ["repo"],
        [as_text],
        F.substring(as_text, 1, 7),
        low=offset,
        high=None if size is None else offset + size,
    )


def routes(repos: DataFrame, runs: DataFrame) -> DataFrame:
    """What happens to each repo: ``error`` without runs, ``no_failures``, or
    ``has_failures``."""
    counts = runs.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(F.col("conclusion") == "failure").alias("n_failed"),
    )
    return repos.join(counts, "repo", "left").select(
        "repo",
        F.coalesce("n_runs", F.lit(0)).alias("n_runs"),
        F.coalesce("n_failed", F.lit(0)).alias("n_failed"),
        F.when(F.coalesce("n_runs", F.lit(0)) == 0, "error")
        .when(F.col("n_failed") == 0, "no_failures")
        .otherwise("has_failures")
        .alias("route"),
    )


def unprocessed(runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Runs that are not in the ledger yet."""
    return runs.join(ledger.select(*RUN), RUN, "left_anti")


def processed_ids(*ledgers: DataFrame) -> DataFrame:
    """Every run id that any ledger holds, once."""
    together = ledgers[0].select(*RUN)
    for ledger in ledgers[1:]:
        together = together.unionByName(ledger.select(*RUN))
    return together.distinct()


def new_ranges(ranges: DataFrame, done: DataFrame) -> DataFrame:
    """Offset ranges that were not downloaded before; only an equal range counts."""
    key = ["repo", "range_start", "range_end"]
    return ranges.join(done.select(*key), key, "left_anti")


def ingest_counters(outcomes: DataFrame) -> DataFrame:
    """Per repo the number of log downloads by outcome."""
    def n(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    return outcomes.groupBy("repo").agg(
        n("ok").alias("runs_with_logs"),
        n("expired").alias("runs_skipped_expired"),
        n("error").alias("runs_skipped_error"),
    )


def log_states(runs: DataFrame, archives: DataFrame) -> DataFrame:
    """Failed runs with the state of their logs: ``ok``, ``error`` for one that
    could not be read, ``expired`` where there is no usable archive."""
    state = (
        F.when(F.col("status") == "ok", "ok")
        .when(F.col("status") == "error", "error")
        .otherwise("expired")
    )
    return (
        failed_runs(runs).select(*RUN)
        .join(archives.select(*RUN, "status"), RUN, "left")
        .select(*RUN, state.alias("log_state"))
    )


def data_quality(runs: DataFrame, archives: DataFrame, requested: int | None = None) -> DataFrame:
    """One row of counters per repo."""
    states = log_states(runs, archives).groupBy("repo").agg(
        F.count_if(F.col("log_state") == "ok").alias("runs_with_logs"),
        F.count_if(F.col("log_state") == "expired").alias("runs_skipped_expired"),
        F.count_if(F.col("log_state") == "error").alias("runs_skipped_error"),
    )
    by_workflow = runs.groupBy("repo", "workflow_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("conclusion") == "failure").alias("failed"),
    )
    fetched = by_workflow.groupBy("repo").agg(
        F.sum("n").alias("runs_fetched"),
        F.sum("failed").alias("runs_with_failures"),
        F.sort_array(F.collect_set("workflow_name")).alias("workflows_analyzed"),
    )
    asked = F.col("runs_fetched") if requested is None else F.lit(requested).cast("bigint")
    counters = ["runs_with_logs", "runs_skipped_expired", "runs_skipped_error"]
    return (
        fetched.join(states, "repo", "left")
        .fillna(0, counters)
        .select(
            "repo", asked.alias("runs_requested"), "runs_fetched", "runs_with_failures",
            *counters, F.col("runs_with_logs").alias("effective_sample"), "workflows_analyzed",
        )
    )


def workflows(runs: DataFrame) -> DataFrame:
    """Distinct workflow names per repo."""
    return runs.select("repo", "workflow_name").distinct()


def pass_rates(runs: DataFrame) -> DataFrame:
    """Successful runs over all runs; skipped and cancelled ones count as runs."""
    return runs.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.avg(F.when(F.col("conclusion") == "success", 1.0).otherwise(0.0)).alias(
            "overall_pass_rate"
        ),
    )


def verify_dataset(runs: DataFrame, archives: DataFrame, ledger: DataFrame) -> DataFrame:
    """Is the data of a repo complete and readable?  Names: :func:`unreadable_archives`."""
    run_counts = runs.groupBy("repo").agg(
        F.count(F.lit(1)).alias("run_files"),
        F.count_if(F.col("conclusion") == "failure").alias("failed_runs"),
    )
    archive_counts = archives.groupBy("repo").agg(
        F.count(F.lit(1)).alias("archives"),
        F.count_if(F.col("status") != "ok").alias("corrupt_archives"),
    )
    status = ledger.select("repo", F.col("status").alias("ledger_status"))
    n_archives = F.coalesce("archives", F.lit(0))
    return (
        run_counts.join(archive_counts, "repo", "left")
        .join(status, "repo", "left")
        .select(
            "repo", "run_files", n_archives.alias("archives"),
            F.coalesce("corrupt_archives", F.lit(0)).alias("corrupt_archives"),
            "failed_runs",
            F.least(n_archives, F.col("failed_runs")).alias("effective_sample"),
            (F.coalesce("ledger_status", F.lit("")) == "complete").alias("complete"),
        )
    )


def unreadable_archives(archives: DataFrame) -> DataFrame:
    """Every archive that cannot be read, with the reason."""
    return archives.filter(F.col("status") != "ok").select("repo", "archive", "status")


def without_test_output(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Failed runs in whose logs no test result was found."""
    seen = results.select(*RUN).distinct()
    return failed_runs(runs).join(seen, RUN, "left_anti")


def with_test_jobs(runs: DataFrame, pattern: str = "test|spec|pytest") -> DataFrame:
    """Runs that have a job whose name looks like a test job."""
    return runs.filter(F.exists("jobs", lambda job: F.lower(job["name"]).rlike(pattern)))


def results_with_runs(results: DataFrame, runs: DataFrame, fields: list[str]) -> DataFrame:
    """Add columns of the run to each of its results."""
    sizes = results.groupBy(*RUN).agg(F.count(F.lit(1)).alias("_n_results"))
    per_run = sizes.join(runs.select(*RUN, *fields), RUN)
    return attach_per_key(results, per_run, RUN, "_n_results", F.col("result_ord")).drop(
        "_n_results"
    )
