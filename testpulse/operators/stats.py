"""Per-test execution statistics and error-signature groups.

All executions are read once for counts and times, with a hash aggregation
over fixed-width values.  Only failing executions, with the filter pushed into
the scan, are normalized and hashed.  Both are reduced in the map tasks, so a
test with a third of all rows costs one small row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testpulse.functions import fixed
from testpulse.functions import text as T
from testpulse.operators.spread import prefilter
from testpulse.session import stage

TEST = ["repo", "test_name"]


def execution_stats(results: DataFrame) -> DataFrame:
    """Counts, rates, first and last time and workflows of each test.

    Aggregates by workflow first: the distinct workflows are then the rows of
    the second, small aggregation instead of a set built over all executions.
    """
    failing = F.when(T.is_failing(F.col("status")), 1).otherwise(0)
    by_workflow = results.groupBy(*TEST, "workflow_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(failing).alias("failures"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
        F.min("result_ord").alias("first_ord"),
    )
    total = by_workflow.groupBy(*TEST).agg(
        F.sum("n").alias("total_executions"),
        F.sum("failures").alias("total_failures"),
        F.min("first_time").alias("first_seen_run"),
        F.max("last_time").alias("last_seen_run"),
        F.min("first_ord").alias("first_ord"),
        F.sort_array(F.collect_set("workflow_name")).alias("workflows_affected"),
    )
    return total.withColumns(rates(F.col("total_failures"), F.col("total_executions")))


def rates(failures, executions) -> dict:
    """flake_rate in percent and failure_rate as a fraction."""
    some = executions > 0
    return {
        "flake_rate": F.when(some, failures / executions * 100).otherwise(F.lit(0.0)),
        "failure_rate": F.when(some, failures / executions).otherwise(F.lit(0.0)),
    }


def failing_results(results: DataFrame) -> DataFrame:
    return results.filter(T.is_failing(F.col("status")))


def signatures(results: DataFrame) -> DataFrame:
    """One row per (test, error signature), with its first failing execution.

    Counts, times and the number of the first execution are fixed-width values, so
    that failing executions are aggregated by hash and never sorted.  Messages and stack
    traces are fetched in a second pass, for the first executions only: the others
    are left out where they lie.
    """
    signed = failing_results(results).withColumn(
        "signature_hash", T.error_signature(F.col("error_message"))
    )
    group = [*TEST, "signature_hash"]
    counted = stage(
        signed.groupBy(*group).agg(
            F.count(F.lit(1)).alias("count"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
            F.min("result_ord").alias("_ord"),
        ),
        "signature-counts",
    )
    places = counted.select(*TEST, F.col("_ord").alias("result_ord"))
    few = prefilter(failing_results(results), places, [*TEST, "result_ord"]).withColumn(
        "signature_hash", T.error_signature(F.col("error_message"))
    )
    first = F.min(F.struct("result_ord", "run_id", "error_message", "stack_trace"))
    named = few.groupBy(*group, "result_ord").agg(first.alias("first"))
    named = named.select(*[F.col(c).alias(f"_{c}") for c in [*group, "result_ord"]], "first")
    same = F.col("_ord") == F.col("_result_ord")
    for column in group:
        same = same & F.col(column).eqNullSafe(F.col(f"_{column}"))
    grouped = counted.join(named, same)
    message = F.coalesce(
        F.nullif(F.col("first.error_message"), F.lit("")), F.lit(fixed.NO_MESSAGE)
    )
    return grouped.select(
        *TEST, "signature_hash", message.alias("sample_message"),
        "count", "first_seen", "last_seen", "first",
    )


def signature_summary(sigs: DataFrame) -> DataFrame:
    """Per test: number of signatures, the dominant one, the first failure.

    The dominant signature has the most failures; of equals, the one that was
    seen first.  It is a maximum, so no ranking of a test's signatures is done.
    """
    top = F.min(
        F.struct(
            (-F.col("count")).alias("minus_count"),
            F.col("first.result_ord").alias("first_ord"),
            "signature_hash",
        )
    )
    return (
        sigs.groupBy(*TEST)
        .agg(
            F.count(F.lit(1)).alias("n_signatures"),
            F.sum("count").alias("failures"),
            top.alias("top"),
            F.min("first").alias("first_failure"),
        )
        .select(
            *TEST, "n_signatures",
            F.col("top.signature_hash").alias("dominant_signature"),
            (-F.col("top.minus_count") / F.col("failures")).alias("dominant_signature_ratio"),
            "first_failure",
        )
    )


def test_stats(results: DataFrame, sigs: DataFrame | None = None) -> DataFrame:
    """Execution statistics with the signature summary; one row per test.

    ``first_failure`` (order, run, message, stack trace) is what the rules
    look at.  The signatures themselves stay a table of their own: a test can
    have any number of them.
    """
    summary = signature_summary(signatures(results) if sigs is None else sigs)
    return (
        execution_stats(results)
        .join(summary, TEST, "left")
        .fillna({"n_signatures": 0, "dominant_signature_ratio": 0.0})
    )


def signatures_by_count(sigs: DataFrame) -> DataFrame:
    """Signatures ordered by test, most frequent first, then first seen; a
    range-partitioned sort, so a test with very many is spread as well."""
    return sigs.orderBy(*TEST, F.col("count").desc(), F.col("first.result_ord"))
