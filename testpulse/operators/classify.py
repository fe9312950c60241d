"""Categories: rules per test, copied to its failures, then a vote per test."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testpulse.functions import fixed, rules
from testpulse.operators.spread import attach_per_key, number_rows
from testpulse.operators.stats import TEST, failing_results

VERDICT = ["category", "evidence", "confidence", "classified_by"]
Scorer = Callable[[DataFrame], DataFrame]


def rule_verdicts(
    stats: DataFrame, *, min_sample: int = fixed.MIN_SAMPLE, forced: bool = False
) -> DataFrame:
    """One row per failing test: the verdict on its first failing execution.

    ``category`` is null where the rules leave the decision to a scorer.
    """
    first = F.col("first_failure")
    verdict = rules.decide(
        rules.infra_pattern(first["error_message"], first["stack_trace"]),
        F.col("total_executions"),
        F.col("dominant_signature_ratio"),
        F.col("failure_rate"),
        F.col("n_signatures"),
        F.col("dominant_signature"),
        min_sample=min_sample,
        forced=forced,
    )
    return stats.filter(first.isNotNull()).select(
        *TEST,
        first["run_id"].alias("run_id"),
        first["result_ord"].alias("first_ord"),
        "total_failures",
        verdict.alias("verdict"),
        F.lit("rules").alias("classified_by"),
    ).select(
        *TEST, "run_id", "first_ord", "total_failures",
        "verdict.category", "verdict.evidence", "verdict.confidence", "verdict.rule",
        "classified_by",
    )


def ambiguous(verdicts: DataFrame) -> DataFrame:
    """Failing tests that no rule decides: the scorer's input."""
    return verdicts.filter(F.col("category").isNull())


def default_verdicts(verdicts: DataFrame, *, forced: bool = False) -> DataFrame:
    """Fill the default where neither a rule nor a scorer decided."""
    filled = rules.with_default(
        F.struct("category", "evidence", "confidence", "rule"), forced=forced
    )
    others = [c for c in verdicts.columns if c not in ("category", "evidence", "confidence", "rule")]
    return verdicts.select(*others, filled.alias("verdict")).select(*others, "verdict.*")


def with_scores(verdicts: DataFrame, scored: DataFrame) -> DataFrame:
    """Take the scorer's verdict where the rules gave none."""
    theirs = scored.select(*TEST, *[F.col(c).alias("s_" + c) for c in VERDICT])
    open_case = F.col("category").isNull() & F.col("s_category").isNotNull()
    joined = verdicts.join(theirs, TEST, "left").withColumn("_open", open_case)
    for column in VERDICT:
        joined = joined.withColumn(
            column, F.when(F.col("_open"), F.col("s_" + column)).otherwise(F.col(column))
        )
    joined = joined.withColumn("rule", F.when(F.col("_open"), "scorer").otherwise(F.col("rule")))
    return joined.drop("_open", *["s_" + c for c in VERDICT])


#: Slices of a repo's range of orders in which its cutoff is looked for.
SLICES = 4096


def with_cutoff(verdicts: DataFrame, limit: int) -> DataFrame:
    """Stop after the first ``limit`` failing tests of a repo (0: no stop).

    Adds ``cutoff``, the order of the last first-failure that is classified;
    failures after it, of any test, get no classification.
    """
    if not limit:
        nothing = F.lit(None).cast(verdicts.schema["first_ord"].dataType)
        return verdicts.withColumn("cutoff", nothing)
    sizes = verdicts.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_tests"),
        F.min("first_ord").alias("_low"),
        F.max("first_ord").alias("_high"),
    )
    keys = verdicts.select("repo", "test_name", "first_ord")
    placed = attach_per_key(keys, sizes, ["repo"], "n_tests", F.col("test_name"))
    # The limit-th order is looked for within one slice of the repo's range of orders.
    span = (F.col("_high") - F.col("_low")).cast("double")
    share = (F.col("first_ord") - F.col("_low")).cast("double") / F.nullif(span, F.lit(0.0))
    part = F.floor(F.coalesce(share, F.lit(0.0)) * SLICES)
    nth = number_rows(
        placed, ["repo"], [F.col("first_ord")], part, low=limit - 1, high=limit
    ).select("repo", F.col("first_ord").alias("_nth"))
    per_repo = sizes.join(nth, "repo", "left").select(
        "repo", "n_tests", F.coalesce("_nth", "_high").alias("cutoff")
    )
    return attach_per_key(
        verdicts, per_repo, ["repo"], "n_tests", F.col("test_name")
    ).drop("n_tests")


def before_cutoff(order: Column) -> Column:
    return F.col("cutoff").isNull() | (order <= F.col("cutoff"))


def classifications(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The verdict of a test, with its run_id, on each failing execution."""
    per_test = verdicts.select(
        *TEST, "run_id", *VERDICT, "total_failures",
        *(["cutoff"] if "cutoff" in verdicts.columns else []),
    )
    failures = failing_results(results).select(*TEST, "result_ord")
    rows = attach_per_key(failures, per_test, TEST, "total_failures", F.col("result_ord"))
    if "cutoff" in rows.columns:
        rows = rows.filter(before_cutoff(F.col("result_ord")))
    return rows.select("repo", "test_name", "run_id", *VERDICT, "result_ord")


def grouped_classifications(classified: DataFrame) -> DataFrame:
    """The classifications of a test as a multiset: equal ones once, with their
    number.  Whole, but never longer than the number of different verdicts."""
    return classified.groupBy("repo", "test_name", "run_id", *VERDICT).agg(
        F.count(F.lit(1)).alias("n")
    )


def votes(classified: DataFrame, weight: Column | None = None) -> DataFrame:
    """Votes per test and category, side by side."""
    one = F.lit(1) if weight is None else weight
    return classified.groupBy(*TEST).agg(
        *[
            F.sum(F.when(F.col("category") == c, one).otherwise(0)).alias("n_" + c.lower())
            for c in fixed.CATEGORIES
        ]
    )


def winner() -> Column:
    """The category with most votes; of equals FLAKY, INFRA, REAL_BUG, others."""
    best = F.greatest(
        *[
            F.struct(
                F.col("n_" + c.lower()).alias("n"),
                F.lit(fixed.VOTE_WEIGHT[c]).alias("weight"),
                F.lit(c).alias("category"),
            )
            for c in fixed.CATEGORIES
        ]
    )
    return best["category"]


def final_category(
    executions: Column, voted: Column, *, min_sample: int = fixed.MIN_SAMPLE, forced: bool = False
) -> Column:
    """Too few executions: INSUFFICIENT_DATA; no votes: FLAKY; else the vote."""
    too_few = F.lit(False) if forced else executions < min_sample
    return F.when(too_few, "INSUFFICIENT_DATA").otherwise(F.coalesce(voted, F.lit("FLAKY")))


def with_final_category(
    stats: DataFrame,
    classified: DataFrame,
    *,
    min_sample: int = fixed.MIN_SAMPLE,
    forced: bool = False,
) -> DataFrame:
    """Statistics with the voted category.  ``classified`` has any number of rows
    per test; they are counted before they are joined."""
    voted = votes(classified).select(*TEST, winner().alias("voted"))
    return (
        stats.join(voted, TEST, "left")
        .withColumn(
            "final_category",
            final_category(
                F.col("total_executions"), F.col("voted"), min_sample=min_sample, forced=forced
            ),
        )
        .drop("voted")
    )


def with_verdict_category(
    stats: DataFrame,
    verdicts: DataFrame,
    *,
    min_sample: int = fixed.MIN_SAMPLE,
    forced: bool = False,
) -> DataFrame:
    """As :func:`with_final_category` where all failures of a test carry one
    verdict: the vote is that verdict, so failures need not be read again."""
    if "cutoff" in verdicts.columns:
        verdicts = verdicts.filter(before_cutoff(F.col("first_ord")))
    voted = verdicts.select(*TEST, F.col("category").alias("voted"))
    return (
        stats.join(voted, TEST, "left")
        .withColumn(
            "final_category",
            final_category(
                F.col("total_executions"), F.col("voted"), min_sample=min_sample, forced=forced
            ),
        )
        .drop("voted")
    )
