"""Comparisons between providers, rules, truth and trackers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testpulse.functions import fixed
from testpulse.operators.spread import attach_per_key, first_rows
from testpulse.operators.stats import TEST

QUOTAS = {"FLAKY": 4, "REAL_BUG": 3, "INFRA": 2, "INSUFFICIENT_DATA": 1}


def agreement(classified: DataFrame) -> DataFrame:
    """Per repo the share of tests on which all providers give one category.

    ``classified`` has one row per (repo, provider, test_name).
    """
    per_test = classified.groupBy(*TEST).agg(
        F.count(F.lit(1)).alias("n_providers"),
        (F.min("category") == F.max("category")).alias("agreed"),
    )
    return (
        per_test.filter(F.col("n_providers") > 1)
        .groupBy("repo")
        .agg(
            F.count(F.lit(1)).alias("n_tests"),
            F.count_if("agreed").alias("n_agreed"),
            F.avg(F.col("agreed").cast("double")).alias("agreement_rate"),
        )
    )


def changed_by_model(by_rules: DataFrame, by_model: DataFrame) -> DataFrame:
    """Tests whose category a model changed from the rules' verdict."""
    rules = by_rules.select(*TEST, F.col("category").alias("rules_category"))
    model = by_model.select(*TEST, "provider", F.col("category").alias("model_category"))
    return model.join(rules, TEST).filter(F.col("rules_category") != F.col("model_category"))


def category_counts(classified: DataFrame, providers: list[str]) -> DataFrame:
    """Repo and category against providers."""
    counted = classified.groupBy("repo", "category", "provider").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.groupBy("repo", "category").pivot("provider", providers).sum("n").fillna(0)


def accuracy(classified: DataFrame, truth: DataFrame) -> DataFrame:
    """Per provider the share of labelled tests it got right."""
    known = truth.select(*TEST, F.col("category").alias("true_category"))
    return (
        classified.join(known, TEST)
        .groupBy("provider")
        .agg(
            F.count(F.lit(1)).alias("n_labelled"),
            F.avg((F.col("category") == F.col("true_category")).cast("double")).alias("accuracy"),
        )
    )


def discovered(stats: DataFrame, tracker: DataFrame) -> DataFrame:
    """Flaky tests that the issue tracker does not know."""
    flaky = stats.filter(F.col("final_category") == "FLAKY")
    return flaky.join(tracker.select(*TEST), TEST, "left_anti")


def call_statistics(calls: DataFrame) -> DataFrame:
    """Latency and token statistics per provider.

    Latencies are kept to the millisecond, so the exact median is taken over
    counted distinct values, not over all calls.
    """
    counted = (
        calls.withColumn("latency", F.round("latency_seconds", 3))
        .groupBy("provider", "latency")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("total_tokens").alias("tokens"))
    )
    median = F.percentile("latency", F.lit(0.5), F.col("n"))
    return counted.groupBy("provider").agg(
        F.sum("n").alias("n_calls"),
        F.round(F.sum(F.col("latency") * F.col("n")) / F.sum("n"), 6).alias("mean_latency"),
        F.round(median, 6).alias("median_latency"),
        F.min("latency").alias("min_latency"),
        F.max("latency").alias("max_latency"),
        (F.sum("tokens") / F.sum("n")).alias("mean_tokens"),
    )


def cost_projection(usage: DataFrame, prices: DataFrame, volumes: list[int]) -> DataFrame:
    """Cost of a number of calls at the mean token use seen so far.

    ``usage`` has (model, prompt_tokens, completion_tokens) per call, ``prices``
    (model, input_price, output_price) per million tokens.
    """
    mean = usage.groupBy("model").agg(
        F.avg("prompt_tokens").alias("mean_in"), F.avg("completion_tokens").alias("mean_out")
    )
    per_call = (
        F.col("mean_in") * F.col("input_price") + F.col("mean_out") * F.col("output_price")
    ) / 1_000_000
    return (
        mean.join(prices, "model")
        .select("model", per_call.alias("cost_per_call"),
                F.explode(F.array(*[F.lit(v) for v in volumes])).alias("calls"))
        .select("model", F.col("calls").cast("bigint").alias("calls"), "cost_per_call",
                (F.col("calls") * F.col("cost_per_call")).alias("cost"))
    )


def call_health(calls: DataFrame) -> DataFrame:
    """Per provider the share of degraded calls and of cache hits.

    ``calls`` has (provider, classified_by, cached) per answered question.
    """
    def bad(prefix: str) -> Column:
        return F.startswith(F.col("classified_by"), F.lit(prefix))

    made = ~F.col("cached")
    degraded = made & (bad("llm-truncated") | bad("llm-parse-error") | bad("llm-fallback"))
    some = F.count_if(made) > 0
    return calls.groupBy("provider").agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.count_if(made).alias("n_calls"),
        F.count_if(degraded).alias("n_degraded"),
        F.when(some, F.count_if(degraded) / F.count_if(made))
        .otherwise(F.lit(0.0)).alias("degraded_rate"),
        (F.count_if(F.col("cached")) / F.count(F.lit(1))).alias("cache_hit_rate"),
    )


def validation_sample(stats: DataFrame, seed: str = "sample") -> DataFrame:
    """Tests to review by hand: per repo 4 flaky, 3 real bugs, 2 infra issues and
    1 with too little data; what a category lacks is taken from the flaky.

    Flaky tests are the one with the highest flake rate, the one with the
    lowest, then any; the rest is in seeded hash order.  A top-k per repo.
    """
    most = sum(QUOTAS.values())
    dice = F.md5(F.concat(F.lit(seed), F.lit("|"), F.col("repo"), F.lit("|"), F.col("test_name")))
    rows = stats.select(*TEST, "final_category", "flake_rate", dice.alias("dice"))
    flaky = rows.filter(F.col("final_category") == "FLAKY")
    extremes = flaky.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_flaky"),
        F.max_by("test_name", F.struct("flake_rate", "dice")).alias("highest"),
        F.min_by("test_name", F.struct("flake_rate", "dice")).alias("lowest"),
    )
    placed = attach_per_key(flaky, extremes, ["repo"], "n_flaky", F.col("dice")).withColumn(
        "turn",
        F.when(F.col("test_name") == F.col("highest"), 0)
        .when(F.col("test_name") == F.col("lowest"), 1)
        .otherwise(2),
    )
    others = rows.filter(F.col("final_category") != "FLAKY").withColumn("turn", F.lit(2))
    picked = first_rows(
        placed.drop("n_flaky", "highest", "lowest").unionByName(others),
        ["repo", "final_category"],
        [F.col("turn"), F.col("dice")],
        most,
    )
    quota = F.create_map(*[F.lit(x) for pair in QUOTAS.items() for x in pair])
    mine = picked.filter(
        (F.col("final_category") != "FLAKY")
        & (F.col("row_no") <= F.try_element_at(quota, F.col("final_category")))
    )
    taken = mine.groupBy("repo").agg(F.count(F.lit(1)).alias("n_others"))
    spare = (
        picked.filter(F.col("final_category") == "FLAKY")
        .join(taken, "repo", "left")
        .filter(F.col("row_no") <= most - F.coalesce("n_others", F.lit(0)))
        .drop("n_others")
    )
    return mine.unionByName(spare).select(
        *TEST, "final_category", "flake_rate", F.col("row_no").alias("pick")
    )


def low_confidence(classified: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Verdicts to escalate to another scorer or a person."""
    return classified.filter(F.col("confidence") < threshold)
