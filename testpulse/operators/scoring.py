"""The scorer seam: prompts, verdict cache, call log and outcome audit.

A scorer is a function from a DataFrame of prompts to a DataFrame of
responses.  Calls to a model, if any, happen inside it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testpulse.functions import fixed
from testpulse.functions import text as T
from testpulse.functions import verdicts as V
from testpulse.operators.classify import VERDICT, Scorer
from testpulse.operators.spread import concat_in_order, number_rows
from testpulse.operators.stats import TEST
from testpulse.session import stage

CACHE_KEY = ["provider", "model", "repo", "test_name"]


def context_parts(stats: DataFrame, sigs: DataFrame) -> DataFrame:
    """(repo, test_name, part, text): the statistics of each test as a JSON document in parts, of
    which one is a signature, most frequent first; joined in order of ``part`` they are the
    document.

    However many signatures a test has, no row holds more than one of them.
    """
    numbered = number_rows(
        sigs.withColumn("_less", -F.col("count")), TEST,
        [F.col("_less"), F.col("first.result_ord"), F.col("signature_hash")], F.col("_less"), name="_at",
    )
    shown = F.struct(
        "signature_hash", "sample_message", "count",
        T.iso_time(F.col("first_seen")).alias("first_seen"),
        T.iso_time(F.col("last_seen")).alias("last_seen"),
    )
    each = numbered.select(
        *TEST, F.col("_at").alias("part"),
        F.concat(F.when(F.col("_at") > 0, ",").otherwise(""), F.to_json(shown)).alias("text"),
    )
    opening = F.to_json(F.struct("test_name", "total_executions", "total_failures", "flake_rate", "failure_rate"))
    closing = F.to_json(F.struct(
        "dominant_signature", "dominant_signature_ratio",
        T.iso_time(F.col("first_seen_run")).alias("first_seen_run"),
        T.iso_time(F.col("last_seen_run")).alias("last_seen_run"),
        "workflows_affected",
    ))
    head = F.concat(
        F.substring(opening, F.lit(1), F.length(opening) - 1),
        F.when(opening == "{}", "").otherwise(","), F.lit('"error_signatures":['),
    )
    tail = F.concat(F.when(closing == "{}", "]").otherwise("],"), F.substring(closing, 2, 2**31 - 1))
    known = stats.join(sigs.select(*TEST).distinct(), TEST, "left_semi")
    ends = known.select(*TEST, F.inline(F.array(
        F.struct(F.lit(-1).cast("bigint").alias("part"), head.alias("text")),
        F.struct(F.lit(2**62).alias("part"), tail.alias("text")),
    )))
    return each.unionByName(ends)


def contexts(stats: DataFrame, sigs: DataFrame) -> DataFrame:
    """Statistics of each test as one JSON text; put together per chunk of signatures first."""
    return concat_in_order(context_parts(stats, sigs), TEST, "part", "text", "").select(
        *TEST, F.col("text").alias("context")
    )


def _wanted(undecided: DataFrame, stats: DataFrame, sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statistics and signatures of the ambiguous tests."""
    keys = undecided.select(*TEST)
    return stats.join(keys, TEST, "left_semi"), sigs.join(keys, TEST, "left_semi")


def prompts(undecided: DataFrame, stats: DataFrame, sigs: DataFrame) -> DataFrame:
    """One prompt per ambiguous test, about its first failing execution and with
    the statistics of that test only."""
    theirs, signatures = _wanted(undecided, stats, sigs)
    first = F.col("first_failure")
    return theirs.join(contexts(theirs, signatures), TEST).select(
        *TEST, first["run_id"].alias("run_id"),
        V.prompt(
            F.col("test_name"), first["error_message"], first["stack_trace"], F.col("context")
        ).alias("prompt"),
    )


def prompt_parts(undecided: DataFrame, stats: DataFrame, sigs: DataFrame) -> DataFrame:
    """(repo, test_name, run_id, part, text): the same prompts in parts, for a scorer that sends
    them piece by piece; joined in order of ``part`` they are the prompt."""
    theirs, signatures = _wanted(undecided, stats, sigs)
    first = F.col("first_failure")
    mark = F.lit("\u0000")  # stands for the context, which no part of a prompt holds
    frame = F.split(
        V.prompt(F.col("test_name"), first["error_message"], first["stack_trace"], mark), "\u0000"
    )
    ends = theirs.select(*TEST, F.inline(F.array(
        F.struct(F.lit(-2).cast("bigint").alias("part"), F.array_join(F.slice(frame, F.lit(1), F.size(frame) - 1), "\u0000").alias("text")),
        F.struct(F.lit(2**62 + 1).alias("part"), F.element_at(frame, -1).alias("text")),
    )))
    runs = theirs.select(*TEST, first["run_id"].alias("run_id"))
    parts = ends.unionByName(context_parts(theirs, signatures))
    return parts.join(runs, TEST).select(*TEST, "run_id", "part", "text")


def parse_responses(responses: DataFrame, max_tokens: int = 4096) -> DataFrame:
    """Verdicts from responses (repo, test_name, run_id, provider, model,
    model_returned, finish_reason, content, call_error)."""
    returned = F.col("model_returned") if "model_returned" in responses.columns else F.col("model")
    parsed = V.parse(
        F.col("provider"), F.col("model"), returned,
        F.col("finish_reason"), F.col("content"), F.col("call_error"), max_tokens,
    )
    kept = [c for c in responses.columns
            if c not in ("finish_reason", "content", "call_error", "model_returned")]
    return responses.select(*kept, parsed.alias("verdict")).select(*kept, "verdict.*")


def cache_hits(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached verdicts of the wanted (provider, model, repo, test) keys."""
    known = latest_verdicts(cache)
    return wanted.join(known.select(*CACHE_KEY, "run_id", *VERDICT), CACHE_KEY)


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    return wanted.join(cache.select(*CACHE_KEY), CACHE_KEY, "left_anti")


def usable(cache: DataFrame) -> DataFrame:
    """Cache rows that hold a whole verdict; anything else is a miss."""
    known = F.col("category").isin(*fixed.CATEGORIES)
    for column in ("test_name", "run_id", "evidence", "confidence", "classified_by"):
        known = known & F.col(column).isNotNull()
    return cache.filter(known)


def latest_verdicts(cache: DataFrame) -> DataFrame:
    """The newest row per key of an append-only cache: a maximum per key, not a
    ranking of its rows."""
    payload = F.struct("version", "run_id", *VERDICT)
    return (
        cache.groupBy(*CACHE_KEY)
        .agg(F.max(payload).alias("newest"))
        .select(*CACHE_KEY, "newest.*")
    )


def cacheable(scored: DataFrame) -> DataFrame:
    """Verdicts worth keeping: everything but failed calls."""
    return scored.filter(~F.startswith(F.col("classified_by"), F.lit("llm-fallback")))


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cache with fresh verdicts added; the newest version of a key wins."""
    columns = [*CACHE_KEY, "version", "run_id", *VERDICT]
    return latest_verdicts(cache.select(columns).unionByName(fresh.select(columns)))


class Scored(NamedTuple):
    """All verdicts, the fresh ones (failed calls with their fallback included; see
    :func:`cacheable`), and the responses as the scorer gave them."""

    verdicts: DataFrame
    fresh: DataFrame
    responses: DataFrame


def score(
    undecided_prompts: DataFrame,
    scorer: Scorer,
    provider: str,
    model: str,
    cache: DataFrame | None = None,
) -> Scored:
    """Verdicts for prompts: cached ones, and fresh ones for the rest.

    The scorer is asked once: its responses are written down, and verdicts, cache rows
    and call log are all made from that table.
    """
    wanted = undecided_prompts.withColumns({"provider": F.lit(provider), "model": F.lit(model)})
    if cache is None:
        responses = stage(scorer(wanted), "responses")
        fresh = parse_responses(responses)
        return Scored(fresh, fresh, responses)
    cache = usable(cache)
    hits = cache_hits(wanted.select(*CACHE_KEY), cache)
    responses = stage(scorer(cache_misses(wanted, cache)), "responses")
    fresh = parse_responses(responses)
    columns = [*CACHE_KEY, "run_id", *VERDICT]
    return Scored(hits.select(columns).unionByName(fresh.select(columns)), fresh, responses)


def call_log(responses: DataFrame, max_tokens: int = 4096) -> DataFrame:
    """One row per model call, numbered from 1 per repo and provider.

    Calls run in parallel, so the number follows the hash of the test name: a
    fixed order whose buckets are of even size however many calls there are.
    """
    def given(name: str, kind: str) -> Column:
        present = name in responses.columns
        return (F.col(name) if present else F.lit(None)).cast(kind).alias(name)

    place = F.xxhash64("test_name")
    numbered = number_rows(
        responses, ["repo", "provider"], [place, F.col("test_name")],
        F.shiftright(place, 48), name="call_no",
    )
    return numbered.select(
        (F.col("call_no") + 1).alias("call_number"),
        "repo", "provider", F.col("model").alias("model_requested"),
        F.coalesce(given("model_returned", "string"), F.col("model")).alias("model_actual"),
        "test_name", given("called_at", "timestamp"), given("latency_seconds", "double"),
        given("prompt", "string"), given("content", "string"),
        F.col("call_error").alias("error"),
        F.when(F.col("call_error").isNull(), F.col("finish_reason")).alias("finish_reason"),
        F.lit(max_tokens).alias("max_tokens"),
        given("prompt_tokens", "bigint"), given("completion_tokens", "bigint"),
        given("total_tokens", "bigint"),
    )


def first_verdict_per_test(classified: DataFrame) -> DataFrame:
    """``classified_by`` of the first classification of each test."""
    return classified.groupBy(*TEST).agg(
        F.min_by("classified_by", "result_ord").alias("classified_by")
    )


def outcome_audit(per_test: DataFrame) -> DataFrame:
    """How many tests a model decided, and how many of those answers were cut
    off, not parseable or failed."""
    def n(prefix: str) -> Column:
        return F.count_if(F.startswith(F.col("classified_by"), F.lit(prefix)))

    counted = per_test.groupBy("repo").agg(
        n("llm").alias("llm_call_count"),
        n("llm-truncated").alias("llm_truncated_count"),
        n("llm-parse-error").alias("llm_parse_error_count"),
        n("llm-fallback").alias("llm_fallback_count"),
    )
    return counted.withColumn(
        "degraded_count",
        F.col("llm_truncated_count") + F.col("llm_parse_error_count")
        + F.col("llm_fallback_count"),
    )
