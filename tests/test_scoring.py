"""Response parsing, prompts, cache, audit and the scorer seam."""

import json

import pytest
from pyspark.sql import functions as F

from testpulse.functions import fixed
from testpulse.functions import verdicts as V
from testpulse.operators import classify as K
from testpulse.operators import scoring as S
from testpulse.operators import stats as ST

BAD = fixed.BAD_JSON_EVIDENCE
RESPONSE = ("repo string, test_name string, run_id bigint, provider string, model string, "
            "model_returned string, finish_reason string, content string, call_error string")
# content, finish reason, call error -> category, confidence, evidence, kind
CASES = [
    ('{"category": "REAL_BUG", "evidence": "e", "confidence": 0.9}', "stop", None,
     "REAL_BUG", 0.9, "e", "llm"),
    ('{"category": "infra", "evidence": "e", "confidence": 7}', "stop", None, "INFRA", 1.0, "e", "llm"),
    ('{"category": "INFRA", "evidence": "e", "confidence": -1}', "stop", None, "INFRA", 0.0, "e", "llm"),
    ('{"category": "WEATHER"}', "stop", None, "FLAKY", 0.5, "LLM classification", "llm"),
    ("{}", "stop", None, "FLAKY", 0.5, "LLM classification", "llm"),
    ('  {"category": "INFRA", "confidence": "0.25"} \n', "stop", None, "INFRA", 0.25,
     "LLM classification", "llm"),
    ('{"category": "INFRA", "confidence": true}', "stop", None, "INFRA", 1.0,
     "LLM classification", "llm"),
    ('{"category": "INFRA", "evidence": null}', "stop", None, "INFRA", 0.5, None, "llm"),
    ('{"category": "INFRA", "confidence": "1.0d"}', "stop", None, "FLAKY", 0.5, BAD, "llm-parse-error"),
    ('{"category": "INFRA", "confidence": null}', "stop", None, "FLAKY", 0.5, BAD, "llm-parse-error"),
    ('{"category": "INFRA", "confidence": "high"}', "stop", None, "FLAKY", 0.5, BAD,
     "llm-parse-error"),
    ("not json", "stop", None, "FLAKY", 0.5, BAD, "llm-parse-error"),
    ("{'category': 'INFRA'}", "stop", None, "FLAKY", 0.5, BAD, "llm-parse-error"),
    ('{"category": "INFRA"} tail', "stop", None, "FLAKY", 0.5, BAD, "llm-parse-error"),
    ('```json\n{"category": "INFRA"}\n```', "stop", None, "FLAKY", 0.5, BAD, "llm-parse-error"),
    ("", "stop", None, "FLAKY", 0.5, BAD, "llm-parse-error"),
    (None, "stop", None, "FLAKY", 0.5, fixed.NO_CHOICE_EVIDENCE, "llm-parse-error"),
    ('{"category": "INFRA"}', "length", None, "FLAKY", 0.5,
     "LLM response truncated (finish_reason=length, max_tokens=4096); no verdict extracted, "
     "defaulted to flaky", "llm-truncated"),
    ('{"category": null}', "stop", None, "FLAKY", 0.5,
     "LLM error (prov): category is not text; defaulted to flaky", "llm-fallback"),
    ('{"category": 5, "confidence": "x"}', "stop", None, "FLAKY", 0.5,
     "LLM error (prov): category is not text; defaulted to flaky", "llm-fallback"),
    ("[1]", "stop", None, "FLAKY", 0.5,
     "LLM error (prov): answer is not an object; defaulted to flaky", "llm-fallback"),
    (None, None, "timeout", "FLAKY", 0.5, "LLM call failed (prov): timeout; defaulted to flaky",
     "llm-fallback"),
]


@pytest.fixture(scope="module")
def responses(spark):
    return spark.createDataFrame(
        [("org/app", f"t{i:02}", i, "prov", "asked", "answered", c[1], c[0], c[2])
         for i, c in enumerate(CASES)], RESPONSE)


def test_parse(responses):
    got = S.parse_responses(responses).orderBy("test_name").collect()
    for case, row in zip(CASES, got):
        by = f"{case[6]}:prov:{'asked' if case[6] == 'llm-fallback' else 'answered'}"
        assert (row.category, row.confidence, row.evidence, row.classified_by) == (
            case[3], case[4], case[5], by), case[0]


def test_audit_counts_outcomes(responses):
    per_test = S.parse_responses(responses).select("repo", "test_name", "classified_by")
    got = S.outcome_audit(per_test).first()
    kinds = [c[6] for c in CASES]
    assert got.llm_call_count == len(CASES)
    assert got.llm_truncated_count == kinds.count("llm-truncated")
    assert got.llm_parse_error_count == kinds.count("llm-parse-error")
    assert got.llm_fallback_count == kinds.count("llm-fallback")
    assert got.degraded_count == len(CASES) - kinds.count("llm")


def test_failed_calls_are_not_cached(responses):
    kept = S.cacheable(S.parse_responses(responses)).collect()
    assert len(kept) == sum(c[6] != "llm-fallback" for c in CASES)


def test_prompt_cuts_only_a_long_context(spark):
    df = spark.createDataFrame([("t", "m", "s", "{" + "x" * 60_000 + "}"), ("t", "m", "s", "{}"),
                                ("t", "m", "s" * 60_000, None)],
                               "n string, m string, s string, c string")
    long, short, bare = [r.p for r in df.select(
        V.prompt(F.col("n"), F.col("m"), F.col("s"), F.col("c")).alias("p")).collect()]
    assert "\nCross-run context: {}\n\nRespond with ONLY" in short
    kept = long.split("Cross-run context: ")[1].removesuffix("\n\n" + fixed.PROMPT_TAIL)
    assert kept.startswith("{xxx") and len(kept) >= 60_000
    assert bare.count("s" * 60_000) == 1 and "Cross-run" not in bare


def test_context_holds_all_signatures(make_results):
    words = [f"kind {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(600)]
    results = make_results([("t", "FAILED", w, 1) for w in words])
    sigs = ST.signatures(results)
    stats = ST.test_stats(results, sigs)
    prompt = S.prompts(stats, stats, sigs).first().prompt
    context = prompt.split("Cross-run context: ")[1]
    context = context.removesuffix("\n\n" + fixed.PROMPT_TAIL)
    listed = json.loads(context)["error_signatures"]
    assert [s["sample_message"] for s in listed] == words


def test_cache_answers_before_the_scorer(spark, make_results):
    results = make_results([("a", "FAILED", "x"), ("b", "FAILED", "y")])
    sigs = ST.signatures(results)
    stats = ST.test_stats(results, sigs)
    ruled = K.rule_verdicts(stats, forced=True)
    questions = S.prompts(K.ambiguous(ruled), stats, sigs)
    cache = spark.createDataFrame(
        [("prov", "m", "org/app", "a", 1, 7, "INFRA", "old", 0.5, "llm:prov:m"),
         ("prov", "m", "org/app", "a", 2, 7, "REAL_BUG", "new", 0.5, "llm:prov:m"),
         ("prov", "m", "org/app", "b", 1, 7, None, "broken", 0.5, "llm:prov:m")],
        "provider string, model string, repo string, test_name string, version bigint, "
        "run_id bigint, category string, evidence string, confidence double, classified_by string")
    asked = []

    def scorer(df):
        asked.extend(r.test_name for r in df.collect())
        return df.select("repo", "test_name", "run_id", "provider", "model",
                         F.lit("stop").alias("finish_reason"),
                         F.lit('{"category": "INFRA", "confidence": 0.6}').alias("content"),
                         F.lit(None).cast("string").alias("call_error"))

    scored, fresh, responses = S.score(questions, scorer, "prov", "m", cache)
    assert [r.test_name for r in S.call_log(responses).collect()] == ["b"]
    got = {r.test_name: (r.category, r.classified_by)
           for r in K.with_scores(ruled, scored).collect()}
    assert got == {"a": ("REAL_BUG", "llm:prov:m"), "b": ("INFRA", "llm:prov:m")}
    assert [r.test_name for r in fresh.collect()] == ["b"]
    assert asked == ["b"]  # once, whatever has been read since


def test_call_numbers_are_whole(responses):
    log = S.call_log(responses).collect()
    assert sorted(r.call_number for r in log) == list(range(1, len(CASES) + 1))
    assert {r.model_actual for r in log} == {"answered"}


def test_prompt_of_very_many_signatures_in_parts(spark):
    """Nothing in the way to the parts holds more than one signature."""
    n = 200_000
    sigs = spark.range(0, n, 1, 8).select(
        F.lit("r").alias("repo"), F.lit("t").alias("test_name"),
        F.sha2(F.col("id").cast("string"), 256).alias("signature_hash"),
        F.concat(F.lit("message "), F.col("id").cast("string")).alias("sample_message"),
        (1 + F.col("id") % 1000).alias("count"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("first_seen"),
        F.lit("2024-01-02 00:00:00").cast("timestamp_ntz").alias("last_seen"),
        F.struct(F.col("id").alias("result_ord"), (F.col("id") + 5).alias("run_id"),
                 F.lit("boom").alias("error_message"), F.lit("stack").alias("stack_trace")).alias("first"),
    )
    stats = spark.createDataFrame(
        [("r", "t", n, n, 100.0, 1.0, "x", 0.1, ["CI"])],
        "repo string, test_name string, total_executions bigint, total_failures bigint, flake_rate double, "
        "failure_rate double, dominant_signature string, dominant_signature_ratio double, "
        "workflows_affected array<string>",
    ).withColumns({
        "first_seen_run": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"),
        "last_seen_run": F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"),
        "first_failure": F.struct(F.lit(0).cast("bigint").alias("result_ord"), F.lit(5).cast("bigint").alias("run_id"),
                                  F.lit("boom").alias("error_message"), F.lit("stack").alias("stack_trace")),
    })
    parts = S.prompt_parts(stats.select("repo", "test_name"), stats, sigs)
    rows = parts.orderBy("part").collect()
    assert len(rows) == n + 4 and max(len(r.text) for r in rows[1:-1]) < 400
    whole = "".join(r.text for r in rows)
    context = json.loads(whole.split("\nCross-run context: ")[1].split("\n\nRespond with")[0])
    counts = [s["count"] for s in context["error_signatures"]]
    assert len(counts) == n and counts == sorted(counts, reverse=True)
    assert context["total_failures"] == n and context["workflows_affected"] == ["CI"]
    few = sigs.filter("first.result_ord < 500")
    asked = S.prompts(stats.select("repo", "test_name"), stats, few).first().prompt
    parts = S.prompt_parts(stats.select("repo", "test_name"), stats, few).orderBy("part").collect()
    assert "".join(r.text for r in parts) == asked
