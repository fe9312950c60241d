"""Statistics, rules, copies and votes."""

import pytest
from pyspark.sql import functions as F

from testpulse.functions import fixed, rules
from testpulse.operators import classify as K
from testpulse.operators import stats as S


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_counts_rates_and_times(make_results):
    rows = [("t", "PASSED", "", i) for i in range(8)] + [("t", "FAILED", "boom", 8),
                                                        ("t", "ERROR", "boom", 9, "Lint")]
    got = one(S.test_stats(make_results(rows)))
    assert (got.total_executions, got.total_failures) == (10, 2)
    assert (got.flake_rate, got.failure_rate) == (20.0, 0.2)
    assert got.workflows_affected == ["CI", "Lint"]
    assert (got.n_signatures, got.dominant_signature_ratio) == (1, 1.0)
    assert got.first_seen_run.hour == 0 and got.last_seen_run.hour == 9


def test_test_that_never_fails(make_results):
    got = one(S.test_stats(make_results([("t", "PASSED", ""), ("t", "SKIPPED", "")])))
    assert (got.total_failures, got.flake_rate, got.n_signatures) == (0, 0.0, 0)
    assert got.dominant_signature is None and got.dominant_signature_ratio == 0.0


def test_dominant_signature_and_sample(make_results):
    rows = [("t", "FAILED", "ValueError"), ("t", "FAILED", "/home/a/x.py:1: E"),
            ("t", "FAILED", "/home/b/x.py:2: E")]
    results = make_results(rows)
    sigs = S.signatures_by_count(S.signatures(results)).collect()
    assert [(s["sample_message"], s["count"]) for s in sigs] == [
        ("/home/a/x.py:1: E", 2), ("ValueError", 1)]
    got = one(S.test_stats(results))
    assert got.dominant_signature == sigs[0].signature_hash
    assert got.dominant_signature_ratio == pytest.approx(2 / 3)


def test_equal_counts_take_the_first_seen_signature(make_results):
    rows = [("t", "FAILED", m) for m in ("b", "a", "a", "b")]
    results = make_results(rows)
    first = S.signatures(results).filter("sample_message = 'b'").first().signature_hash
    assert one(S.test_stats(results)).dominant_signature == first


def test_message_of_no_message(make_results):
    got = one(S.signatures(make_results([("t", "FAILED", "")])))
    assert got.sample_message == "(no error message)"
    assert got.signature_hash == "e3b0c44298fc1c14"


@pytest.mark.parametrize("message, pattern", [
    ("Timeout waiting", "timeout"), ("request timed out", r"timed?\s*out"),
    ("OUT OF  MEMORY", r"out\s+of\s+memory"), ("oom", "OOM"), ("OOMKilled", "OOM"),
    ("process killed", "killed"), ("SIGKILL", "SIGKILL"), ("got sigterm", "SIGTERM"),
    ("/home/runner/x", "runner"), ("self-hosted box", "self-hosted"), ("network down", "network"),
    ("connection refused", r"connection\s+refused"), ("ETIMEDOUT", r"timed?\s*out"),
    ("ECONNRESET", "ECONNRESET"), ("ECONNREFUSED", "ECONNREFUSED"), ("ENOTFOUND", "ENOTFOUND"),
    ("HTTP 503", "503"), ("line 1502", "502"), ("504", "504"), ("AssertionError", None),
    ("timed\nout", r"timed?\s*out")])
def test_infra_patterns(spark, message, pattern):
    df = spark.createDataFrame([(message,)], "m string")
    for build in (rules.infra_pattern(F.col("m"), F.lit("")),
                  rules.infra_pattern(F.lit("x"), F.col("m"))):
        assert df.select(build).first()[0] == pattern


@pytest.mark.parametrize("infra, n, ratio, rate, sigs, rule, confidence", [
    ("502", 10, 1.0, 1.0, 1, "infra", 0.9),
    (None, 49, 1.0, 1.0, 1, "insufficient", 1.0),
    (None, 50, 0.9, 0.51, 1, "real_bug", 0.85),
    (None, 50, 0.89, 0.51, 1, "undecided", None),
    (None, 100, 0.95, 0.5, 2, "undecided", None),
    (None, 100, 0.95, 0.8, 2, "real_bug", 0.85),
    (None, 100, 0.5, 0.49, 2, "flaky", 0.8),
    (None, 100, 1.0, 0.1, 1, "undecided", None),
    (None, None, None, None, None, "undecided", None)])
def test_cascade(spark, infra, n, ratio, rate, sigs, rule, confidence):
    df = spark.createDataFrame([(infra, n, ratio, rate, sigs)],
                               "i string, n bigint, ratio double, rate double, s bigint")
    got = df.select(rules.decide(F.col("i"), F.col("n"), F.col("ratio"), F.col("rate"),
                                 F.col("s"), F.lit("abc")).alias("v")).first().v
    assert (got.rule, got.confidence) == (rule, confidence)


def test_evidence_texts(spark):
    df = spark.createDataFrame([(60, 0.95, 0.8, 3), (60, 0.5, 0.125, 3)],
                               "n bigint, ratio double, rate double, s bigint")
    got = [r.v.evidence for r in df.select(rules.decide(
        F.lit(None).cast("string"), F.col("n"), F.col("ratio"), F.col("rate"), F.col("s"),
        F.lit("abc")).alias("v")).collect()]
    assert got == ["Dominant signature abc in 95% of failures, failure rate 80%",
                   "3 distinct error signatures, failure rate 12%"]


def test_forced_skips_rules(make_results):
    stats = S.test_stats(make_results([("t", "FAILED", "timeout")]))
    verdict = one(K.default_verdicts(K.rule_verdicts(stats, forced=True), forced=True))
    assert (verdict.category, verdict.evidence) == ("FLAKY", fixed.FORCED_EVIDENCE)


def test_first_failure_decides_for_all(make_results):
    rows = [("t", "PASSED", "", 1), ("t", "FAILED", "timeout", 2), ("t", "ERROR", "assert", 3)]
    results = make_results(rows)
    verdicts = K.default_verdicts(K.rule_verdicts(S.test_stats(results)))
    got = K.classifications(results, verdicts).collect()
    assert [(r.run_id, r.category) for r in got] == [(2, "INFRA")] * 2
    assert one(K.grouped_classifications(K.classifications(results, verdicts))).n == 2


def test_limit_stops_after_n_tests(make_results):
    rows = [("a", "FAILED", "x"), ("b", "FAILED", "x"), ("a", "FAILED", "x"),
            ("c", "FAILED", "x"), ("a", "FAILED", "x")]
    results = make_results(rows)
    verdicts = K.default_verdicts(K.rule_verdicts(S.test_stats(results)))
    got = K.classifications(results, K.with_cutoff(verdicts, 2)).collect()
    assert sorted((r.result_ord, r.test_name) for r in got) == [(0, "a"), (1, "b")]
    every = K.classifications(results, K.with_cutoff(verdicts, 0))
    assert every.count() == 5


@pytest.mark.parametrize("categories, n, forced, want", [
    ([], 49, False, "INSUFFICIENT_DATA"),
    (["REAL_BUG"], 49, False, "INSUFFICIENT_DATA"),
    (["REAL_BUG"], 49, True, "REAL_BUG"),
    ([], 51, False, "FLAKY"),
    (["INFRA", "INFRA", "FLAKY"], 51, False, "INFRA"),
    (["REAL_BUG", "FLAKY"], 51, False, "FLAKY"),
    (["REAL_BUG", "INFRA"], 51, False, "INFRA"),
    (["REAL_BUG", "INSUFFICIENT_DATA"], 51, False, "REAL_BUG")])
def test_votes(spark, make_results, categories, n, forced, want):
    rows = [("t", "FAILED", "x")] * 2 + [("t", "PASSED", "")] * (n - 2)
    stats = S.test_stats(make_results(rows))
    classified = spark.createDataFrame(
        [("org/app", "t", c) for c in categories], "repo string, test_name string, category string")
    got = one(K.with_final_category(stats, classified, forced=forced))
    assert got.final_category == want


def test_repos_are_kept_apart(make_results):
    both = make_results([("t", "FAILED", "x")]).unionByName(
        make_results([("t", "PASSED", "")], repo="org/other"))
    got = {r.repo: r.total_failures for r in S.test_stats(both).collect()}
    assert got == {"org/app": 1, "org/other": 0}
