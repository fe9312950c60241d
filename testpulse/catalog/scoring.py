"""Prompts, response parsing, verdict cache, call log and outcome audit."""

from pyspark.sql import functions as F

from testpulse.catalog.classification import verdicts_of
from testpulse.catalog.registry import query, sql_with
from testpulse.functions import fixed
from testpulse.functions import text as T
from testpulse.functions import verdicts as V
from testpulse.operators import classify as K
from testpulse.operators import scoring as S
from testpulse.plans import ci_tables as C

_BAD = fixed.BAD_JSON_EVIDENCE
# Verdict of each response kind (event_id % 13) of the derived responses.
_PARSED = f"""SELECT *, event_id % 13 AS k FROM responses"""
_PARSE_SQL = f"""SELECT event_id, CASE WHEN content IS NOT NULL AND k NOT IN (4, 8, 9)
    AND json_valid(content) AND coalesce(json_extract_string(content, '$.confidence'), '0.5')
      NOT IN ('high') AND coalesce(json_type(content, '$.confidence'), '') <> 'NULL'
    AND upper(json_extract_string(content, '$.category'))
      IN ('REAL_BUG', 'FLAKY', 'INFRA', 'INSUFFICIENT_DATA')
  THEN upper(json_extract_string(content, '$.category')) ELSE 'FLAKY' END AS category,
  CASE WHEN k = 1 THEN least(1.0, event_id % 5) WHEN k = 0 THEN 0.9 WHEN k = 3 THEN 0.0
    WHEN k = 10 THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence,
  CASE k WHEN 0 THEN 'same error' WHEN 1 THEN 'mixed' WHEN 3 THEN 'LLM classification'
    WHEN 6 THEN 'LLM classification' WHEN 10 THEN 'net'
    WHEN 4 THEN 'LLM response truncated (finish_reason=length, max_tokens=4096); no verdict extracted, defaulted to flaky'
    WHEN 7 THEN 'LLM call failed (' || provider || '): timeout; defaulted to flaky'
    WHEN 8 THEN 'LLM error (' || provider || '): category is not text; defaulted to flaky'
    WHEN 9 THEN 'LLM error (' || provider || '): answer is not an object; defaulted to flaky'
    ELSE '{_BAD}' END AS evidence,
  CASE WHEN k IN (7, 8, 9) THEN 'llm-fallback:' || provider || ':model-x'
    WHEN k = 4 THEN 'llm-truncated:' || provider || ':model-x-1'
    WHEN k IN (2, 5, 11, 12) THEN 'llm-parse-error:' || provider || ':model-x-1'
    ELSE 'llm:' || provider || ':model-x-1' END AS classified_by FROM p"""


@query("response_verdicts", "FN15 FN16", sql_with(_PARSE_SQL, p=_PARSED))
def response_verdicts(spark, d):
    parsed = S.parse_responses(C.responses(spark, d))
    return parsed.select("event_id", "category", "confidence", "evidence", "classified_by")


@query("confidence_clamp", "FN16",
       "SELECT event_id, greatest(0.0, least(1.0, (value - 50) / 100)) AS confidence FROM events")
def confidence_clamp(spark, d):
    return C.events(spark, d).select(
        "event_id", V.clamp((F.col("value") - 50) / 100).alias("confidence")
    )


@query("cache_names", "FN13",
       sql_with("""SELECT DISTINCT 'prov_a_model-x_' || replace(replace(replace(test_name, '/', '_'),
  '::', '_'), ' ', '_') || '.json' AS name, test_name FROM results"""))
def cache_names(spark, d):
    tests = C.results(spark, d).select("test_name").distinct()
    return tests.select(
        T.cache_name(F.lit("prov_a"), F.lit("model-x"), F.col("test_name")).alias("name"),
        "test_name",
    )


_HEAD = fixed.PROMPT_HEAD.replace("'", "''")
_TAIL = fixed.PROMPT_TAIL.replace("'", "''")
_PROMPT_SQL = f"""SELECT repo, test_name, '{_HEAD}' || chr(10) || 'Test name: ' || test_name || chr(10)
  || 'Error message: ' || error_message || chr(10) || 'Stack trace: ' || stack_trace
  || chr(10) || chr(10) || '{_TAIL}' AS prompt FROM stats WHERE fail_ord IS NOT NULL"""


@query("failure_prompts", "FN14", sql_with(_PROMPT_SQL))
def failure_prompts(spark, d):
    """Prompts without a context, for every failing test."""
    _, _, stats, _ = verdicts_of(spark, d)
    first = F.col("first_failure")
    nothing = F.lit(None).cast("string")
    return stats.filter(first.isNotNull()).select(
        "repo", "test_name",
        V.prompt(F.col("test_name"), first["error_message"], first["stack_trace"], nothing)
        .alias("prompt"),
    )


@query("context_prompts", "FN14 FN20 FLT11",
       sql_with(f"""SELECT repo, test_name, run_id, total_executions, dominant_signature,
  (SELECT string_agg(signature_hash, ',' ORDER BY place) FROM ranked r
    WHERE r.repo = s.repo AND r.test_name = s.test_name) AS signatures
FROM stats s WHERE (repo, test_name) IN (SELECT (repo, test_name) FROM verdicts
  WHERE rule = 'default')"""))
def context_prompts(spark, d):
    """Prompts of ambiguous tests; their JSON context is read back."""
    results, sigs, stats, _ = verdicts_of(spark, d)
    undecided = K.ambiguous(K.rule_verdicts(stats))
    asked = S.prompts(undecided, stats, sigs)
    context = F.regexp_extract("prompt", r"(?s)\nCross-run context: (\{.*\})\n\nRespond with", 1)
    kind = ("struct<total_executions:bigint,dominant_signature:string,"
            "error_signatures:array<struct<signature_hash:string>>>")
    return asked.withColumn("c", F.from_json(context, kind)).select(
        "repo", "test_name", "run_id", "c.total_executions", "c.dominant_signature",
        F.array_join("c.error_signatures.signature_hash", ",").alias("signatures"),
    )


@query("prompt_parts", "FN14",
       sql_with("""SELECT s.repo, s.test_name, s.run_id, n_signatures + 4 AS parts
FROM stats s WHERE (repo, test_name) IN (SELECT (repo, test_name) FROM verdicts
  WHERE rule = 'default')"""))
def prompt_parts(spark, d):
    """The same prompts in parts, one a signature and four around them."""
    results, sigs, stats, _ = verdicts_of(spark, d)
    undecided = K.ambiguous(K.rule_verdicts(stats))
    return S.prompt_parts(undecided, stats, sigs).groupBy("repo", "test_name", "run_id").agg(
        F.count(F.lit(1)).alias("parts")
    )


def _cache(spark, d):
    """Cached verdicts of the responses, one version per answer."""
    parsed = S.parse_responses(C.responses(spark, d)).withColumn("version", F.col("event_id"))
    return S.cacheable(parsed)


_CACHE = f"""SELECT r.*, v.category, v.confidence, v.evidence, v.classified_by
FROM responses r JOIN ({{parse}}) v USING (event_id)
WHERE NOT starts_with(v.classified_by, 'llm-fallback')""".format(parse=_PARSE_SQL)
_LATEST = """SELECT provider, model, repo, test_name, max(event_id) AS version,
  arg_max(category, event_id) AS category, arg_max(confidence, event_id) AS confidence,
  arg_max(classified_by, event_id) AS classified_by FROM cache
GROUP BY provider, model, repo, test_name"""


@query("verdict_cache_latest", "SNK7 SRC5",
       sql_with("SELECT * FROM latest", p=_PARSED, cache=_CACHE, latest=_LATEST))
def verdict_cache_latest(spark, d):
    """Half of the answers are in the cache, half are upserted."""
    cache = _cache(spark, d)
    old = cache.filter(F.col("event_id") % 2 == 0)
    new = cache.filter(F.col("event_id") % 2 == 1)
    return S.upsert(old, new).select("provider", "model", "repo", "test_name", "version",
                                     "category", "confidence", "classified_by")


_WANTED = """SELECT DISTINCT repo, test_name, 'prov_a' AS provider, 'model-x' AS model
FROM results"""


def _wanted(spark, d):
    return C.results(spark, d).select(
        "repo", "test_name", F.lit("prov_a").alias("provider"), F.lit("model-x").alias("model")
    ).distinct()


@query("verdict_cache_hits", "JN7",
       sql_with("""SELECT w.repo, w.test_name, l.category, l.classified_by
FROM wanted w JOIN latest l USING (provider, model, repo, test_name)""",
                p=_PARSED, cache=_CACHE + " AND r.event_id % 3 = 0", latest=_LATEST,
                wanted=_WANTED))
def verdict_cache_hits(spark, d):
    """All tests against a cache that holds a third of the answers: set-up, as an earlier run
    would have left it; the lookup reads all of both."""
    cache = _cache(spark, d).filter(F.col("event_id") % 3 == 0)
    return S.cache_hits(_wanted(spark, d), cache).select(
        "repo", "test_name", "category", "classified_by"
    )


@query("verdict_cache_misses", "JN7",
       sql_with("""SELECT w.repo, w.test_name FROM wanted w WHERE NOT EXISTS (
  SELECT 1 FROM cache c WHERE c.provider = w.provider AND c.repo = w.repo
    AND c.test_name = w.test_name)""",
                p=_PARSED, cache=_CACHE + " AND r.event_id % 40 = 0", wanted=_WANTED))
def verdict_cache_misses(spark, d):
    """All tests against a cache that holds few answers: set-up, so that there are misses; the
    lookup reads all of both."""
    cache = _cache(spark, d).filter(F.col("event_id") % 40 == 0)
    return S.cache_misses(_wanted(spark, d), cache).select("repo", "test_name")


def stub_scorer(questions):
    """A deterministic stand-in for a model: answers by the test's last digit."""
    digit = F.substring("test_name", -1, 1)
    category = F.when(digit < "5", "REAL_BUG").otherwise("FLAKY")
    return questions.select(
        "repo", "test_name", "run_id", "provider", "model",
        F.lit("stop").alias("finish_reason"),
        F.concat(F.lit('{"category": "'), category,
                 F.lit('", "evidence": "stub", "confidence": 0.7}')).alias("content"),
        F.lit(None).cast("string").alias("call_error"),
    )


@query("scored_verdicts", "FLT11 JN7 FN5",
       sql_with("""SELECT repo, test_name, CASE WHEN rule <> 'default' THEN category
    WHEN right(test_name, 1) < '5' THEN 'REAL_BUG' ELSE 'FLAKY' END AS category,
  CASE WHEN rule = 'default' THEN 'llm:stub:s1' ELSE 'rules' END AS classified_by,
  CASE WHEN rule = 'default' THEN 0.7 ELSE confidence END AS confidence FROM verdicts"""))
def scored_verdicts(spark, d):
    _, sigs, stats, _ = verdicts_of(spark, d)
    ruled = K.rule_verdicts(stats)
    questions = S.prompts(K.ambiguous(ruled), stats, sigs)
    scored = S.score(questions, stub_scorer, "stub", "s1").verdicts
    return K.default_verdicts(K.with_scores(ruled, scored)).select(
        "repo", "test_name", "category", "classified_by", "confidence"
    )


@query("outcome_audit", "AGG14 AGG15",
       sql_with("""SELECT repo, count(*) FILTER (starts_with(b, 'llm')) AS llm_call_count,
  count(*) FILTER (starts_with(b, 'llm-truncated')) AS llm_truncated_count,
  count(*) FILTER (starts_with(b, 'llm-parse-error')) AS llm_parse_error_count,
  count(*) FILTER (starts_with(b, 'llm-fallback')) AS llm_fallback_count,
  count(*) FILTER (starts_with(b, 'llm-')) AS degraded_count FROM (
  SELECT repo, test_name, arg_min(v.classified_by, event_id) AS b
  FROM responses JOIN v USING (event_id) GROUP BY ALL) t GROUP BY repo""",
                p=_PARSED, v=_PARSE_SQL))
def outcome_audit(spark, d):
    parsed = S.parse_responses(C.responses(spark, d)).withColumnRenamed("event_id", "result_ord")
    return S.outcome_audit(S.first_verdict_per_test(parsed))


@query("call_log", "SNK8",
       sql_with("""SELECT event_id % 13 = 7 AS failed, provider, repo, count(*) AS n_calls,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS last_in_group
FROM responses GROUP BY ALL"""))
def call_log(spark, d):
    log = S.call_log(C.responses(spark, d))
    return log.groupBy(
        F.col("error").isNotNull().alias("failed"), "provider", "repo"
    ).agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("total_tokens").alias("total_tokens"),
        F.count_distinct("call_number").alias("last_in_group"),
    )
