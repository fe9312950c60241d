"""Rules, copies of verdicts, votes and categories."""

from pyspark.sql import functions as F

from testpulse.catalog.registry import query, sql_with
from testpulse.catalog.statistics import FLAT_STATS_SQL, flat_stats, staged_stats
from testpulse.operators import classify as K
from testpulse.plans import ci_tables as C

VERDICT_SQL = """SELECT repo, test_name, run_id, category, evidence, confidence, classified_by, rule
FROM verdicts"""


def verdicts_of(spark, d):
    results, sigs, stats = staged_stats(spark, d)
    return results, sigs, stats, K.default_verdicts(K.rule_verdicts(stats))


@query("rule_verdicts", "FN5 FN6 JN3 WIN1", sql_with(VERDICT_SQL))
def rule_verdicts(spark, d):
    *_, verdicts = verdicts_of(spark, d)
    return verdicts.select("repo", "test_name", "run_id", "category", "evidence",
                           "confidence", "classified_by", "rule")


@query("forced_verdicts", "FN5",
       sql_with("""SELECT repo, test_name, run_id, 'FLAKY' AS category, 0.5::DOUBLE AS confidence,
  'force_llm enabled but no LLM adapter available' AS evidence FROM verdicts"""))
def forced_verdicts(spark, d):
    *_, stats = staged_stats(spark, d)
    forced = K.default_verdicts(K.rule_verdicts(stats, forced=True), forced=True)
    return forced.select("repo", "test_name", "run_id", "category", "confidence", "evidence")


@query("ambiguous_tests", "FLT11",
       sql_with("SELECT repo, test_name, run_id FROM verdicts WHERE rule = 'default'"))
def ambiguous_tests(spark, d):
    *_, stats = staged_stats(spark, d)
    return K.ambiguous(K.rule_verdicts(stats)).select("repo", "test_name", "run_id")


@query("classifications", "WIN1 JN3",
       sql_with("""SELECT f.result_ord, f.repo, f.test_name, v.run_id, v.category, v.confidence
FROM failing f JOIN verdicts v USING (repo, test_name)"""))
def classifications(spark, d):
    results, _, _, verdicts = verdicts_of(spark, d)
    return K.classifications(results, verdicts).select(
        "result_ord", "repo", "test_name", "run_id", "category", "confidence"
    )


@query("classification_lists", "AGG10 JN4",
       sql_with("""SELECT s.repo, s.test_name, s.total_failures, v.run_id, v.category,
  coalesce(n, 0) AS n FROM stats s LEFT JOIN (
  SELECT repo, test_name, v.run_id, v.category, count(*) AS n
  FROM failing JOIN verdicts v USING (repo, test_name) GROUP BY ALL) v USING (repo, test_name)"""))
def classification_lists(spark, d):
    results, _, stats, verdicts = verdicts_of(spark, d)
    lists = K.grouped_classifications(K.classifications(results, verdicts))
    return (
        stats.select("repo", "test_name", "total_failures")
        .join(lists.select("repo", "test_name", "run_id", "category", "n"),
              ["repo", "test_name"], "left")
        .fillna(0, ["n"])
    )


_LIMIT = 20


@query("limited_classifications", "WIN2",
       sql_with(f"""SELECT f.result_ord, f.repo, f.test_name, v.category
FROM failing f JOIN verdicts v USING (repo, test_name) JOIN (
  SELECT repo, max(fail_ord) AS cutoff FROM (
    SELECT repo, fail_ord, row_number() OVER (PARTITION BY repo ORDER BY fail_ord) AS k
    FROM verdicts) t WHERE k <= {_LIMIT} GROUP BY repo) c USING (repo)
WHERE f.result_ord <= c.cutoff"""))
def limited_classifications(spark, d):
    results, _, _, verdicts = verdicts_of(spark, d)
    limited = K.with_cutoff(verdicts, _LIMIT)
    return K.classifications(results, limited).select("result_ord", "repo", "test_name", "category")


@query("limited_categories", "WIN2 AGG8",
       sql_with(f"""SELECT s.repo, s.test_name, CASE WHEN total_executions < 50
    THEN 'INSUFFICIENT_DATA' WHEN v.k <= {_LIMIT} THEN v.category ELSE 'FLAKY' END
    AS final_category
FROM stats s LEFT JOIN (SELECT repo, test_name, category,
  row_number() OVER (PARTITION BY repo ORDER BY fail_ord) AS k FROM verdicts) v
  USING (repo, test_name)"""))
def limited_categories(spark, d):
    _, _, stats, verdicts = verdicts_of(spark, d)
    limited = K.with_cutoff(verdicts, _LIMIT)
    return K.with_verdict_category(stats, limited).select("repo", "test_name", "final_category")


@query("final_categories", "AGG8 AGG9 WIN4",
       sql_with(FLAT_STATS_SQL.format(table="final").replace(
           "workflows FROM", "workflows, final_category FROM")))
def final_categories(spark, d):
    _, _, stats, verdicts = verdicts_of(spark, d)
    final = K.with_verdict_category(stats, verdicts)
    return flat_stats(final, "final_category")


_VOTED = """SELECT repo, test_name, category, count(*) AS n FROM (
  SELECT repo, test_name, CASE result_ord % 4 WHEN 0 THEN 'FLAKY' WHEN 1 THEN 'INFRA'
    WHEN 2 THEN 'REAL_BUG' ELSE 'FLAKY' END AS category
  FROM failing WHERE result_ord % 8 <> 3) t GROUP BY ALL"""


@query("majority_vote", "AGG8 WIN4",
       sql_with("""SELECT s.repo, s.test_name, CASE WHEN s.total_executions < 60
    THEN 'INSUFFICIENT_DATA' ELSE coalesce(v.category, 'FLAKY') END AS final_category
FROM stats s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY repo, test_name
    ORDER BY n DESC, CASE category WHEN 'FLAKY' THEN 3 WHEN 'INFRA' THEN 2 ELSE 1 END DESC) AS k
  FROM voted) v ON v.repo = s.repo AND v.test_name = s.test_name AND v.k = 1""", voted=_VOTED))
def majority_vote(spark, d):
    """Votes that differ within a test, so that counts and ties decide."""
    results, _, stats = staged_stats(spark, d)
    order = F.col("result_ord")
    category = (
        F.when(order % 4 == 1, "INFRA").when(order % 4 == 2, "REAL_BUG").otherwise("FLAKY")
    )
    classified = (
        results.filter(F.col("status").isin("FAILED", "ERROR"))
        .filter(order % 8 != 3)
        .select("repo", "test_name", category.alias("category"))
    )
    voted = K.with_final_category(stats, classified, min_sample=60)
    return voted.select("repo", "test_name", "final_category")


@query("category_split", "FLT10",
       sql_with("""SELECT repo, final_category, count(*) AS n_tests, min(test_name) AS first_test,
  CAST(sum(total_failures) AS BIGINT) AS failures FROM final GROUP BY ALL"""))
def category_split(spark, d):
    _, _, stats, verdicts = verdicts_of(spark, d)
    final = K.with_verdict_category(stats, verdicts)
    return final.groupBy("repo", "final_category").agg(
        F.count(F.lit(1)).alias("n_tests"), F.min("test_name").alias("first_test"),
        F.sum("total_failures").alias("failures"),
    )


@query("tests_in_first_seen_order", "TOP5",
       sql_with("""SELECT repo, final_category, test_name, first_ord FROM final
ORDER BY repo, final_category, first_ord"""))
def tests_in_first_seen_order(spark, d):
    _, _, stats, verdicts = verdicts_of(spark, d)
    final = K.with_verdict_category(stats, verdicts)
    return final.select("repo", "final_category", "test_name", "first_ord").orderBy(
        "repo", "final_category", "first_ord"
    )


@query("results_with_context", "JN3 SET1",
       sql_with("""SELECT f.result_ord, f.repo, f.test_name, s.total_executions, s.failure_rate
FROM failing f JOIN stats s USING (repo, test_name)"""))
def results_with_context(spark, d):
    from testpulse.operators.spread import attach_per_key

    results, _, stats = staged_stats(spark, d)
    context = stats.select("repo", "test_name", "total_executions", "failure_rate",
                           "total_failures")
    failing = C.results(spark, d).filter(F.col("status").isin("FAILED", "ERROR"))
    return attach_per_key(
        failing.select("result_ord", "repo", "test_name"), context, ["repo", "test_name"],
        "total_failures", F.col("result_ord"),
    ).drop("total_failures")
