"""Provider comparisons, accuracy, discovery, cost and samples."""

from pyspark.sql import functions as F

from testpulse.catalog.classification import verdicts_of
from testpulse.catalog.registry import query, sql_with
from testpulse.operators import classify as K
from testpulse.operators import compare as M
from testpulse.operators import scoring as S
from testpulse.plans import ci_tables as C

# Two providers answer for every failing test; they differ where the last digit
# of the first failing execution says so.
_ANSWERS = """SELECT repo, test_name, 'prov_a' AS provider,
  CASE WHEN fail_ord % 3 = 0 THEN 'REAL_BUG' ELSE 'FLAKY' END AS category,
  CAST(fail_ord % 10 AS DOUBLE) / 10 AS confidence FROM verdicts
UNION ALL SELECT repo, test_name, 'prov_b',
  CASE WHEN fail_ord % 4 = 0 THEN 'REAL_BUG' WHEN fail_ord % 7 = 0 THEN 'INFRA' ELSE 'FLAKY' END,
  CAST(fail_ord % 7 AS DOUBLE) / 10 FROM verdicts"""
_TRUTH = """SELECT repo, test_name, CASE WHEN fail_ord % 5 = 0 THEN 'REAL_BUG' ELSE 'FLAKY' END
  AS category FROM verdicts WHERE total_failures % 2 = 0"""
_TRACKED = "SELECT repo, test_name FROM verdicts WHERE total_failures % 3 = 0"


def answers_of(verdicts):
    order = F.col("first_ord")
    first = verdicts.select(
        "repo", "test_name", F.lit("prov_a").alias("provider"),
        F.when(order % 3 == 0, "REAL_BUG").otherwise("FLAKY").alias("category"),
        ((order % 10).cast("double") / 10).alias("confidence"),
    )
    second = verdicts.select(
        "repo", "test_name", F.lit("prov_b").alias("provider"),
        F.when(order % 4 == 0, "REAL_BUG").when(order % 7 == 0, "INFRA").otherwise("FLAKY")
        .alias("category"),
        ((order % 7).cast("double") / 10).alias("confidence"),
    )
    return first.unionByName(second)


def truth_of(verdicts):
    return verdicts.filter(F.col("total_failures") % 2 == 0).select(
        "repo", "test_name",
        F.when(F.col("first_ord") % 5 == 0, "REAL_BUG").otherwise("FLAKY").alias("category"),
    )


@query("provider_agreement", "DOC1",
       sql_with("""SELECT repo, count(*) AS n_tests, count(*) FILTER (k = 1) AS n_agreed,
  round(avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END), 9) AS agreement_rate
FROM (SELECT repo, test_name, count(DISTINCT category) AS k FROM answers GROUP BY ALL) t
GROUP BY repo""", answers=_ANSWERS))
def provider_agreement(spark, d):
    *_, verdicts = verdicts_of(spark, d)
    return M.agreement(answers_of(verdicts)).withColumn(
        "agreement_rate", F.round("agreement_rate", 9)
    )


@query("changed_by_model", "DOC2",
       sql_with("""SELECT a.repo, a.test_name, a.provider, v.category AS rules_category,
  a.category AS model_category FROM answers a JOIN verdicts v USING (repo, test_name)
WHERE a.category <> v.category""", answers=_ANSWERS))
def changed_by_model(spark, d):
    *_, verdicts = verdicts_of(spark, d)
    return M.changed_by_model(verdicts, answers_of(verdicts))


@query("provider_category_counts", "DOC3",
       sql_with("""SELECT repo, category, count(*) FILTER (provider = 'prov_a') AS prov_a,
  count(*) FILTER (provider = 'prov_b') AS prov_b FROM answers GROUP BY repo, category""",
                answers=_ANSWERS))
def provider_category_counts(spark, d):
    *_, verdicts = verdicts_of(spark, d)
    return M.category_counts(answers_of(verdicts), ["prov_a", "prov_b"])


@query("provider_accuracy", "DOC4",
       sql_with("""SELECT provider, count(*) AS n_labelled,
  round(avg(CASE WHEN a.category = t.category THEN 1.0 ELSE 0.0 END), 9) AS accuracy
FROM answers a JOIN truth t USING (repo, test_name) GROUP BY provider""",
                answers=_ANSWERS, truth=_TRUTH))
def provider_accuracy(spark, d):
    *_, verdicts = verdicts_of(spark, d)
    rates = M.accuracy(answers_of(verdicts), truth_of(verdicts))
    return rates.withColumn("accuracy", F.round("accuracy", 9))


@query("discovered_flaky_tests", "DOC5",
       sql_with("""SELECT repo, test_name, flake_rate FROM final WHERE final_category = 'FLAKY'
AND (repo, test_name) NOT IN (SELECT (repo, test_name) FROM tracked)""", tracked=_TRACKED))
def discovered_flaky_tests(spark, d):
    _, _, stats, verdicts = verdicts_of(spark, d)
    tracker = verdicts.filter(F.col("total_failures") % 3 == 0)
    final = K.with_verdict_category(stats, verdicts)
    return M.discovered(final, tracker).select("repo", "test_name", "flake_rate")


@query("call_statistics", "DOC6",
       sql_with("""SELECT provider, count(*) AS n_calls, round(avg(l), 6) AS mean_latency,
  round(quantile_cont(l, 0.5), 6) AS median_latency, min(l) AS min_latency,
  max(l) AS max_latency, round(avg(total_tokens), 6) AS mean_tokens
FROM (SELECT *, round(latency_seconds, 3) AS l FROM responses) t GROUP BY provider"""))
def call_statistics(spark, d):
    stats = M.call_statistics(C.responses(spark, d))
    return stats.withColumn("mean_tokens", F.round("mean_tokens", 6))


_PRICES = ("SELECT 'model-' || p_partkey % 3 AS model, avg(p_retailprice) AS input_price, "
           "avg(p_size) AS output_price FROM part GROUP BY 1")


@query("cost_projection", "DOC7",
       sql_with(f"""SELECT model, calls, round(calls * (i * input_price + o * output_price) / 1000000, 6)
  AS cost FROM (SELECT 'model-' || event_id % 3 AS model, avg(prompt_tokens) AS i,
    avg(completion_tokens) AS o FROM responses GROUP BY 1) u
JOIN ({_PRICES}) p USING (model), (SELECT unnest([20, 200, 2000, 20000]) AS calls) v"""))
def cost_projection(spark, d):
    usage = C.responses(spark, d).withColumn(
        "model", F.concat(F.lit("model-"), (F.col("event_id") % 3).cast("string"))
    )
    prices = (
        spark.read.parquet(f"{d}/part.parquet")
        .groupBy(F.concat(F.lit("model-"), (F.col("p_partkey") % 3).cast("string")).alias("model"))
        .agg(F.avg("p_retailprice").alias("input_price"), F.avg("p_size").alias("output_price"))
    )
    costs = M.cost_projection(usage, prices, [20, 200, 2000, 20000])
    return costs.select("model", "calls", F.round("cost", 6).alias("cost"))


@query("call_health", "DOC8",
       sql_with("""SELECT provider, count(*) AS n_questions,
  count(*) FILTER (event_id % 5 <> 0) AS n_calls,
  count(*) FILTER (event_id % 5 <> 0 AND event_id % 13 IN (2, 4, 5, 7, 8, 9, 11, 12)) AS n_degraded,
  round(count(*) FILTER (event_id % 5 <> 0 AND event_id % 13 IN (2, 4, 5, 7, 8, 9, 11, 12))
    / count(*) FILTER (event_id % 5 <> 0), 9) AS degraded_rate,
  round(count(*) FILTER (event_id % 5 = 0) / count(*), 9) AS cache_hit_rate
FROM responses GROUP BY provider"""))
def call_health(spark, d):
    parsed = S.parse_responses(C.responses(spark, d))
    health = M.call_health(parsed.withColumn("cached", F.col("event_id") % 5 == 0))
    return health.withColumns({
        "degraded_rate": F.round("degraded_rate", 9),
        "cache_hit_rate": F.round("cache_hit_rate", 9),
    })


@query("validation_sample", "DOC9",
       sql_with("""SELECT repo, test_name, final_category, pick FROM (
  SELECT t.*, 10 - sum(CASE WHEN final_category <> 'FLAKY' AND pick <= quota THEN 1 ELSE 0 END)
    OVER (PARTITION BY repo) AS flaky_quota FROM (
    SELECT repo, test_name, final_category, CASE final_category WHEN 'REAL_BUG' THEN 3
        WHEN 'INFRA' THEN 2 ELSE 1 END AS quota,
      row_number() OVER (PARTITION BY repo, final_category ORDER BY CASE
        WHEN final_category <> 'FLAKY' THEN 2 WHEN hi = 1 THEN 0 WHEN lo = 1 THEN 1 ELSE 2 END,
        dice) AS pick
    FROM (SELECT *, row_number() OVER (PARTITION BY repo, final_category
              ORDER BY flake_rate DESC, dice DESC) AS hi,
            row_number() OVER (PARTITION BY repo, final_category ORDER BY flake_rate, dice) AS lo
          FROM (SELECT *, md5('sample|' || repo || '|' || test_name) AS dice FROM final) a) b) t) u
WHERE pick <= CASE WHEN final_category = 'FLAKY' THEN flaky_quota ELSE quota END"""))
def validation_sample(spark, d):
    _, _, stats, verdicts = verdicts_of(spark, d)
    final = K.with_verdict_category(stats, verdicts)
    return M.validation_sample(final).select("repo", "test_name", "final_category", "pick")


@query("low_confidence_verdicts", "DOC12",
       sql_with("""SELECT repo, provider, test_name, category, confidence FROM answers
WHERE confidence < 0.6""", answers=_ANSWERS))
def low_confidence_verdicts(spark, d):
    *_, verdicts = verdicts_of(spark, d)
    return M.low_confidence(answers_of(verdicts)).select(
        "repo", "provider", "test_name", "category", "confidence"
    )
