"""Run metadata: filters, slices, joins with archives and the ledger, quality."""

from pyspark.sql import functions as F

from testpulse.catalog.registry import query, sql_with
from testpulse.functions import text as T
from testpulse.operators import runs as R
from testpulse.plans import ci_tables as C

# Archive state and download status by run id, alike in both engines.
ARCHIVES_SQL = """SELECT repo, run_id, CASE WHEN run_id % 11 = 3 THEN 'corrupt'
  WHEN run_id % 13 = 5 THEN 'error' ELSE 'ok' END AS status,
  CAST(run_id AS VARCHAR) || '.zip' AS archive FROM runs WHERE run_id % 7 <> 2"""
LEDGER_SQL = "SELECT repo, run_id FROM runs WHERE run_id % 5 < 2"


def archives_of(runs):
    state = (
        F.when(F.col("run_id") % 11 == 3, "corrupt")
        .when(F.col("run_id") % 13 == 5, "error").otherwise("ok")
    )
    return runs.filter(F.col("run_id") % 7 != 2).select(
        "repo", "run_id", state.alias("status"),
        F.concat(F.col("run_id").cast("string"), F.lit(".zip")).alias("archive"),
    )


def ledger_of(runs):
    return runs.filter(F.col("run_id") % 5 < 2).select("repo", "run_id")


def _id(df):
    return df.select("repo", "run_id")


@query("failed_runs", "FLT1",
       sql_with("SELECT repo, run_id, workflow_name FROM runs WHERE conclusion = 'failure'"))
def failed_runs(spark, d):
    return R.failed_runs(C.runs(spark, d)).select("repo", "run_id", "workflow_name")


@query("workflow_runs", "FLT3",
       sql_with("SELECT repo, run_id FROM runs WHERE workflow_name = 'Lint'"))
def workflow_runs(spark, d):
    return _id(R.of_workflow(C.runs(spark, d), "Lint"))


@query("runs_since", "FLT4",
       sql_with("SELECT repo, run_id FROM runs WHERE timestamp >= TIMESTAMP '2024-01-15 09:30:00'"))
def runs_since(spark, d):
    return _id(R.since(C.runs(spark, d), "2024-01-15T11:30:00+02:00"))


@query("runs_with_wanted_logs", "FLT6",
       sql_with("""SELECT repo, run_id, 'failed' AS scope FROM runs WHERE conclusion = 'failure'
UNION ALL SELECT repo, run_id, 'all' FROM runs"""))
def runs_with_wanted_logs(spark, d):
    runs = C.runs(spark, d)
    failed = _id(R.runs_with_logs_in_scope(runs)).withColumn("scope", F.lit("failed"))
    every = _id(R.runs_with_logs_in_scope(runs, all_runs=True)).withColumn("scope", F.lit("all"))
    return failed.unionByName(every)


@query("results_in_failed_runs", "FLT7",
       sql_with("""SELECT result_ord, repo, run_id, status FROM results
WHERE (repo, run_id) IN (SELECT (repo, run_id) FROM runs WHERE conclusion = 'failure')"""))
def results_in_failed_runs(spark, d):
    runs = R.failed_runs(C.runs(spark, d))
    kept = R.in_runs(C.results(spark, d), runs, F.col("result_ord"))
    return kept.select("result_ord", "repo", "run_id", "status")


@query("run_field_defaults", "FLT5 FLT12 FN21",
       """SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 'url' || event_id
  ELSE 'CI' END AS workflow_name, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'success' END
  AS conclusion, 'org_app' || user_id AS slug,
  date_trunc('second', ts) AS started FROM events""")
def run_field_defaults(spark, d):
    e = C.events(spark, d)
    name = (
        F.when(F.col("event_id") % 3 == 0, F.lit(None)).when(F.col("event_id") % 5 == 0, "")
        .otherwise("CI")
    )
    url = F.concat(F.lit("url"), F.col("event_id").cast("string"))
    conclusion = F.when(F.col("event_id") % 4 != 0, "success")
    iso = F.concat(T.iso_time(F.col("ts")), F.lit("+00:00"))
    return e.select(
        "event_id", T.workflow_or_url(name, url).alias("workflow_name"),
        F.coalesce(conclusion, F.lit("")).alias("conclusion"),
        T.repo_slug(F.concat(F.lit("org/app"), F.col("user_id").cast("string"))).alias("slug"),
        F.to_timestamp_ntz(F.substring(iso, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("started"),
    )


@query("repo_routes", "FLT9",
       sql_with("""SELECT p.repo, coalesce(n_runs, 0) AS n_runs, coalesce(n_failed, 0) AS n_failed,
  CASE WHEN coalesce(n_runs, 0) = 0 THEN 'error' WHEN n_failed = 0 THEN 'no_failures'
    ELSE 'has_failures' END AS route
FROM (SELECT DISTINCT 'org/app' || CAST(user_id % 7 AS VARCHAR) AS repo FROM events) p LEFT JOIN (
  SELECT repo, count(*) AS n_runs, count(*) FILTER (conclusion = 'failure') AS n_failed
  FROM (SELECT * FROM runs WHERE repo <> 'org/app1' OR conclusion <> 'failure') t
  GROUP BY repo) r USING (repo)"""))
def repo_routes(spark, d):
    repos = C.events(spark, d).select(
        F.concat(F.lit("org/app"), (F.col("user_id") % 7).cast("string")).alias("repo")
    ).distinct()
    runs = C.runs(spark, d)
    runs = runs.filter((F.col("repo") != "org/app1") | (F.col("conclusion") != "failure"))
    return R.routes(repos, runs)


@query("newest_runs", "TOP1",
       sql_with("""SELECT repo, run_id, k FROM (SELECT repo, run_id, row_number() OVER (
  PARTITION BY repo ORDER BY timestamp DESC, run_id DESC) AS k FROM runs) t WHERE k <= 25"""))
def newest_runs(spark, d):
    return R.newest_runs(C.runs(spark, d), 25).select(
        "repo", "run_id", F.col("row_no").alias("k")
    )


@query("run_slice", "TOP2",
       sql_with("""SELECT repo, run_id, k FROM (SELECT repo, run_id, row_number() OVER (
  PARTITION BY repo ORDER BY CAST(run_id AS VARCHAR)) - 1 AS k FROM runs) t
WHERE k >= 10 AND k < 110"""))
def run_slice(spark, d):
    return R.run_slice(C.runs(spark, d), 10, 100).select(
        "repo", "run_id", F.col("row_no").alias("k")
    )


@query("runs_after_newest", "TOP3",
       sql_with("""SELECT repo, run_id, k FROM (SELECT repo, run_id, row_number() OVER (
  PARTITION BY repo ORDER BY timestamp DESC, run_id DESC) - 1 AS k FROM runs) t
WHERE k >= 30 AND k < 90"""))
def runs_after_newest(spark, d):
    return R.runs_after_newest(C.runs(spark, d), 30, 60).select(
        "repo", "run_id", F.col("row_no").alias("k")
    )


@query("unprocessed_runs", "JN6",
       sql_with(f"SELECT repo, run_id FROM runs WHERE (repo, run_id) NOT IN "
                f"(SELECT (repo, run_id) FROM ({LEDGER_SQL}) l)"))
def unprocessed_runs(spark, d):
    runs = C.runs(spark, d)
    return _id(R.unprocessed(runs, ledger_of(runs)))


@query("processed_ids", "SET3",
       sql_with(f"""{LEDGER_SQL} UNION SELECT repo, run_id FROM runs WHERE run_id % 3 = 0"""))
def processed_ids(spark, d):
    runs = C.runs(spark, d)
    return R.processed_ids(ledger_of(runs), runs.filter(F.col("run_id") % 3 == 0))


@query("new_offset_ranges", "SET4",
       """SELECT DISTINCT 'org/app' || CAST(user_id % 3 AS VARCHAR) AS repo,
  event_id // 100 * 100 AS range_start, event_id // 100 * 100 + 100 AS range_end
FROM events WHERE (event_id // 100) % 4 <> user_id % 3""")
def new_offset_ranges(spark, d):
    e = C.events(spark, d).select(
        F.concat(F.lit("org/app"), (F.col("user_id") % 3).cast("string")).alias("repo"),
        (F.floor(F.col("event_id") / 100) * 100).alias("range_start"),
        (F.floor(F.col("event_id") / 100) * 100 + 100).alias("range_end"),
    ).distinct()
    block = F.floor(F.col("range_start") / 100) % 4
    done = e.filter(block == F.substring("repo", 8, 1).cast("bigint"))
    return R.new_ranges(e, done)


@query("log_states", "JN5",
       sql_with("""SELECT r.repo, r.run_id, CASE WHEN a.status = 'ok' THEN 'ok'
  WHEN a.status = 'error' THEN 'error' ELSE 'expired' END AS log_state
FROM runs r LEFT JOIN archives a USING (repo, run_id) WHERE r.conclusion = 'failure'""",
                archives=ARCHIVES_SQL))
def log_states(spark, d):
    runs = C.runs(spark, d)
    return R.log_states(runs, archives_of(runs))


_QUALITY = """SELECT r.repo, count(*) AS runs_requested, count(*) AS runs_fetched,
  count(*) FILTER (conclusion = 'failure') AS runs_with_failures,
  count(*) FILTER (conclusion = 'failure' AND a.status = 'ok') AS runs_with_logs,
  count(*) FILTER (conclusion = 'failure' AND (a.status IS NULL OR a.status = 'corrupt'))
    AS runs_skipped_expired,
  count(*) FILTER (conclusion = 'failure' AND a.status = 'error') AS runs_skipped_error,
  count(*) FILTER (conclusion = 'failure' AND a.status = 'ok') AS effective_sample,
  string_agg(DISTINCT workflow_name, ',' ORDER BY workflow_name) AS workflows
FROM runs r LEFT JOIN archives a USING (repo, run_id) GROUP BY r.repo"""


@query("data_quality", "AGG16 AGG17", sql_with(_QUALITY, archives=ARCHIVES_SQL))
def data_quality(spark, d):
    runs = C.runs(spark, d)
    quality = R.data_quality(runs, archives_of(runs))
    return quality.withColumn("workflows", F.array_join("workflows_analyzed", ",")).drop(
        "workflows_analyzed"
    )


@query("distinct_workflows", "AGG17",
       sql_with("SELECT DISTINCT repo, workflow_name FROM runs"))
def distinct_workflows(spark, d):
    return R.workflows(C.runs(spark, d))


@query("pass_rates", "AGG12",
       sql_with("""SELECT repo, count(*) AS total_runs,
  round(avg(CASE WHEN conclusion = 'success' THEN 1.0 ELSE 0.0 END), 9) AS overall_pass_rate
FROM runs GROUP BY repo"""))
def pass_rates(spark, d):
    rates = R.pass_rates(C.runs(spark, d))
    return rates.withColumn("overall_pass_rate", F.round("overall_pass_rate", 9))


@query("ingest_counters", "AGG18 FN17",
       """SELECT 'org/app' || CAST(user_id % 3 AS VARCHAR) AS repo,
  count(*) FILTER (event_id % 9 < 4) AS runs_with_logs,
  count(*) FILTER (event_id % 9 = 4) AS runs_skipped_expired,
  count(*) FILTER (event_id % 9 > 4) AS runs_skipped_error FROM events GROUP BY 1""")
def ingest_counters(spark, d):
    e = C.events(spark, d)
    step = F.col("event_id") % 9
    code = (
        F.when(step < 3, 200).when(step == 3, 202).when(step == 4, 410).when(step == 5, 404)
        .when(step == 6, 429).when(step == 7, 503).otherwise(302)
    )
    outcomes = e.select(
        F.concat(F.lit("org/app"), (F.col("user_id") % 3).cast("string")).alias("repo"),
        T.fetch_outcome(code).alias("outcome"),
    )
    return R.ingest_counters(outcomes)


@query("dataset_verification", "AGG19",
       sql_with("""SELECT r.repo, r.run_files, a.archives, a.corrupt_archives,
  r.failed_runs,
  least(a.archives, r.failed_runs) AS effective_sample, r.repo <> 'org/app2' AS complete
FROM (SELECT repo, count(*) AS run_files, count(*) FILTER (conclusion = 'failure') AS failed_runs
      FROM runs GROUP BY repo) r
JOIN (SELECT repo, count(*) AS archives, count(*) FILTER (status <> 'ok') AS corrupt_archives
      FROM archives GROUP BY repo) a USING (repo)""",
                archives=ARCHIVES_SQL))
def dataset_verification(spark, d):
    runs = C.runs(spark, d)
    ledger = runs.select("repo").distinct().withColumn(
        "status", F.when(F.col("repo") == "org/app2", "in_progress").otherwise("complete")
    )
    return R.verify_dataset(runs, archives_of(runs), ledger)


@query("unreadable_archives", "AGG19",
       sql_with("SELECT repo, archive, status FROM archives WHERE status <> 'ok'",
                archives=ARCHIVES_SQL))
def unreadable_archives(spark, d):
    return R.unreadable_archives(archives_of(C.runs(spark, d)))


@query("runs_without_test_output", "DOC10",
       sql_with("""SELECT repo, run_id FROM runs WHERE conclusion = 'failure' AND (repo, run_id)
NOT IN (SELECT (repo, run_id) FROM results WHERE run_id % 4 <> 1)"""))
def runs_without_test_output(spark, d):
    found = C.results(spark, d).filter(F.col("run_id") % 4 != 1)
    return _id(R.without_test_output(C.runs(spark, d), found))


@query("runs_with_test_jobs", "DOC11",
       sql_with("SELECT repo, run_id FROM runs WHERE run_id % 3 = 0"))
def runs_with_test_jobs(spark, d):
    return _id(R.with_test_jobs(C.runs(spark, d)))


@query("results_with_run_fields", "JN5 SET1",
       sql_with("""SELECT s.result_ord, s.repo, s.run_id, r.conclusion, r.timestamp AS run_time
FROM results s JOIN runs r USING (repo, run_id)"""))
def results_with_run_fields(spark, d):
    results = C.results(spark, d).select("result_ord", "repo", "run_id")
    runs = C.runs(spark, d).withColumnRenamed("timestamp", "run_time")
    return R.results_with_runs(results, runs, ["conclusion", "run_time"])
