"""Totals and reports."""

from pyspark.sql import functions as F

from testpulse.catalog.classification import verdicts_of
from testpulse.catalog.registry import query, sql_percent, sql_with
from testpulse.catalog.runs import _QUALITY, ARCHIVES_SQL, archives_of
from testpulse.functions import text as T
from testpulse.operators import classify as K
from testpulse.operators import report as P
from testpulse.operators import runs as R
from testpulse.operators import scoring as S
from testpulse.plans import ci_tables as C
from testpulse.session import stage

GENERATED = "2024-02-01T00:00:00+00:00"

_SUMMARY = """SELECT r.repo, r.total_runs, t.total_failures, t.total_tests_analyzed, t.flaky_count,
  t.real_bug_count, t.infra_count, t.insufficient_data_count, r.overall_pass_rate,
  t.avg_flake_rate, 0::BIGINT AS llm_call_count, 0::BIGINT AS llm_truncated_count,
  0::BIGINT AS llm_parse_error_count, 0::BIGINT AS llm_fallback_count
FROM (SELECT repo, count(*) AS total_runs,
        avg(CASE WHEN conclusion = 'success' THEN 1.0 ELSE 0.0 END) AS overall_pass_rate
      FROM runs GROUP BY repo) r
JOIN (SELECT repo, CAST(sum(total_failures) AS BIGINT) AS total_failures,
        count(*) AS total_tests_analyzed,
        count(*) FILTER (final_category = 'FLAKY') AS flaky_count,
        count(*) FILTER (final_category = 'REAL_BUG') AS real_bug_count,
        count(*) FILTER (final_category = 'INFRA') AS infra_count,
        count(*) FILTER (final_category = 'INSUFFICIENT_DATA') AS insufficient_data_count,
        coalesce(avg(flake_rate) FILTER (final_category = 'FLAKY'), 0.0) AS avg_flake_rate
      FROM final GROUP BY repo) t USING (repo)"""


def tables_of(spark, d):
    """Signatures, categorized statistics, verdicts, quality and totals."""
    _, sigs, stats, verdicts = verdicts_of(spark, d)
    verdicts = stage(verdicts, "verdicts")
    final = stage(K.with_verdict_category(stats, verdicts), "final")
    runs = C.runs(spark, d)
    quality = stage(R.data_quality(runs, archives_of(runs)), "quality")
    totals = stage(P.summary(runs, final, S.outcome_audit(verdicts)), "totals")
    return sigs, final, verdicts, quality, totals


@query("report_summary", "AGG11 AGG12 AGG13 AGG14",
       sql_with(_SUMMARY.replace("r.overall_pass_rate,", "round(r.overall_pass_rate, 9) AS overall_pass_rate,")
                .replace("t.avg_flake_rate,", "round(t.avg_flake_rate, 9) AS avg_flake_rate,")))
def report_summary(spark, d):
    *_, totals = tables_of(spark, d)
    return totals.withColumns({
        "overall_pass_rate": F.round("overall_pass_rate", 9),
        "avg_flake_rate": F.round("avg_flake_rate", 9),
    })


@query("clean_repos", "AGG20",
       """SELECT 'org/app' || CAST(user_id AS VARCHAR) AS repo, count(DISTINCT event_id // 20)
  AS total_runs, 'No failures in ' || count(DISTINCT event_id // 20) || ' runs across '
  || count(DISTINCT event_id // 20 % 3) || ' workflow' || CASE WHEN
  count(DISTINCT event_id // 20 % 3) <> 1 THEN 's' ELSE '' END || '. CI health: clean.' AS message
FROM events WHERE user_id % 5 = 4 OR (user_id % 5 IN (1, 2) AND event_type = 'view') GROUP BY user_id""")
def clean_repos(spark, d):
    """One repo per user whose tests never fail."""
    e = C.events(spark, d).filter(
        (F.col("user_id") % 5 == 4)
        | ((F.col("user_id") % 5).isin(1, 2) & (F.col("event_type") == "view"))
    )
    run = F.floor(F.col("event_id") / 20)
    rows = e.select(
        F.concat(F.lit("org/app"), F.col("user_id").cast("string")).alias("repo"),
        run.alias("run_id"), F.col("event_id").alias("result_ord"),
        F.lit("t").alias("test_name"), F.lit("PASSED").alias("status"),
        F.lit("").alias("error_message"), F.lit("").alias("stack_trace"),
        F.concat(F.lit("w"), (run % 3).cast("string")).alias("workflow_name"),
        F.col("ts").alias("timestamp"),
    )
    from testpulse.operators import stats as ST

    runs = rows.groupBy("repo", "run_id").agg(
        F.min("workflow_name").alias("workflow_name"), F.min("timestamp").alias("timestamp")
    ).withColumn("conclusion", F.lit("success"))
    stats = ST.test_stats(rows)
    final = K.with_verdict_category(stats, K.rule_verdicts(stats))
    quality = R.data_quality(runs, runs.withColumn("status", F.lit("ok")))
    return P.clean_repos(P.summary(runs, final), quality).select("repo", "total_runs", "message")


@query("batch_summary", "SNK6 FN18",
       sql_with("""SELECT s.repo, 'no-llm' AS provider, 'N/A' AS model, 'batch-0100-0600' AS batch,
  runs_with_failures, total_runs AS runs_analyzed, flaky_count, real_bug_count, infra_count,
  insufficient_data_count, 'runs/' || replace(s.repo, '/', '_') || '/no-llm/batch-0100-0600'
  AS output_dir FROM s JOIN q USING (repo)""", archives=ARCHIVES_SQL, s=_SUMMARY, q=_QUALITY))
def batch_summary(spark, d):
    *_, quality, totals = tables_of(spark, d)
    rows = P.batch_summary(totals, quality, offset=100, size=500)
    return rows.select(
        "repo", "provider", "model", "batch", "runs_with_failures", "runs_analyzed",
        "flaky_count", "real_bug_count", "infra_count", "insufficient_data_count", "output_dir",
    )


@query("batch_labels", "FN18",
       """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN printf('batch-%04d-all', event_id)
  ELSE printf('batch-%04d-%04d', event_id, event_id + user_id) END AS label FROM events""")
def batch_labels(spark, d):
    size = F.when(F.col("event_id") % 4 != 0, F.col("user_id"))
    return C.events(spark, d).select(
        "event_id", T.batch_label(F.col("event_id"), size).alias("label")
    )


_TABLE = f"""
SELECT repo, 0 AS section, unnest(['=== CI Health Report: ' || repo || ' ===',
  'Generated: {GENERATED}', '', 'Summary:', '  Total runs: ' || total_runs,
  '  Total failures: ' || total_failures, '  Tests analyzed: ' || total_tests_analyzed,
  '  Flaky: ' || flaky_count || ' | Real bugs: ' || real_bug_count || ' | Infra: ' || infra_count
    || ' | Insufficient data: ' || insufficient_data_count,
  '  Pass rate: ' || {sql_percent('overall_pass_rate', 1)}, '']) AS line FROM s
UNION ALL SELECT repo, 2, CASE WHEN flaky_count > 0 THEN '  Flaky Tests:' ELSE '' END FROM s
UNION ALL SELECT repo, 4, CASE WHEN real_bug_count > 0 THEN '  Real Bugs:' ELSE '' END FROM s
UNION ALL SELECT repo, 6, CASE WHEN infra_count > 0 THEN '  Infra Issues:' ELSE '' END FROM s
UNION ALL SELECT repo, 8, CASE WHEN insufficient_data_count > 0 THEN '  Insufficient Data:'
  ELSE '' END FROM s
UNION ALL SELECT repo, CASE final_category WHEN 'FLAKY' THEN 3 WHEN 'REAL_BUG' THEN 5
  WHEN 'INFRA' THEN 7 ELSE 9 END, '    ' || test_name || ' — ' || printf('%.1f', flake_rate)
  || '% flake rate, ' || n_signatures || ' sig(s), last: ' || strftime(last_seen_run, '%Y-%m-%d')
  FROM final
UNION ALL SELECT repo, 10, unnest(['Data Quality:', '  Runs requested: ' || runs_requested,
  '  Runs fetched: ' || runs_fetched, '  Effective sample: ' || effective_sample,
  '  Skipped (expired): ' || runs_skipped_expired, '  Skipped (error): ' || runs_skipped_error])
  FROM q"""


@query("table_report", "SNK4 FN19 TOP5",
       sql_with(_TABLE, archives=ARCHIVES_SQL, s=_SUMMARY, q=_QUALITY))
def table_report(spark, d):
    _, final, _, quality, totals = tables_of(spark, d)
    lines = P.table_lines(P.report_frame(totals, quality), final, GENERATED)
    return P.in_order(lines).select("repo", "section", "line")


_MARKDOWN = f"""
SELECT repo, 0 AS section, unnest(['# CI Health Report: ' || repo, '',
  '**Generated:** {GENERATED}', '', '## Summary', '| Metric | Value |', '|---|---|',
  '| Total runs | ' || total_runs || ' |', '| Total failures | ' || total_failures || ' |',
  '| Tests analyzed | ' || total_tests_analyzed || ' |', '| Flaky | ' || flaky_count || ' |',
  '| Real bugs | ' || real_bug_count || ' |', '| Infra | ' || infra_count || ' |',
  '| Insufficient data | ' || insufficient_data_count || ' |',
  '| Pass rate | ' || {sql_percent('overall_pass_rate', 1)} || ' |', '']) AS line FROM s
UNION ALL SELECT repo, section, unnest(CASE WHEN n > 0 THEN ['## ' || title, '',
  '| Test | Flake Rate | Signatures | Dominant Error | Last Seen |', '|---|---|---|---|---|']
  ELSE [''] END) FROM (
  SELECT repo, 2 AS section, flaky_count AS n, 'Flaky Tests' AS title FROM s
  UNION ALL SELECT repo, 4, real_bug_count, 'Real Bugs' FROM s
  UNION ALL SELECT repo, 6, infra_count, 'Infra Issues' FROM s
  UNION ALL SELECT repo, 8, insufficient_data_count, 'Insufficient Data' FROM s) t
UNION ALL SELECT repo, CASE final_category WHEN 'FLAKY' THEN 3 WHEN 'REAL_BUG' THEN 5
  WHEN 'INFRA' THEN 7 ELSE 9 END, '| ' || test_name || ' | ' || printf('%.1f', flake_rate)
  || '% | ' || n_signatures || ' | ' || coalesce(dominant_signature, '—') || ' | '
  || strftime(last_seen_run, '%Y-%m-%d') || ' |' FROM final
UNION ALL SELECT repo, 10, unnest(['', '## Data Quality', '| Metric | Value |', '|---|---|',
  '| Runs requested | ' || runs_requested || ' |', '| Runs fetched | ' || runs_fetched || ' |',
  '| Runs with logs | ' || runs_with_logs || ' |',
  '| Effective sample | ' || effective_sample || ' |',
  '| Skipped (expired) | ' || runs_skipped_expired || ' |',
  '| Skipped (error) | ' || runs_skipped_error || ' |']) FROM q"""


@query("markdown_report", "SNK5 FN19",
       sql_with(_MARKDOWN, archives=ARCHIVES_SQL, s=_SUMMARY, q=_QUALITY))
def markdown_report(spark, d):
    _, final, _, quality, totals = tables_of(spark, d)
    lines = P.markdown_lines(P.report_frame(totals, quality), final, GENERATED)
    return P.in_order(lines).select("repo", "section", "line")


@query("json_report", "SNK3 FN20",
       sql_with("""SELECT repo, CASE final_category WHEN 'FLAKY' THEN 3 WHEN 'REAL_BUG' THEN 5
    WHEN 'INFRA' THEN 7 ELSE 9 END AS section, part, key FROM (
  SELECT repo, final_category, 0 AS part, test_name || ' ' || total_failures AS key FROM final
  UNION ALL SELECT g.repo, final_category, 1, signature_hash || ' ' || count || ' ' || sample_message
    FROM sigs g JOIN final USING (repo, test_name)
  UNION ALL SELECT f.repo, f.final_category, 2, concat_ws(' ', dominant_signature, f.final_category,
    v.evidence, n) FROM final f LEFT JOIN (SELECT repo, test_name, evidence, total_failures AS n
      FROM verdicts) v USING (repo, test_name)) t"""))
def json_report(spark, d):
    """The test and signature lines of the JSON report, each parsed again."""
    sigs, final, verdicts, quality, totals = tables_of(spark, d)
    lines = P.json_lines(P.report_frame(totals, quality), final, sigs, verdicts, GENERATED)
    bare = F.regexp_replace("line", "^,", "")
    whole = (
        F.when(F.col("part") == 0, F.concat(bare, F.lit("]}")))
        .when(F.col("part") == 2, F.concat(F.lit('{"error_signatures":['), "line"))
        .otherwise(bare)
    )
    kind = ("struct<test_name:string,total_failures:bigint,signature_hash:string,count:bigint,"
            "sample_message:string,dominant_signature:string,final_category:string,"
            "classifications:array<struct<evidence:string,count:bigint>>>")
    verdict = F.try_element_at("r.classifications", F.lit(1))
    key = F.concat_ws(
        " ", "r.test_name", "r.total_failures", "r.signature_hash", "r.count",
        "r.sample_message", "r.dominant_signature", "r.final_category",
        verdict["evidence"], verdict["count"],
    )
    return (
        lines.filter(F.col("place").isNotNull())
        .withColumn("r", F.from_json(whole, kind))
        .select("repo", "section", "part", key.alias("key"))
    )


@query("report_files", "SNK9 SNK4",
       sql_with(f"SELECT repo, line FROM ({_TABLE}) t",
                archives=ARCHIVES_SQL, s=_SUMMARY, q=_QUALITY))
def report_files(spark, d):
    """All three formats written; the table report is read back from its files."""
    from testpulse.session import new_folder
    from testpulse.sources import sinks

    sigs, final, verdicts, quality, totals = tables_of(spark, d)
    frame = P.report_frame(totals, quality)
    documents = {
        "table": P.table_lines(frame, final, GENERATED),
        "markdown": P.markdown_lines(frame, final, GENERATED),
        "json": P.json_lines(frame, final, sigs, verdicts, GENERATED),
    }
    folder = new_folder(spark, "reports")
    sinks.write_reports(documents, folder, "no-llm", "batch-0000-all")
    written = spark.read.text(f"{folder}/report=txt/provider=no-llm/batch=batch-0000-all")
    return written.select("repo", F.col("value").alias("line"))


_FORMATS = f"""SELECT c.repo, real_bugs, flaky, infra, total_failures, table_lines, markdown_lines
FROM (SELECT repo, count(*) FILTER (final_category = 'REAL_BUG') AS real_bugs,
        count(*) FILTER (final_category = 'FLAKY') AS flaky,
        count(*) FILTER (final_category = 'INFRA') AS infra,
        CAST(sum(total_failures) AS BIGINT) AS total_failures FROM final GROUP BY repo) c
JOIN (SELECT repo, count(*) AS table_lines FROM ({_TABLE}) t GROUP BY repo) USING (repo)
JOIN (SELECT repo, count(*) AS markdown_lines FROM ({_MARKDOWN}) m GROUP BY repo) USING (repo)"""


@query("report_formats", "SNK9 SNK3 SNK5",
       sql_with(_FORMATS, archives=ARCHIVES_SQL, s=_SUMMARY, q=_QUALITY))
def report_formats(spark, d):
    """All three formats read back from their files; the JSON document is parsed as a whole."""
    from testpulse.session import new_folder
    from testpulse.sources import sinks

    sigs, final, verdicts, quality, totals = tables_of(spark, d)
    frame = P.report_frame(totals, quality)
    folder = new_folder(spark, "reports")
    sinks.write_reports({
        "table": P.table_lines(frame, final, GENERATED),
        "markdown": P.markdown_lines(frame, final, GENERATED),
        "json": P.json_lines(frame, final, sigs, verdicts, GENERATED),
    }, folder, "no-llm", "b")

    def lines(extension, name):
        read = spark.read.text(f"{folder}/report={extension}/provider=no-llm/batch=b")
        return read.groupBy("repo").agg(F.count(F.lit(1)).alias(name))

    files = spark.read.text(f"{folder}/report=json/provider=no-llm/batch=b", wholetext=True)
    part = F.struct(F.col("_metadata.file_path").alias("path"), "value")
    whole = files.groupBy("repo").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(part)), lambda p: p["value"]), "").alias("document"))
    test = "array<struct<test_name:string,final_category:string>>"
    kind = (f"struct<summary:struct<total_failures:bigint>,real_bugs:{test},flaky_tests:{test},"
            f"infra_issues:{test}>")
    report = whole.select("repo", F.from_json("document", kind, {"mode": "FAILFAST"}).alias("r"))
    return report.join(lines("txt", "table_lines"), "repo").join(lines("md", "markdown_lines"), "repo").select(
        "repo",
        F.size("r.real_bugs").cast("bigint").alias("real_bugs"),
        F.size("r.flaky_tests").cast("bigint").alias("flaky"),
        F.size("r.infra_issues").cast("bigint").alias("infra"),
        F.col("r.summary.total_failures").alias("total_failures"),
        "table_lines", "markdown_lines",
    )
