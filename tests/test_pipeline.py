"""Runs, sources, sinks, streaming and the whole analysis on small data."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from testpulse import analyze
from testpulse.operators import compare as M
from testpulse.operators import report as P
from testpulse.operators import runs as R
from testpulse.operators import stats as S
from testpulse.session import new_folder
from testpulse.sources import archives as A
from testpulse.sources import sinks
from testpulse.sources import tables as T
from testpulse.streaming import ingest as I


def document(spark, folder):
    """The text of a written report: its files in name order."""
    files = spark.read.text(folder, wholetext=True).select("_metadata.file_path", "value")
    return "".join(r.value for r in files.orderBy("file_path").collect())


FAIL_LOG = "t.py::test_a FAILED\nt.py::test_b PASSED\n_____ test_a _____\nE   assert 1 == 2\nin 0.5s"


@pytest.fixture(scope="module")
def history(make_runs, make_lines):
    """Ten runs of two workflows: seven failed, two of them without logs; a clean repo."""
    runs = make_runs(
        [("org/app", 1000 + i, "success" if i in (0, 4, 8) else "failure",
          "Lint" if i % 4 == 0 else "CI") for i in range(10)]
        + [("org/clean", 1, "success"), ("org/clean", 2, "success", "Lint")])
    lines = make_lines({(1000 + i, "job.txt"): FAIL_LOG for i in range(10) if i not in (6, 9)})
    return runs, lines


@pytest.fixture(scope="module")
def analysis(spark, history):
    runs, lines = history
    archives = lines.select("repo", "run_id").distinct().withColumn("status", F.lit("ok"))
    return analyze(runs, lines=lines, archives=archives, min_sample=3)


def test_analysis(analysis):
    stats = {r.test_name: r for r in analysis.stats.collect()}
    assert set(stats) == {"t.py::test_a", "t.py::test_b"}
    a = stats["t.py::test_a"]
    assert (a.total_executions, a.total_failures, a.final_category) == (5, 5, "REAL_BUG")
    assert stats["t.py::test_b"].final_category == "FLAKY"  # never failed, enough executions
    quality = {r.repo: r for r in analysis.quality.collect()}["org/app"]
    assert (quality.runs_fetched, quality.runs_with_failures, quality.runs_with_logs,
            quality.runs_skipped_expired, quality.runs_skipped_error) == (10, 7, 5, 2, 0)
    assert quality.workflows_analyzed == ["CI", "Lint"]
    total = {r.repo: r for r in analysis.summary.collect()}
    assert total["org/app"].overall_pass_rate == pytest.approx(0.3)
    assert total["org/clean"].overall_pass_rate == 1.0
    assert (total["org/app"].real_bug_count, total["org/app"].total_failures) == (1, 5)
    assert analysis.classifications().count() == 5


def test_scope_filters_and_limit(history):
    runs, lines = history
    every = analyze(runs, lines=lines, scope="all_runs")
    assert {r.total_executions for r in every.stats.collect()} == {8}
    lint = analyze(runs, results=every.results, workflow="Lint", scope="all_runs")
    assert {r.total_executions for r in lint.stats.collect()} == {3}
    later = analyze(runs, results=every.results, since="2024-02-11T23:00:00", scope="all_runs")
    assert {r.total_executions for r in later.stats.collect()} == {2}  # runs 1007 and 1008
    part = analyze(runs, results=every.results, offset=0, batch_size=3, scope="all_runs")
    assert {r.total_executions for r in part.stats.collect()} == {3}
    with pytest.raises(ValueError):
        analyze(runs, lines=lines, scope="some")
    with pytest.raises(ValueError):
        analyze(runs)


def test_scorer_in_the_analysis(history):
    runs, lines = history

    def scorer(df):
        return df.select("repo", "test_name", "run_id", "provider", "model",
                         F.lit("length").alias("finish_reason"), F.lit("x").alias("content"),
                         F.lit(None).cast("string").alias("call_error"))

    done = analyze(runs, lines=lines, forced=True, scorer=scorer, provider="prov", model="m")
    total = {r.repo: r for r in done.summary.collect()}["org/app"]
    assert (total.llm_call_count, total.llm_truncated_count) == (1, 1)
    lines_ = [r.line for r in P.in_order(done.documents("now")["table"]).collect()]
    assert any("LLM calls: 1 (degraded: 1 — truncated 1, parse-error 0, fallback 0)" in x
               for x in lines_)


def test_report_documents(spark, analysis):
    folder = new_folder(spark, "reports")
    sinks.write_reports(analysis.documents("2024-02-01T00:00:00+00:00"), folder, "no-llm", "b")
    base = "report={}/provider=no-llm/batch=b/repo=org%2F{}"
    table = document(spark, f"{folder}/{base.format('txt', 'app')}").split("\n")
    assert table[0] == "=== CI Health Report: org_app ===" or table[0].startswith("===")
    body = "\n".join(table)
    assert "  Pass rate: 30.0%" in body and "LLM calls" not in body
    assert "  Real Bugs:\n    t.py::test_a — 100.0% flake rate, 1 sig(s), last: " in body
    assert body.index("Summary:") < body.index("Flaky Tests:") < body.index("Real Bugs:")
    assert body.index("Real Bugs:") < body.index("Data Quality:")
    clean = document(spark, f"{folder}/{base.format('txt', 'clean')}")
    assert "No failures in 2 runs across 2 workflows. CI health: clean." in clean
    assert "Summary" not in clean
    markdown = document(spark, f"{folder}/{base.format('md', 'app')}")
    assert "| Pass rate | 30.0% |" in markdown and "## Real Bugs" in markdown
    assert "## Infra Issues" not in markdown and "| Skipped (expired) | 2 |" in markdown
    report = json.loads(document(spark, f"{folder}/{base.format('json', 'app')}"))
    assert report["summary"]["real_bug_count"] == 1
    bug = report["real_bugs"][0]
    assert bug["error_signatures"][0]["count"] == 5 and bug["classifications"][0]["count"] == 5
    assert report["flaky_tests"][0]["error_signatures"] == [] and report["infra_issues"] == []
    empty = json.loads(document(spark, f"{folder}/{base.format('json', 'clean')}"))
    assert empty["flaky_tests"] == [] and empty["summary"]["total_failures"] == 0


def test_json_lists_many_tests_and_signatures(spark, make_results, make_runs):
    rows = [(f"t{i}", "FAILED", f"kind {chr(97 + j)}", i) for i in range(4) for j in range(3)]
    runs = make_runs([("org/app", i, "failure") for i in range(4)])
    done = analyze(runs, results=make_results(rows), min_sample=1)
    text = "".join(r.line for r in P.in_order(done.documents("now")["json"]).collect())
    report = json.loads(text)
    tests = report["flaky_tests"]
    assert [t["test_name"] for t in tests] == ["t0", "t1", "t2", "t3"]
    assert [len(t["error_signatures"]) for t in tests] == [3] * 4


def test_routes_and_clean_message(spark, make_runs):
    repos = spark.createDataFrame([("a",), ("b",), ("c",)], "repo string")
    runs = make_runs([("a", 1, "failure"), ("b", 1, "success"), ("b", 2, "cancelled")])
    got = {r.repo: r.route for r in R.routes(repos, runs).collect()}
    assert got == {"a": "has_failures", "b": "no_failures", "c": "error"}


def test_run_json_defaults(spark, tmp_path):
    folder = tmp_path / "org_app" / "runs"
    folder.mkdir(parents=True)
    full = {"run_id": 29372617902, "workflow_name": "CI", "status": "completed",
            "conclusion": "failure", "timestamp": "2026-07-14T22:19:41+00:00", "html_url": "u",
            "jobs": [{"job_id": 1, "name": "test", "conclusion": "failure", "logs_url": ""}]}
    (folder / "29372617902.json").write_text(json.dumps(full, indent=2))
    (folder / "5.json").write_text(json.dumps({"run_id": 5, "workflow_name": "", "status": "x",
                                               "conclusion": None, "timestamp": None}))
    (folder / "6.json").write_text('{"run_id": 6, "workflow')
    rows = {r.run_id: r for r in T.read_runs(spark, str(tmp_path / "*" / "runs")).collect()}
    bad = T.unreadable_runs(spark, str(tmp_path / "*" / "runs")).collect()
    assert [(r.repo, r.file, r.documents) for r in bad] == [("org_app", "6.json", 1)]
    assert set(rows) == {29372617902, 5}
    assert rows[29372617902].repo == "org_app" and rows[29372617902].jobs[0].name == "test"
    assert rows[29372617902].timestamp.isoformat() == "2026-07-14T22:19:41"
    assert rows[5].jobs == [] and rows[5].conclusion == "" and rows[5].html_url == ""
    assert rows[5].timestamp is not None


def test_archives(spark, tmp_path):
    folder = tmp_path / "org_app" / "logs"
    folder.mkdir(parents=True)

    def write(run, entries):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as archive:
            for name, text in entries:
                archive.writestr(name, text)
        (folder / f"{run}.zip").write_bytes(buffer.getvalue())

    with pytest.warns(UserWarning):
        write(1, [("a.txt", "one\r\ntwo"), ("b.txt", b"bad \xff byte\n"), ("a.txt", "new\nlast")])
    write(2, [])
    (folder / "3.zip").write_bytes(b"no archive")
    write(4, [("a.txt", "some text\n" * 50)])
    raw = bytearray((folder / "4.zip").read_bytes())
    raw[60] ^= 1  # a byte of the file in it
    (folder / "4.zip").write_bytes(bytes(raw))
    scanned = A.scan_archives(spark, str(tmp_path / "*" / "logs"))
    states = {r.run_id: (r.status, r.n_entries) for r in A.archive_states(scanned).collect()}
    assert states == {1: ("ok", 3), 2: ("empty", 0), 3: ("corrupt", 0), 4: ("error", 0)}
    lines = A.archive_lines(scanned).orderBy("entry_ord", "line_no").collect()
    assert [(r.repo, r.filename, r.entry_ord, r.line_no, r.line) for r in lines] == [
        ("org_app", "a.txt", 0, 0, "new"), ("org_app", "a.txt", 0, 1, "last"),
        ("org_app", "b.txt", 1, 0, "bad � byte")]
    table = new_folder(spark, "lines")
    for _ in range(2):  # a conversion that is repeated counts once
        A.compact_logs(spark, str(tmp_path / "*" / "logs"), table)
    kept = A.compacted_lines(spark, table).orderBy("entry_ord", "line_no").collect()
    assert [(r.repo, r.filename, r.entry_ord, r.line_no, r.line) for r in kept] == [
        (r.repo, r.filename, r.entry_ord, r.line_no, r.line) for r in lines]
    files = {(r.run_id, r.filename): r.status for r in A.compacted_files(spark, table).collect()}
    assert files == {
        (1, None): "ok", (1, "a.txt"): "ok", (1, "b.txt"): "ok", (2, None): "empty",
        (3, None): "corrupt", (4, None): "ok", (4, "a.txt"): "error"}
    whole = A.zip_states(spark, str(tmp_path / "*" / "logs"), A.compacted_files(spark, table))
    assert {r.run_id: (r.status, r.n_entries) for r in whole.collect()} == states
    wanted = spark.createDataFrame([("org_app", 2), ("org_app", 4)], "repo string, run_id bigint")
    some = A.scan_archives(spark, str(tmp_path / "*" / "logs"), wanted)
    assert sorted(r.run_id for r in some.collect()) == [2, 4]


def test_archive_pieces_are_cut_at_line_ends(spark):
    text = "".join(f"{'x' * (i % 97)}\n" for i in range(60_000)) + "the last"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("a.txt", text)
    archives = spark.createDataFrame(
        [("r", 1, "1.zip", buffer.getvalue())],
        "repo string, run_id bigint, archive string, content binary")
    lines = A.archive_lines(archives).orderBy("line_no").collect()
    assert [r.line for r in lines] == text.split("\n")
    assert [r.line_no for r in lines] == list(range(60_001))


def test_plain_log_files(spark, tmp_path):
    folder = tmp_path / "org_app" / "logs" / "7"
    folder.mkdir(parents=True)
    text = "\n".join(f"line {i}" for i in range(5000))
    (folder / "job.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")  # many blocks of one file
    try:
        lines = T.read_lines(spark, str(tmp_path / "*" / "logs" / "*"))
        rows = lines.orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.line_no, r.line) for r in rows] == list(enumerate(text.split("\n")))
    assert (rows[0].repo, rows[0].run_id, rows[0].filename) == ("org_app", 7, "job.txt")


def test_ledger_json(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps(
        {"repo": "org/app", "status": "complete", "processed_run_ids": ["5", "6"],
         "offsets_downloaded": [[0, 100], [100, 200]]}, indent=2))
    ledger = T.read_ledger_json(spark, str(tmp_path))
    assert sorted(r.run_id for r in T.ledger_runs(ledger).collect()) == [5, 6]
    assert sorted((r.range_start, r.range_end) for r in T.ledger_ranges(ledger).collect()) == [
        (0, 100), (100, 200)]


def test_verdict_versions(spark):
    def rows(*items):
        return spark.createDataFrame(
            [("p", "m", "r", t, 1, c, "e", 0.5, by) for t, c, by in items],
            "provider string, model string, repo string, test_name string, run_id bigint, "
            "category string, evidence string, confidence double, classified_by string")

    path = new_folder(spark, "cache")
    sinks.append_verdicts(rows(("a", "INFRA", "llm:p:m"), ("b", "FLAKY", "llm-fallback:p:m")), path, 0)
    for _ in range(2):  # writing a version again changes nothing
        sinks.append_verdicts(rows(("a", "REAL_BUG", "llm:p:m")), path, 1)
    got = [(r.test_name, r.category) for r in sinks.read_verdicts(spark, path).collect()]
    assert got == [("a", "REAL_BUG")]
    target = new_folder(spark, "cache")
    sinks.compact_verdicts(spark, path, target, 9)
    assert [r.version for r in sinks.read_versions(spark, target).collect()] == [9]


def test_stream_restarts_count_once(spark, make_results):
    results = make_results([("t", "FAILED", f"m{i % 2}", i) for i in range(6)])
    source, table, checkpoint = (new_folder(spark, n) for n in ("in", "out", "cp"))
    results.filter("run_id < 3").coalesce(1).write.parquet(source)

    def run():
        stream = spark.readStream.schema(results.schema).parquet(source)
        I.accumulate_stats(stream, table, checkpoint).awaitTermination()

    run()
    run()  # nothing new
    results.filter("run_id >= 3").coalesce(1).write.mode("append").parquet(source)
    run()
    got = I.merged_counts(spark, table).first()
    assert (got.total_executions, got.total_failures, got.flake_rate) == (6, 6, 100.0)
    merged = {r.signature_hash: r["count"] for r in I.merged_signatures(spark, table).collect()}
    assert merged == {r.signature_hash: r["count"] for r in S.signatures(results).collect()}

    def totals():
        counts = [tuple(r) for r in I.merged_counts(spark, table).collect()]
        return counts, sorted(map(tuple, I.merged_signatures(spark, table).collect()))

    before = totals()
    I.compact(spark, table)
    I.compact(spark, table)  # nothing to add up
    assert totals() == before
    for i in range(3):
        more = make_results([("t", "FAILED", "m0", 10 + i)])
        more.coalesce(1).write.mode("append").parquet(source)
        run()
    assert I.merged_counts(spark, table).first().total_executions == 9
    before = totals()
    I.compact(spark, table)
    assert totals() == before


def test_ingest_keeps_the_least_record_of_a_run(spark, make_runs):
    twice = make_runs([("a", 1, "success", "B"), ("a", 1, "success", "A"), ("a", 2, "failure", "C")])
    source, table, checkpoint = (new_folder(spark, n) for n in ("in", "out", "cp"))
    twice.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(twice.schema).parquet(source)
    I.ingest_runs(stream, table, checkpoint).awaitTermination()
    got = {(r.run_id, r.workflow_name) for r in spark.read.parquet(table).collect()}
    assert got == {(1, "A"), (2, "C")}


def test_stream_update_mode_and_dedup(spark, make_results, make_runs):
    results = make_results([("t", "FAILED", "m", i) for i in range(4)])
    source = new_folder(spark, "in")
    results.write.parquet(source)
    stream = spark.readStream.schema(results.schema).parquet(source)
    query = (I.running_counts(stream).writeStream.format("memory").queryName("counts")
             .outputMode("complete").trigger(availableNow=True).start())
    query.awaitTermination()
    assert spark.table("counts").first().total_failures == 4
    runs = make_runs([("a", 1, "failure"), ("a", 1, "failure"), ("a", 2, "success")])
    runs = runs.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    source = new_folder(spark, "in")
    runs.write.parquet(source)
    stream = spark.readStream.schema(runs.schema).parquet(source)
    query = (I.first_seen_runs(stream).writeStream.format("memory").queryName("seen")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(r.run_id for r in spark.table("seen").collect()) == [1, 2]


def test_validation_sample_falls_back_to_flaky(spark):
    rows = [("r", f"f{i}", "FLAKY", float(i)) for i in range(20)] + [("r", "b", "REAL_BUG", 9.0)]
    stats = spark.createDataFrame(rows, "repo string, test_name string, final_category string, "
                                        "flake_rate double")
    got = M.validation_sample(stats).collect()
    assert len(got) == 10
    names = {r.test_name for r in got}
    assert {"b", "f0", "f19"} <= names  # the bug, the lowest and the highest rate


def test_since_is_utc_for_both_kinds_of_time(spark, make_runs):
    runs = make_runs([("a", i, "failure") for i in range(10)])  # run i starts at hour i
    zoned = runs.withColumn("timestamp", F.to_timestamp(
        F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))))
    for start in ("2024-01-01T06:00:00", "2024-01-01T08:00:00+02:00"):
        for table in (runs, zoned):
            assert sorted(r.run_id for r in R.since(table, start).collect()) == [6, 7, 8, 9]
    plan = R.since(runs, "2024-01-01")._jdf.queryExecution().optimizedPlan().toString()
    assert "timestamp" in plan and R.since(runs, None) is runs


def test_slices_and_newest_beyond_the_top_k(spark, make_runs):
    runs = make_runs([("a", 100 + i, "success") for i in range(30)] + [("b", 9, "success")])
    part = R.run_slice(runs, 5, 10).filter("repo = 'a'").collect()
    assert sorted(r.run_id for r in part) == list(range(105, 115))
    assert R.run_slice(runs, 25).count() == 5
    small = {r.run_id: r.row_no for r in R.newest_runs(runs, 3).filter("repo = 'a'").collect()}
    assert small == {129: 1, 128: 2, 127: 3}
    large = {r.run_id: r.row_no for r in R.newest_runs(runs, 2000).filter("repo = 'a'").collect()}
    assert large == {129 - i: i + 1 for i in range(30)}


def test_runs_without_time_or_repo_are_numbered_last_and_not_lost(spark, make_runs):
    runs = make_runs([("a", 1, "success"), ("a", 2, "success"), (None, 3, "success")])
    runs = runs.withColumn("timestamp", F.when(F.col("run_id") != 1, F.col("timestamp")))
    for n in (1000, 1001):
        got = {(r.repo, r.run_id, r.row_no) for r in R.newest_runs(runs, n).collect()}
        assert got == {("a", 2, 1), ("a", 1, 2), (None, 3, 1)}
