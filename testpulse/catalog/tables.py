"""Sources and sinks: tables are written to the shared folder and read back."""

from pyspark.sql import functions as F

from testpulse.catalog.registry import query, sql_with
from testpulse.catalog.runs import ledger_of
from testpulse.catalog.scoring import _CACHE, _LATEST, _PARSED, _cache
from testpulse.functions.text import repo_slug
from testpulse.operators import extract as E
from testpulse.operators import scoring as S
from testpulse.operators.spread import concat_in_order
from testpulse.plans import ci_tables as C
from testpulse.session import new_folder
from testpulse.sources import archives as A
from testpulse.sources import sinks
from testpulse.sources import tables as T
from testpulse.sources.ziplogs import read_archives


@query("run_metadata_scan", "SRC1 FLT5 FN21",
       sql_with("""SELECT repo, run_id, CASE WHEN run_id % 4 = 0 THEN html_url ELSE workflow_name END
  AS workflow_name, conclusion, date_trunc('millisecond', timestamp) AS started,
  CASE WHEN run_id % 6 = 0 THEN 0 WHEN run_id % 3 = 0 THEN 1 ELSE 2 END AS n_jobs FROM runs"""))
def run_metadata_scan(spark, d):
    """Runs as JSON, some without jobs or name; read back with the defaults."""
    runs = C.runs(spark, d).withColumns({
        "workflow_name": F.when(F.col("run_id") % 4 != 0, F.col("workflow_name")),
        "jobs": F.when(F.col("run_id") % 6 != 0, F.col("jobs")),
        "timestamp": F.concat(
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00")
        ),
    })
    folder = new_folder(spark, "runs")
    by_repo = runs.withColumn("folder", repo_slug(F.col("repo"))).drop("repo")
    by_repo.write.partitionBy("folder").json(folder)
    files = spark.read.schema(T.RUN_FIELDS).json(folder)
    back = T.with_defaults(files)
    started = F.to_utc_timestamp("timestamp", F.current_timezone()).cast("timestamp_ntz")
    return back.select(
        F.replace("folder", F.lit("_"), F.lit("/")).alias("repo"), "run_id", "workflow_name",
        "conclusion", started.alias("started"),
        F.size("jobs").alias("n_jobs"),
    )


@query("run_documents", "SRC1 FLT5",
       sql_with("""SELECT repo, run_id, CASE WHEN run_id % 9 = 4 THEN NULL ELSE workflow_name END AS workflow_name,
  CASE WHEN run_id % 9 <> 4 THEN CASE WHEN run_id % 3 = 0 THEN 1 ELSE 2 END END AS n_jobs,
  run_id % 9 <> 4 AS readable FROM runs"""))
def run_documents(spark, d):
    """One indented document per file, some cut short; both readers on the same files."""
    folder = new_folder(spark, "documents")
    runs = C.runs(spark, d).withColumn("timestamp", F.col("timestamp").cast("string"))
    record = F.to_json(F.struct(*[c for c in runs.columns if c != "repo"]), {"pretty": "true"})

    def written(batches):
        import os
        import re

        import pandas as pd

        for batch in batches:
            for row in batch.itertuples(index=False):
                place = f"{re.sub('^file:/+', '/', folder)}/{row.repo.replace('/', '_')}/runs"
                os.makedirs(place, exist_ok=True)
                text = row.record[: len(row.record) // 2] if row.run_id % 9 == 4 else row.record
                with open(f"{place}/{row.run_id}.json", "w") as file:
                    file.write(text)
            yield pd.DataFrame({"n": [len(batch)]})

    files = runs.select("repo", "run_id", record.alias("record"))
    files.mapInPandas(written, "n bigint").agg(F.sum("n")).collect()
    good = T.read_runs(spark, f"{folder}/*/runs").select(
        _repo(), "run_id", "workflow_name", F.size("jobs").alias("n_jobs"), F.lit(True).alias("readable")
    )
    bad = T.unreadable_runs(spark, f"{folder}/*/runs").select(
        _repo(), F.regexp_extract("file", r"(\d+)", 1).cast("bigint").alias("run_id"),
        F.lit(None).cast("string").alias("workflow_name"), F.lit(None).cast("int").alias("n_jobs"),
        F.lit(False).alias("readable"),
    )
    return good.unionByName(bad)


def _repo():
    return F.replace("repo", F.lit("_"), F.lit("/")).alias("repo")


def _archives(spark, d):
    """Files ``<repo>/logs/<run id>.zip`` with one zipped log each, as input for the reader: the
    test data holds no archives.  Some are cut short or have a wrong checksum.

    One Python function zips and writes row by row, so a task holds one batch of logs."""
    folder = new_folder(spark, "archives")

    def written(batches):
        import io
        import os
        import re
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                repo, run_id, filename, content = (column[i].as_py() for column in batch.columns)
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr(filename, content)
                raw = bytearray(buffer.getvalue())
                if run_id % 11 == 5:
                    raw[raw.index(b"PK\x01\x02") + 16] ^= 1
                place = f"{re.sub('^file:/+', '/', folder)}/{repo.replace('/', '_')}/logs"
                os.makedirs(place, exist_ok=True)
                with open(f"{place}/{run_id}.zip", "wb") as file:
                    file.write(raw[:30] if run_id % 11 == 3 else raw)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    logs = concat_in_order(C.log_lines(spark, d), E.LOG, "line_no", "line", "\n")
    rows = logs.select("repo", "run_id", "filename", F.col("line").alias("content"))
    rows.mapInArrow(written, "n bigint").agg(F.sum("n")).collect()
    return folder


@query("archive_states", "SRC3",
       sql_with("""SELECT DISTINCT repo, run_id, CASE WHEN run_id % 11 = 3 THEN 'corrupt'
  WHEN run_id % 11 = 5 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN run_id % 11 IN (3, 5) THEN 0 ELSE 1 END AS n_entries FROM log_lines"""))
def archive_states(spark, d):
    """Files found again; states from their directories and from what could not be read."""
    folder, table = _archives(spark, d), new_folder(spark, "compacted")
    A.compact_logs(spark, f"{folder}/*/logs", table)
    states = A.zip_states(spark, f"{folder}/*/logs", A.compacted_files(spark, table))
    return states.select(_repo(), "run_id", "status", "n_entries")


@query("archive_lines", "SRC2 SRC4 SRC3",
       sql_with("""SELECT repo, run_id, filename, row_number() OVER (PARTITION BY repo, run_id
  ORDER BY line_no) - 1 AS line_no, line FROM log_lines WHERE run_id % 11 NOT IN (3, 5)"""))
def archive_lines(spark, d):
    """Archives written to files, found again and read line by line; converting them twice
    changes nothing."""
    folder, table = _archives(spark, d), new_folder(spark, "compacted")
    for _ in range(2):
        A.compact_logs(spark, f"{folder}/*/logs", table)
    return A.compacted_lines(spark, table).select(_repo(), "run_id", "filename", "line_no", "line")


@query("archive_lines_of_runs", "SRC2 FLT6",
       sql_with("""SELECT repo, run_id, count(*) AS n_lines, max(length(line)) AS longest FROM log_lines
  WHERE repo = 'org/app1' AND run_id >= 1010 AND run_id % 11 NOT IN (3, 5) GROUP BY repo, run_id"""))
def archive_lines_of_runs(spark, d):
    """Conditions on repo and run decide which archives are opened at all."""
    read = read_archives(spark, f"{_archives(spark, d)}/*/logs")
    some = read.filter((F.col("repo") == "org_app1") & (F.col("run_id") >= 1010))
    return A.zipped_lines(some).groupBy(_repo(), "run_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max(F.length("line")).alias("longest")
    )


@query("archive_files", "SRC2 SRC3",
       sql_with("""SELECT repo, run_id, filename, CASE WHEN run_id % 11 = 5 THEN 'error' ELSE 'ok' END AS status,
  CAST(sum(strlen(line)) + count(*) - 1 AS BIGINT) AS n_bytes
FROM log_lines WHERE run_id % 11 <> 3 GROUP BY ALL"""))
def archive_files(spark, d):
    """Every file of a readable archive, also those that cannot be unpacked."""
    read = read_archives(spark, f"{_archives(spark, d)}/*/logs")
    files = read.filter("filename IS NOT NULL AND status IS NOT NULL")
    return files.select(_repo(), "run_id", "filename", "status", "n_bytes")


@query("verdict_cache_scan", "SRC5",
       sql_with("""SELECT provider, test_name, event_id AS version, category, confidence
FROM cache WHERE event_id % 10 > 1""", p=_PARSED, cache=_CACHE))
def verdict_cache_scan(spark, d):
    """A cache in JSON in which every fifth entry is broken or incomplete."""
    cache = _cache(spark, d).select("provider", "model", "repo", "version", "test_name",
                                    "run_id", "category", "evidence", "confidence",
                                    "classified_by")
    text = F.to_json(F.struct("*"))
    broken = (
        F.when(F.col("version") % 10 == 0, F.substring(text, 1, 40))
        .when(F.col("version") % 10 == 1, F.regexp_replace(text, '"evidence":"[^"]*",', ""))
        .otherwise(text)
    )
    folder = new_folder(spark, "cache")
    cache.select(broken.alias("value")).write.text(folder)
    return T.read_verdict_cache(spark, folder).select(
        "provider", "test_name", "version", "category", "confidence"
    )


@query("call_log_scan", "SRC6 SNK8",
       sql_with("""SELECT provider, test_name, call_error AS error, count(*) AS n,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM responses GROUP BY ALL"""))
def call_log_scan(spark, d):
    folder = new_folder(spark, "calls")
    S.call_log(C.responses(spark, d)).write.json(folder)
    return T.read_call_log(spark, folder).groupBy("provider", "test_name", "error").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_tokens").alias("total_tokens")
    )


@query("runs_table", "SNK1",
       sql_with("""SELECT repo, run_id, workflow_name, conclusion, timestamp,
  CASE WHEN run_id % 3 = 0 THEN 1 ELSE 2 END AS n_jobs FROM runs"""))
def runs_table(spark, d):
    folder = new_folder(spark, "runs")
    sinks.write_runs(C.runs(spark, d), folder)
    return spark.read.parquet(folder).select(
        "repo", "run_id", "workflow_name", "conclusion", "timestamp",
        F.size("jobs").alias("n_jobs"),
    )


@query("ledger_table", "SNK2 SET3 SET4",
       sql_with("""SELECT repo, run_id, count(*) AS n FROM (
  SELECT repo, run_id FROM runs WHERE run_id % 5 < 2
  UNION ALL SELECT repo, run_id FROM runs WHERE run_id % 5 = 3) t GROUP BY ALL"""))
def ledger_table(spark, d):
    """Two batches of processed runs in one ledger, each written twice.  (Which runs are in a
    batch is set-up: a run is processed in the first, in the second or not yet.)"""
    runs = C.runs(spark, d)
    folder = new_folder(spark, "ledger")
    for _ in range(2):
        sinks.write_ledger(ledger_of(runs), folder, "first")
        later = runs.filter(F.col("run_id") % 5 == 3).select("repo", "run_id")
        sinks.write_ledger(later, folder, "second")
    return sinks.read_ledger(spark, folder).groupBy("repo", "run_id").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("call_log_table", "SNK8 SRC6",
       sql_with("""SELECT provider, model AS model_requested, count(*) AS n,
  count(*) FILTER (event_id % 2 = 0) AS n_even, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens
FROM responses GROUP BY ALL"""))
def call_log_table(spark, d):
    """Two batches of calls, each written twice under its name."""
    folder = new_folder(spark, "calls")
    responses = C.responses(spark, d)
    calls = responses.select(
        "provider", F.col("model").alias("model_requested"), "event_id", "prompt_tokens"
    )
    for batch in ("a", "b", "b", "a"):
        part = calls.filter((F.col("event_id") % 3 == 0) == (batch == "a"))
        sinks.append_call_log(part, folder, batch)
    kept = sinks.read_call_logs(
        spark, folder, "provider string, model_requested string, event_id bigint, prompt_tokens bigint"
    )
    return kept.groupBy("provider", "model_requested").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_id") % 2 == 0).alias("n_even"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
    )


@query("batch_summary_table", "SNK6",
       sql_with("""SELECT 'no-llm' AS provider, 'batch-' || CAST(run_id % 4 AS VARCHAR) AS batch, repo,
  count(*) AS runs FROM runs GROUP BY ALL"""))
def batch_summary_table(spark, d):
    """A summary of every batch, all of them written twice."""
    folder = new_folder(spark, "summaries")
    runs = C.runs(spark, d).withColumn("part", F.col("run_id") % 4)
    for number in (0, 1, 2, 3, 2, 0, 3, 1):
        summary = runs.filter(F.col("part") == number).groupBy("repo").agg(F.count(F.lit(1)).alias("runs"))
        labelled = summary.select(
            F.lit("no-llm").alias("provider"), F.lit(f"batch-{number}").alias("batch"), "repo", "runs"
        )
        sinks.write_batch_summary(labelled, folder, f"no-llm/{number}")
    return sinks.read_batch_summaries(
        spark, folder, "provider string, batch string, repo string, runs bigint"
    )


@query("verdict_cache_table", "SNK7",
       sql_with("""SELECT provider, model, repo, test_name, category, confidence, classified_by
FROM latest""", p=_PARSED, cache=_CACHE, latest=_LATEST))
def verdict_cache_table(spark, d):
    """Three versions of the cache folder, then its newest rows."""
    parsed = S.parse_responses(C.responses(spark, d))
    last = parsed.agg(F.max("event_id")).scalar()
    third = F.floor(F.col("event_id") * 3 / (last + 1))
    folder = new_folder(spark, "verdicts")
    for version in range(3):
        rows = parsed.filter(third == version)
        payload = F.struct("event_id", "run_id", "category", "evidence", "confidence",
                           "classified_by")
        newest = (
            S.cacheable(rows).groupBy(*S.CACHE_KEY).agg(F.max(payload).alias("v"))
            .select(*S.CACHE_KEY, "v.*")
        )
        sinks.append_verdicts(newest, folder, version)
    return sinks.read_verdicts(spark, folder).select(
        "provider", "model", "repo", "test_name", "category", "confidence", "classified_by"
    )
