"""Schemas and readers of run metadata, verdict caches, call logs, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from testpulse.functions import text as T
from testpulse.operators.scoring import usable
from testpulse.operators.spread import number_rows
from testpulse.session import stage
from testpulse.sources.files import reachable, read_texts

JOB = "struct<job_id:bigint,name:string,conclusion:string,logs_url:string>"
RUN_FIELDS = (
    "run_id bigint, workflow_name string, status string, conclusion string, "
    f"timestamp timestamp, html_url string, jobs array<{JOB}>"
)
CACHE_FIELDS = (
    "provider string, model string, repo string, version bigint, test_name string, "
    "run_id bigint, category string, evidence string, confidence double, classified_by string"
)
CALL_FIELDS = (
    "call_number bigint, timestamp string, provider string, model_requested string, "
    "model_actual string, test_name string, latency_seconds double, prompt string, "
    "error string, finish_reason string, max_tokens int, prompt_tokens bigint, "
    "completion_tokens bigint, total_tokens bigint"
)
LEDGER_FIELDS = (
    "repo string, runs_requested bigint, runs_fetched bigint, runs_downloaded bigint, "
    "runs_skipped_expired bigint, runs_skipped_error bigint, runs_with_failures bigint, "
    "runs_with_logs bigint, status string, started_at string, completed_at string, "
    "last_run_id_processed bigint, processed_run_ids array<string>, "
    "offsets_downloaded array<array<bigint>>"
)


def with_defaults(runs: DataFrame) -> DataFrame:
    """Fill absent run fields: no jobs, no URL, no conclusion; no time is now."""
    empty = F.array().cast(f"array<{JOB}>")
    return runs.withColumns({
        "workflow_name": T.workflow_or_url(F.col("workflow_name"), F.col("html_url")),
        "conclusion": F.coalesce("conclusion", F.lit("")),
        "html_url": F.coalesce("html_url", F.lit("")),
        "jobs": F.coalesce("jobs", empty),
        "timestamp": F.coalesce("timestamp", F.current_timestamp()),
    })


def _parsed_files(spark: SparkSession, path: str) -> DataFrame:
    """(_at, fields, _unread) of each document in files that hold one, or a list of them; the files
    are listed and read in tasks."""
    fields = f"struct<{RUN_FIELDS}, _unread string>"
    files = read_texts(spark, path)
    broken = F.from_json(F.lit('{"_unread": "yes"}'), fields)

    def parsed(text: Column) -> Column:
        return F.coalesce(F.from_json(text, fields, {"columnNameOfCorruptRecord": "_unread"}), broken)

    def all_or_none(parts: Column) -> Column:
        documents = F.transform(F.filter(parts, lambda p: p.isNotNull()), parsed)
        bad = F.exists(parts, lambda p: p.isNull()) | F.exists(documents, lambda r: r["_unread"].isNotNull())
        return F.when(bad, F.transform(documents, lambda _: broken)).otherwise(documents)

    begins = F.substring(F.regexp_replace("text", r"^[\s\x{FEFF}]+", ""), 1, 1)
    several = F.coalesce(all_or_none(F.from_json("text", "array<string>")), F.array(broken))
    found = (
        F.when(F.col("text").isNull(), F.array(broken)).when(begins == "[", several)
        .when(begins != "", F.array(parsed(F.col("text"))))
    )
    return files.select(F.col("path").alias("_at"), F.inline(found))


def _run_documents(spark: SparkSession, path: str, one_per_file: bool) -> DataFrame:
    if one_per_file and reachable(path):
        read = _parsed_files(spark, path)
    else:
        reader = (
            spark.read.schema(RUN_FIELDS + ", _unread string")
            .option("multiLine", one_per_file)
            .option("columnNameOfCorruptRecord", "_unread")
        )
        read = reader.json(path).select(F.col("_metadata.file_path").alias("_at"), "*")
    repo = F.regexp_extract("_at", r"([^/]+)/runs/[^/]+$", 1)
    file = F.regexp_extract("_at", r"([^/]+)$", 1)
    whole = F.col("run_id").isNotNull() & F.col("_unread").isNull()
    documents = read.select(repo.alias("repo"), file.alias("_file"), "*", whole.alias("_whole"))
    return documents.drop("_at", "_unread")


def read_runs(spark: SparkSession, path: str, *, one_per_file: bool = True) -> DataFrame:
    """Run metadata from JSON; the repo is the folder above ``runs``.

    ``one_per_file`` reads indented documents, one per file (or one list of them).  Small files
    are slow to list and open, so compact them once with :func:`compact_runs`; they are listed
    and read in tasks (:mod:`testpulse.sources.files`), as the driver cannot hold millions.
    Documents without a readable run are in :func:`unreadable_runs`.
    """
    runs = _run_documents(spark, path, one_per_file).filter("_whole")
    return with_defaults(runs.drop("_file", "_whole"))


def unreadable_runs(spark: SparkSession, path: str, *, one_per_file: bool = True) -> DataFrame:
    """(repo, file, documents): what :func:`read_runs` leaves out."""
    bad = _run_documents(spark, path, one_per_file).filter("NOT _whole")
    return bad.groupBy("repo", F.col("_file").alias("file")).agg(
        F.count(F.lit(1)).alias("documents")
    )


def compact_runs(spark: SparkSession, source: str, target: str) -> None:
    """Rewrite one-file-per-run JSON as Parquet, partitioned by repo."""
    read_runs(spark, source).write.partitionBy("repo").mode("append").parquet(target)


def read_verdict_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached verdicts; an unreadable or incomplete entry is a miss."""
    reader = spark.read.schema(CACHE_FIELDS).option("mode", "PERMISSIVE")
    return usable(reader.json(path))


def read_call_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALL_FIELDS).option("mode", "PERMISSIVE").json(path)


def read_ledger_json(spark: SparkSession, path: str) -> DataFrame:
    """Ledgers that were kept as one JSON document per repo."""
    return spark.read.schema(LEDGER_FIELDS).option("multiLine", True).json(path)


def ledger_runs(ledgers: DataFrame) -> DataFrame:
    """One row per processed run of such ledgers."""
    return ledgers.select("repo", F.explode("processed_run_ids").alias("id")).select(
        "repo", F.col("id").cast("bigint").alias("run_id")
    )


def ledger_ranges(ledgers: DataFrame) -> DataFrame:
    """One row per offset range of such ledgers."""
    return ledgers.select("repo", F.explode("offsets_downloaded").alias("r")).select(
        "repo", F.col("r")[0].alias("range_start"), F.col("r")[1].alias("range_end")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Plain log files ``<repo>/logs/<run id>/<file>``, one row per line.

    Big files are read in blocks by several tasks.  Lines are numbered by file:
    within a block by position, across blocks by a running sum of block sizes.
    The positions are written down before they are used, as a second read could
    assign others.
    """
    at = F.col("_metadata.file_path")
    read = spark.read.text(path).select(
        F.regexp_extract(at, r"([^/]+)/logs/\d+/[^/]+$", 1).alias("repo"),
        F.regexp_extract(at, r"/logs/(\d+)/[^/]+$", 1).cast("bigint").alias("run_id"),
        F.regexp_extract(at, r"([^/]+)$", 1).alias("filename"),
        F.lit(0).alias("entry_ord"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"),
        F.col("value").alias("line"),
    )
    return number_rows(
        stage(read, "plain-lines"),
        ["repo", "run_id", "filename"],
        [F.col("position")],
        F.col("block"),
        name="line_no",
    ).select("repo", "run_id", "filename", "entry_ord", "line_no", "line")
