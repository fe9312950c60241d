"""Writers.  Tables that grow are written in named batches, whose commit file comes last (see
:mod:`testpulse.sources.commits`): a batch that is written twice counts once, one that
was cut short not at all.  Reports and cache versions are folders replaced whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testpulse.operators import report
from testpulse.operators.classify import VERDICT
from testpulse.operators.scoring import CACHE_KEY, cacheable, latest_verdicts
from testpulse.sources import commits

EXTENSIONS = {"table": "txt", "json": "json", "markdown": "md"}


def write_runs(runs: DataFrame, path: str) -> None:
    """One record per run with its jobs, partitioned by repo."""
    runs.write.mode("append").partitionBy("repo").parquet(path)


def write_ledger(entries: DataFrame, path: str, batch: str | None = None) -> None:
    """Processed runs and offset ranges of a batch."""
    commits.write_batch(entries, path, batch, ("repo",))


def read_ledger(spark: SparkSession, path: str, schema: str = "repo string, run_id bigint") -> DataFrame:
    """The entries of all batches."""
    return commits.read_batches(spark, path, schema).drop("batch_name")


def write_report(lines: DataFrame, path: str, fmt: str, provider: str, batch: str) -> None:
    """A report per repo below ``path/report=<ext>/provider=…/batch=…/repo=…``.

    The folder is named by the repo itself, escaped by Spark, so two repos never share one.
    Lines are sorted across files: the files of a repo in name order are its
    document.  A small repo has one file.
    """
    folder = f"{path}/report={EXTENSIONS[fmt]}/provider={provider}/batch={batch}"
    # sorted by the folder name itself, so that the writer does not sort again
    (
        report.in_order(lines)
        .select("repo", F.col("line").alias("value"))
        .write.mode("overwrite")
        .partitionBy("repo")
        .text(folder)
    )


def write_reports(
    documents: dict[str, DataFrame], path: str, provider: str, batch: str, fmt: str = "all"
) -> None:
    """The chosen format, or all three."""
    chosen = list(EXTENSIONS) if fmt == "all" else [fmt]
    for name in chosen:
        write_report(documents[name], path, name, provider, batch)


def write_batch_summary(summary: DataFrame, path: str, batch: str | None = None) -> None:
    """The summary rows of a batch as JSON, below a folder per provider and batch label."""
    commits.write_batch(summary, path, batch, ("provider", "batch"), "json")


def read_batch_summaries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The summary rows of all batches."""
    return commits.read_batches(spark, path, schema, "json").drop("batch_name")


def append_verdicts(fresh: DataFrame, path: str, version: int) -> None:
    """Add verdicts to the cache under a version.  Failed calls are not kept.

    A version is one folder that is replaced whole, so writing it twice has the
    effect of writing it once; readers take the newest version of a key.
    """
    rows = cacheable(fresh).select(*CACHE_KEY, "run_id", *VERDICT)
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """All versions of all cached verdicts."""
    return spark.read.schema(
        "provider string, model string, repo string, test_name string, run_id bigint, "
        "category string, evidence string, confidence double, classified_by string, "
        "version bigint"
    ).parquet(path)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of each cached verdict."""
    return latest_verdicts(read_versions(spark, path))


def compact_verdicts(spark: SparkSession, path: str, target: str, version: int) -> None:
    """Write the newest verdicts as the only version of a new cache folder."""
    rows = read_verdicts(spark, path).select(*CACHE_KEY, "run_id", *VERDICT)
    rows.write.mode("overwrite").parquet(f"{target}/version={version}")


def append_call_log(calls: DataFrame, path: str, batch: str | None = None) -> None:
    """The calls of a batch."""
    commits.write_batch(calls, path, batch, ("provider",))


def read_call_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The calls of all batches."""
    return commits.read_batches(spark, path, schema).drop("batch_name")
