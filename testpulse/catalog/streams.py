"""Structured Streaming: files in, exactly-once tables out."""

from pyspark.sql import functions as F

from testpulse.catalog.registry import query, sql_with
from testpulse.catalog.scoring import stub_scorer
from testpulse.operators import stats as S
from testpulse.plans import ci_tables as C
from testpulse.session import new_folder, stage
from testpulse.sources import commits
from testpulse.streaming import ingest as I

PARTS = 4
#: The tables have some thousand keys.
BUCKETS = 8


def _in_parts(df, spark, name, by, run):
    """Call ``run(stream, checkpoint)`` twice on the table as files that arrive one after
    another: the stream is stopped when half of them are there, and started again."""
    folder, checkpoint = new_folder(spark, name), new_folder(spark, "checkpoint")
    cut = df.repartitionByRange(PARTS, by).withColumn("_part", F.spark_partition_id())
    cut = stage(cut, f"{name}-parts")
    for late in (False, True):
        half = cut.filter((F.col("_part") >= PARTS // 2) == late).drop("_part")
        half.coalesce(PARTS // 2).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        run(stream, checkpoint).awaitTermination()


@query("streamed_run_ingest", "STR1 JN6",
       sql_with("SELECT repo, run_id, workflow_name, conclusion, timestamp FROM runs"))
def streamed_run_ingest(spark, d):
    """Runs that arrive twice, in different files, and late ones are kept once."""
    runs = C.runs(spark, d).drop("jobs")
    again = runs.filter(F.col("run_id") % 2 == 0)
    late = F.when(F.col("run_id") % 5 == 0, 200_000).otherwise(F.col("run_id"))
    arriving = runs.withColumn("arrival", late).unionByName(
        again.withColumn("arrival", F.col("run_id") + 100_000)
    )
    table = new_folder(spark, "ingested")
    _in_parts(arriving, spark, "arriving", "arrival", lambda stream, checkpoint: I.ingest_runs(
        stream.drop("arrival"), table, checkpoint, BUCKETS))
    return spark.read.parquet(table).select(
        "repo", "run_id", "workflow_name", "conclusion", "timestamp"
    )


@query("streamed_run_ledger", "STR1 SET3",
       sql_with("SELECT repo, count(*) AS runs, min(run_id) AS first_run, max(run_id) AS last_run "
                "FROM runs GROUP BY repo"))
def streamed_run_ledger(spark, d):
    """The ledger of a stream in which every run comes twice holds each once."""
    runs = C.runs(spark, d).drop("jobs")
    arriving = runs.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    table = new_folder(spark, "ingested")
    _in_parts(arriving, spark, "twice", "copy", lambda stream, checkpoint: I.ingest_runs(
        stream.drop("copy"), table, checkpoint, BUCKETS))
    return commits.read_keyed(spark, I.ledger_of(table)).groupBy("repo").agg(
        F.count(F.lit(1)).alias("runs"),
        F.min("run_id").alias("first_run"),
        F.max("run_id").alias("last_run"),
    )


@query("streamed_first_seen_runs", "STR1",
       sql_with("SELECT repo, run_id, conclusion FROM runs"))
def streamed_first_seen_runs(spark, d):
    """Runs that come twice within the delay, held back by Spark's own state."""
    runs = C.runs(spark, d).drop("jobs").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    arriving = runs.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    table = new_folder(spark, "seen")

    def run(stream, checkpoint):
        seen = I.first_seen_runs(stream.drop("copy"), "3650 days")
        return (seen.writeStream.format("parquet").option("path", table)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

    _in_parts(arriving, spark, "seen-twice", "timestamp", run)
    return spark.read.parquet(table).select("repo", "run_id", "conclusion")


def _totals(spark, d):
    table = new_folder(spark, "totals")
    _in_parts(C.results(spark, d), spark, "results", "result_ord", lambda stream, checkpoint:
              I.accumulate_stats(stream, table, checkpoint, BUCKETS))
    return table


@query("streamed_test_stats", "STR2 AGG1 AGG2",
       sql_with("""SELECT repo, test_name, total_executions, total_failures, flake_rate, failure_rate,
  first_seen_run, last_seen_run, n_signatures, dominant_signature FROM stats"""))
def streamed_test_stats(spark, d):
    table = _totals(spark, d)
    summary = S.signature_summary(I.merged_signatures(spark, table))
    merged = I.merged_counts(spark, table).join(summary, S.TEST, "left")
    return merged.fillna({"n_signatures": 0}).select(
        "repo", "test_name", "total_executions", "total_failures", "flake_rate", "failure_rate",
        "first_seen_run", "last_seen_run", "n_signatures", "dominant_signature",
    )


@query("streamed_signatures", "STR2 AGG3",
       sql_with("""SELECT repo, test_name, signature_hash, count, sample_message, first_seen, last_seen
FROM sigs"""))
def streamed_signatures(spark, d):
    return I.merged_signatures(spark, _totals(spark, d)).select(
        "repo", "test_name", "signature_hash", "count", "sample_message", "first_seen",
        "last_seen",
    )


@query("streamed_scoring", "STR3 JN7 SNK7",
       sql_with("""SELECT DISTINCT repo, test_name, CASE WHEN right(test_name, 1) < '5' THEN 'REAL_BUG'
  ELSE 'FLAKY' END AS category, 'llm:stub:s1' AS classified_by FROM failing"""))
def streamed_scoring(spark, d):
    """Each failing test is asked about once, however many files it is in."""
    failing = S.failing_results(C.results(spark, d)).select(
        "repo", "test_name", "run_id", "result_ord", F.col("error_message").alias("prompt")
    )
    cache = new_folder(spark, "verdicts")
    _in_parts(failing, spark, "questions", "result_ord", lambda stream, checkpoint: I.score_stream(
        stream.drop("result_ord"), stub_scorer, "stub", "s1", cache, checkpoint, buckets=BUCKETS))
    return I.cached_verdicts(spark, cache).select(
        "repo", "test_name", "category", "classified_by"
    )
