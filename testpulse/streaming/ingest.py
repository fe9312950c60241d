"""Incremental ingest and analysis with Structured Streaming.

What a batch has to know of earlier batches lies in Spark's state store (running
statistics) or in keyed tables (ledger, verdict cache) of which a batch opens the buckets
of its own keys only.  A batch that is repeated after a failure replaces what it wrote, so
each run, execution and verdict counts exactly once, over any number of restarts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from testpulse.functions import fixed
from testpulse.functions.text import error_signature, is_failing
from testpulse.operators import classify, scoring
from testpulse.operators.classify import VERDICT
from testpulse.operators.runs import RUN, unprocessed
from testpulse.operators.scoring import CACHE_KEY
from testpulse.operators.stats import TEST, rates
from testpulse.session import stage
from testpulse.sources import commits

SIGNATURE = [*TEST, "signature_hash"]


def _start(stream: DataFrame, each_batch, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(each_batch)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ledger_of(table: str) -> str:
    """Where :func:`ingest_runs` keeps the keys of a table's runs."""
    return f"{table.rstrip('/')}_ledger"


def ingest_runs(
    stream: DataFrame, table: str, checkpoint: str, buckets: int = commits.BUCKETS
) -> StreamingQuery:
    """Append runs that were never seen to ``table``, in any number of restarts.

    A run is new if the ledger, a keyed table beside it, does not hold its key; however late
    or often it comes, it is kept once.  The rows of a batch are written before its ledger
    entries, so a batch that was cut short finds the same runs new again.
    """

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        # Of several records of a run in a batch the least counts, on every repetition.
        rest = [c for c in batch.columns if c not in RUN]
        one = batch.groupBy(*RUN).agg(F.min(F.struct(*rest)).alias("_run"))
        arrived = stage(one.select(*RUN, "_run.*").select(batch.columns), "arrived-runs")
        known = commits.known_rows(arrived, ledger_of(table), RUN, before=batch_id)
        new = arrived if known is None else unprocessed(arrived, known.select(*RUN))
        new.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        commits.upsert(
            batch.sparkSession.read.schema(batch.schema).parquet(f"{table}/batch={batch_id}").select(*RUN),
            ledger_of(table), RUN, batch_id, buckets,
        )

    return _start(stream, each_batch, checkpoint)


def first_seen_runs(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """The same within a time limit, with state kept by Spark: a run that comes
    again within ``delay`` of its first copy is dropped."""
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(RUN)


def running_counts(stream: DataFrame) -> DataFrame:
    """Executions and failures per test so far, for an ``update`` sink."""
    counted = stream.groupBy(*TEST).agg(
        F.count(F.lit(1)).alias("total_executions"),
        F.count_if(is_failing(F.col("status"))).alias("total_failures"),
    )
    return counted.withColumns(rates(F.col("total_failures"), F.col("total_executions")))


def accumulate_stats(
    stream: DataFrame, table: str, checkpoint: str, buckets: int = commits.BUCKETS
) -> StreamingQuery:
    """Running totals per test and signature, kept in Spark's state store.

    The state has one row per (test, signature), and one per test for executions that do not
    fail.  A batch is reduced in its map tasks, meets the state of its own keys, and the
    totals that it changed take the place of the earlier ones in ``table``, a keyed table.
    No batch adds up what earlier ones have counted.
    """
    failing = is_failing(F.col("status"))
    first = F.struct("result_ord", "run_id", "error_message", "stack_trace")
    totals = (
        stream.withColumn("signature_hash", F.when(failing, error_signature(F.col("error_message"))))
        .groupBy(*SIGNATURE)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("timestamp").alias("first_time"),
            F.max("timestamp").alias("last_time"),
            F.min(F.when(failing, first)).alias("first"),
        )
    )

    def each_batch(changed: DataFrame, batch_id: int) -> None:
        commits.upsert(changed, table, SIGNATURE, batch_id, buckets)

    return _start(totals, each_batch, checkpoint, "update")


def compact(spark: SparkSession, table: str) -> None:
    """Remove totals that later ones have replaced.  Run it between streams."""
    commits.vacuum(spark, table)


def merged_counts(spark: SparkSession, table: str) -> DataFrame:
    """Totals so far per test."""
    failures = F.coalesce(F.sum(F.when(F.col("signature_hash").isNotNull(), F.col("n"))), F.lit(0))
    total = commits.read_keyed(spark, table).groupBy(*TEST).agg(
        F.sum("n").alias("total_executions"),
        failures.alias("total_failures"),
        F.min("first_time").alias("first_seen_run"),
        F.max("last_time").alias("last_seen_run"),
    )
    return total.withColumns(rates(F.col("total_failures"), F.col("total_executions")))


def merged_signatures(spark: SparkSession, table: str) -> DataFrame:
    """Signature groups so far, as if computed at once."""
    message = F.coalesce(F.nullif(F.col("first.error_message"), F.lit("")), F.lit(fixed.NO_MESSAGE))
    return (
        commits.read_keyed(spark, table)
        .filter(F.col("signature_hash").isNotNull())
        .select(
            *SIGNATURE, message.alias("sample_message"), F.col("n").alias("count"),
            F.col("first_time").alias("first_seen"), F.col("last_time").alias("last_seen"), "first",
        )
    )


def score_stream(
    stream: DataFrame,
    scorer: classify.Scorer,
    provider: str,
    model: str,
    cache_path: str,
    checkpoint: str,
    verdicts_path: str | None = None,
    buckets: int = commits.BUCKETS,
) -> StreamingQuery:
    """Score prompts as they come; a test that the cache knows is not asked again.

    ``stream`` has (repo, test_name, run_id, prompt).  The cache is a keyed table: a batch
    looks into the buckets of its own tests, and its answers are one version of them.  Of
    several prompts of a test in a batch the least (run_id, prompt) is asked.  All fresh
    verdicts, failed calls with their fallback included, go to ``verdicts_path``.
    """

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        least = F.min(F.struct("run_id", "prompt")).alias("least")
        asked = batch.groupBy(*TEST).agg(least).select(
            *TEST, "least.*", F.lit(provider).alias("provider"), F.lit(model).alias("model")
        )
        wanted = stage(asked, "wanted-verdicts")
        known = commits.known_rows(wanted, cache_path, CACHE_KEY, before=batch_id)
        misses = wanted if known is None else scoring.cache_misses(wanted, known)
        answers = stage(scoring.parse_responses(stage(scorer(misses), "responses")), "answers")
        if verdicts_path is not None:
            answers.write.mode("overwrite").parquet(f"{verdicts_path}/batch={batch_id}")
        fresh = scoring.cacheable(answers).select(*CACHE_KEY, "run_id", *VERDICT)
        commits.upsert(fresh, cache_path, CACHE_KEY, batch_id, buckets)

    return _start(stream, each_batch, checkpoint)


def cached_verdicts(spark: SparkSession, cache_path: str) -> DataFrame:
    """All verdicts that :func:`score_stream` has cached, one per key."""
    return commits.read_keyed(spark, cache_path)
