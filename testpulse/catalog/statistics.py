"""Text normalization, signatures and per-test statistics."""

from pyspark.sql import functions as F

from testpulse.catalog.registry import query, sql_infra, sql_normalize, sql_signature, sql_with
from testpulse.functions import rules
from testpulse.functions import text as T
from testpulse.operators import stats as S
from testpulse.plans import ci_tables as C
from testpulse.session import stage


def staged_stats(spark, d):
    """Results, signatures and statistics of the derived CI history; the small
    tables are written down, as the queries read them several times."""
    results = C.results(spark, d)
    sigs = stage(S.signatures(results), "signatures")
    return results, sigs, stage(S.test_stats(results, sigs), "stats")


def flat_stats(stats, *more):
    return stats.select(
        "repo", "test_name", "total_executions", "total_failures", "flake_rate", "failure_rate",
        F.col("n_signatures").cast("bigint").alias("n_signatures"),
        "dominant_signature", "dominant_signature_ratio",
        "first_seen_run", "last_seen_run",
        F.array_join("workflows_affected", ",").alias("workflows"),
        *more,
    )


FLAT_STATS_SQL = """SELECT repo, test_name, total_executions, total_failures, flake_rate,
  failure_rate, n_signatures, dominant_signature, dominant_signature_ratio,
  first_seen_run, last_seen_run, workflows FROM {table}"""


@query("test_stats", "AGG1 AGG2 AGG4 AGG5 AGG6 AGG7",
       sql_with(FLAT_STATS_SQL.format(table="stats")))
def test_stats(spark, d):
    return flat_stats(S.test_stats(C.results(spark, d)))


@query("error_signatures", "AGG3 FN2 FN3 TOP4",
       sql_with("""SELECT repo, test_name, signature_hash, sample_message, count, first_seen,
  last_seen, first_ord FROM sigs ORDER BY repo, test_name, count DESC, first_ord"""))
def error_signatures(spark, d):
    return S.signatures_by_count(S.signatures(C.results(spark, d))).select(
        "repo", "test_name", "signature_hash", "sample_message", "count",
        "first_seen", "last_seen", F.col("first.result_ord").alias("first_ord"),
    )


@query("signature_rank", "WIN3",
       sql_with("SELECT repo, test_name, signature_hash, count, place FROM ranked"))
def signature_rank(spark, d):
    from testpulse.operators.spread import number_rows

    sigs = S.signatures(C.results(spark, d))
    ranked = number_rows(
        sigs, S.TEST, [F.col("count").desc(), F.col("first.result_ord")],
        # nearly all signatures of a test may have one count
        F.struct((-F.col("count")).alias("a"), F.floor(F.col("first.result_ord") / 10_000).alias("b")),
        name="place",
    )
    return ranked.select("repo", "test_name", "signature_hash", "count",
                         (F.col("place") + 1).alias("place"))


@query("failing_executions", "FLT2",
       sql_with("SELECT result_ord, repo, test_name, status, error_message FROM failing"))
def failing_executions(spark, d):
    return S.failing_results(C.results(spark, d)).select(
        "result_ord", "repo", "test_name", "status", "error_message"
    )


@query("status_words", "FLT8",
       """SELECT event_type, mapped AS status, count(*) AS n FROM (
  SELECT event_type, CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type = 'view'
    THEN 'PASSED' WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'SKIPPED'
    WHEN event_type = 'click' THEN 'PASSED' WHEN event_type = 'signup' THEN 'FAILED' END AS mapped
  FROM events) t WHERE mapped IS NOT NULL GROUP BY ALL""")
def status_words(spark, d):
    kind = F.col("event_type")
    word = (
        F.when(kind == "error", "FAIL").when(kind == "view", "✓")
        .when((kind == "click") & (F.col("event_id") % 2 == 0), "skip")
        .when(kind == "click", "ok").when(kind == "signup", "✗").otherwise("xfail")
    )
    return (
        C.events(spark, d).withColumn("status", T.status_of(word))
        .filter(F.col("status").isNotNull())
        .groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("n"))
    )


@query("infra_matches", "FN4",
       sql_with(f"""SELECT infra, count(*) AS n, min(result_ord) AS first_ord FROM (
  SELECT result_ord, {sql_infra("error_message || chr(10) || stack_trace")} AS infra
  FROM failing) t GROUP BY infra"""))
def infra_matches(spark, d):
    failing = S.failing_results(C.results(spark, d))
    infra = rules.infra_pattern(F.col("error_message"), F.col("stack_trace"))
    return failing.groupBy(infra.alias("infra")).agg(
        F.count(F.lit(1)).alias("n"), F.min("result_ord").alias("first_ord")
    )


_DOCS = f"""WITH d AS (SELECT doc_id, source, {sql_normalize('text')} AS normal,
  {sql_infra('text')} AS infra FROM documents)
SELECT source, substr(sha256(normal), 1, 16) AS signature_hash, count(*) AS n,
  min(doc_id) AS first_doc, min(infra) AS infra FROM d GROUP BY ALL"""


@query("document_signatures", "FN2 FN3 FN4 AGG3", _DOCS)
def document_signatures(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    signed = docs.select(
        "doc_id", "source", T.error_signature(F.col("text")).alias("signature_hash"),
        rules.infra_pattern(F.col("text"), F.lit("")).alias("infra"),
    )
    return signed.groupBy("source", "signature_hash").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"),
        F.min("infra").alias("infra"),
    )


@query("line_signatures", "SRC4 FN1 FN2 FN3 AGG3",
       f"""SELECT {sql_signature('line')} AS signature_hash, count(*) AS n,
  count(DISTINCT doc_id) AS n_docs FROM (
  SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) AS line FROM documents) t
  WHERE line <> '' GROUP BY 1""")
def line_signatures(spark, d):
    """Signatures of single text lines, in two steps: a line that fills a third
    of all texts is counted per text first."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lines = docs.select("doc_id", F.explode(F.split("text", r"\r\n|\n|\r")).alias("line"))
    per_doc = (
        lines.filter(F.col("line") != "")
        .groupBy(T.error_signature(T.strip_ansi(F.col("line"))).alias("signature_hash"), "doc_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_doc.groupBy("signature_hash").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs")
    )
