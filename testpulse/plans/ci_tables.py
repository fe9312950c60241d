"""CI tables derived from the event table of the test data.

One SQL text per table, used by the Spark queries and by the SQL they are
checked against.  ``{S}`` is the name of the text type, ``{BS}`` a backslash.
What stands between ``{ONCE}`` and ``{END_ONCE}`` is computed once in Spark, by a
generator: a filter on it would else be pushed below it and repeat all of it, in a
generated method that the JVM does not compile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testpulse.session import stage_once

RESULTS = """
SELECT result_ord, repo, run_id, test_name, status,
  CASE WHEN status IN ('FAILED', 'ERROR') THEN raw_message ELSE '' END AS error_message,
  CASE WHEN status IN ('FAILED', 'ERROR') THEN concat('File "t.py", line ', CAST(result_ord % 97 AS {S}))
       ELSE '' END AS stack_trace,
  timing_seconds, workflow_name, job_name, ts AS timestamp
FROM (
  SELECT event_id AS result_ord,
    concat('org/app', CAST(user_id % 3 AS {S})) AS repo,
    CAST(1000 + FLOOR(event_id / 20) AS BIGINT) AS run_id,
    concat('tests/test_m', CAST(user_id % 7 AS {S}), '.py::test_u', CAST(user_id AS {S})) AS test_name,
    CASE WHEN user_id % 5 = 0 AND event_type IN ('error', 'view', 'click') THEN 'FAILED'
         WHEN user_id % 5 BETWEEN 1 AND 3 AND event_type = 'error' THEN 'FAILED'
         WHEN user_id % 5 <> 4 AND event_type = 'purchase' AND event_id % 11 = 0 THEN 'ERROR'
         WHEN event_type = 'signup' THEN 'SKIPPED' ELSE 'PASSED' END AS status,
    CASE WHEN user_id % 5 = 0 THEN concat('/home/ci', CAST(event_id AS {S}), '/app/t.py:', CAST(event_id % 997 AS {S}), ': AssertionError: assert 1 == 2')
         WHEN user_id % 5 = 1 AND event_id % 3 = 0 THEN concat('KeyError: id at 0x7f', CAST(event_id % 9 AS {S}), 'a pid ', CAST(event_id AS {S}))
         WHEN user_id % 5 = 1 AND event_id % 3 = 1 THEN concat('2024-01-01T00:00:0', CAST(event_id % 9 AS {S}), ' ValueError port ', CAST(8000 + event_id AS {S}), ' busy')
         WHEN user_id % 5 = 3 THEN concat('ConnectionError: request timed out after attempt ', CAST(event_id % 4 AS {S}))
         WHEN user_id % 5 = 2 THEN 'AssertionError: assert False'
         ELSE 'TypeError: unexpected None' END AS raw_message,
    value AS timing_seconds, ts,
    CASE event_id % 3 WHEN 0 THEN 'CI' WHEN 1 THEN 'Lint' ELSE 'Nightly' END AS workflow_name,
    'tests' AS job_name
  FROM {events}
) e
"""

RUNS = """
SELECT repo, run_id, CASE run_id % 3 WHEN 0 THEN 'CI' WHEN 1 THEN 'Lint' ELSE 'Nightly' END AS workflow_name,
  'completed' AS status,
  CASE WHEN MAX(CASE WHEN status IN ('FAILED', 'ERROR') THEN 1 ELSE 0 END) = 1 THEN 'failure'
       WHEN run_id % 10 = 0 THEN 'cancelled' ELSE 'success' END AS conclusion,
  MIN(timestamp) AS timestamp,
  concat('https://ci.example/', repo, '/', CAST(run_id AS {S})) AS html_url
FROM {results} r
GROUP BY repo, run_id
"""

LOG_LINES = """
SELECT repo, run_id, 'job.txt' AS filename, 0 AS entry_ord, event_id AS line_no, CASE
 WHEN fw = 0 THEN concat(tz,'tests/test_m.py::test_u',u,' ',CASE st WHEN 'F' THEN 'FAILED' WHEN 'E' THEN 'ERROR' WHEN 'S' THEN 'SKIPPED' ELSE 'PASSED' END)
 WHEN fw = 1 THEN CASE WHEN st IN ('F','E') THEN concat(tz,CASE st WHEN 'F' THEN 'FAILED' ELSE 'ERROR' END,' tests/test_m.py::test_u',u,' - AssertionError: x') ELSE 'collected' END
 WHEN fw = 2 THEN concat(tz,'test_u',u,' (tests.m.Case) ... ',CASE st WHEN 'F' THEN 'FAIL' WHEN 'E' THEN 'ERROR' WHEN 'S' THEN 'skip' ELSE 'ok' END)
 WHEN fw = 3 THEN concat(tz,CASE st WHEN 'F' THEN 'FAIL' WHEN 'E' THEN 'ERROR' WHEN 'S' THEN 'SKIP' ELSE 'PASS' END,' pkg/__tests__/u',u,'.test.ts')
 WHEN fw = 4 THEN concat(tz,CASE st WHEN 'F' THEN '✗' ELSE '✓' END,' unit pkg/__tests__/u',u,'.spec.ts (3 tests) 5ms')
 WHEN fw = 5 THEN concat(tz,CASE st WHEN 'F' THEN 'FAIL' ELSE 'PASS' END,' Turbopack test/u',u,'.test.ts (4 s)')
 WHEN fw = 6 THEN concat(tz,'--- ',CASE st WHEN 'F' THEN 'FAIL' ELSE 'PASS' END,': TestU',u,' (0.00s)')
 WHEN fw = 7 THEN concat(tz,CASE st WHEN 'F' THEN 'FAIL' ELSE 'PASS' END,'  Tests',{BS},'Unit',{BS},'U',u)
 WHEN fw = 8 THEN CASE WHEN st='F' THEN concat(tz,u,') Cop U',u,' should work') ELSE 'Finished' END
 WHEN fw = 9 THEN concat(tz,'20 runs, 40 assertions, ',CAST(event_id % 3 AS {S}),' failures, 0 errors, 0 skips')
 WHEN fw = 10 THEN concat(tz,'  ',CASE st WHEN 'F' THEN '✗' ELSE '✓' END,' should do u',u)
 WHEN fw = 11 THEN CASE WHEN st IN ('F','E') THEN concat(tz,'testU',u,'(com.x.Case)  Time elapsed: 1.25 s  <<< ',CASE st WHEN 'F' THEN 'FAILURE!' ELSE 'ERROR!' END) ELSE 'BUILD' END
 WHEN fw = 13 THEN concat(tz,'test_u',u,' (tests.m.Case [p ',u,']) ..... ',CASE st WHEN 'F' THEN 'FAIL' WHEN 'E' THEN 'ERROR' WHEN 'S' THEN 'skip' ELSE 'ok' END)
 WHEN fw = 14 THEN concat(tz,'  ',CASE st WHEN 'F' THEN '✗' ELSE '✓' END,' renders u',u,' (',u,'ms)')
 ELSE concat(tz,'Compiling step ',u,' in ',u,'.5s') END AS line
FROM (
  SELECT event_id, run_id, repo, st, fw, CAST(user_id AS {S}) AS u,
    CASE WHEN run_id % 2 = 0 THEN '2024-01-02T03:04:05.1234567Z ' ELSE '' END AS tz
  FROM (
    SELECT event_id, user_id, run_id, concat('org/app', CAST(run_id % 4 AS {S})) AS repo,
      run_id % 15 AS fw,
      CASE WHEN event_type='error' THEN 'F' WHEN event_type='purchase' THEN 'E'
           WHEN event_type='signup' THEN 'S' ELSE 'P' END AS st
    FROM (SELECT event_id, user_id, event_type,
            CAST(1000 + FLOOR(event_id / 20) AS BIGINT) AS run_id FROM {events}) a
  ) b
) c
"""

# Logs with failure blocks: run_id % 3 is 0 for pytest, 1 for unittest, 2 for
# Jest; a failing event gives five lines, another one or two.
BLOCK_LINES = """
SELECT repo, run_id, 'job.txt' AS filename, 0 AS entry_ord, line_no, line FROM (
  SELECT repo, run_id, event_id * 5 + k AS line_no, {ONCE}CASE
    WHEN kind = 0 AND k = 0 THEN concat('tests/test_m.py::test_u',u,' ',CASE st WHEN 'F' THEN 'FAILED' WHEN 'E' THEN 'ERROR' WHEN 'S' THEN 'SKIPPED' ELSE 'PASSED' END)
    WHEN kind = 0 AND failed AND k = 1 THEN concat('_______ test_u',u,' _______')
    WHEN kind = 0 AND failed AND k = 2 THEN '    def test_it():'
    WHEN kind = 0 AND st = 'F' AND k = 3 THEN concat('E   AssertionError: got ',n)
    WHEN kind = 0 AND st = 'F' AND k = 4 THEN 'E    + where x is 3'
    WHEN kind = 0 AND st = 'E' AND k = 3 THEN concat('tests/test_m.py:',n,': ValueError: bad port ',n)
    WHEN kind = 0 AND st = 'E' AND k = 4 THEN '1 error in 0.32s'
    WHEN kind = 1 AND k = 0 THEN concat('test_u',u,' (tests.m.Case) ... ',CASE st WHEN 'F' THEN 'FAIL' WHEN 'E' THEN 'ERROR' WHEN 'S' THEN 'skip' ELSE 'ok' END)
    WHEN kind = 1 AND failed AND k = 1 THEN concat('FAIL: test_u',u,' (tests.m.Case)')
    WHEN kind = 1 AND failed AND k = 2 THEN '----------------------------------------------------------------------'
    WHEN kind = 1 AND failed AND k = 3 THEN 'Traceback (most recent call last):'
    WHEN kind = 1 AND failed AND k = 4 THEN concat('AssertionError: ',n,' != 0')
    WHEN kind = 1 AND st = 'S' AND k = 1 THEN concat('Ran 3 tests in ',u,'.25s')
    WHEN kind = 2 AND k = 0 THEN concat(CASE WHEN failed THEN 'FAIL' ELSE 'PASS' END,' pkg/__tests__/u',u,'.test.ts')
    WHEN kind = 2 AND failed AND k = 1 THEN concat('  ● Suite › u',u)
    WHEN kind = 2 AND st = 'F' AND k = 2 THEN concat('    at setup ',n)
    WHEN kind = 2 AND st = 'F' AND k = 3 THEN concat('    expect(received).toBe(',n,')')
    WHEN kind = 2 AND st = 'E' AND k = 2 THEN concat('    TypeError: boom ',n)
    WHEN kind = 2 AND st = 'E' AND k = 3 THEN '      at Object.<anonymous>'
    WHEN kind = 2 AND failed AND k = 4 THEN 'Tests: 1 failed in 1.5s'
    END{END_ONCE} AS line
  FROM (
    SELECT event_id, k, run_id, st, st IN ('F', 'E') AS failed, run_id % 3 AS kind,
      concat('org/app', CAST(run_id % 4 AS {S})) AS repo,
      CAST(user_id AS {S}) AS u, CAST(event_id AS {S}) AS n
    FROM (
      SELECT event_id, user_id, CAST(1000 + FLOOR(event_id / 20) AS BIGINT) AS run_id,
        CASE WHEN event_type='error' THEN 'F' WHEN event_type='purchase' THEN 'E'
             WHEN event_type='signup' THEN 'S' ELSE 'P' END AS st, {EXPLODE_K} AS k
      FROM {events}
    ) a
  ) b
) c WHERE line IS NOT NULL
"""

RESPONSES = """
SELECT event_id, concat('org/app', CAST(user_id % 3 AS {S})) AS repo,
 concat('tests/test_m', CAST(user_id % 7 AS {S}), '.py::test_u', CAST(user_id AS {S})) AS test_name,
 CAST(1000 + FLOOR(event_id / 20) AS BIGINT) AS run_id,
 CASE event_id % 2 WHEN 0 THEN 'prov_a' ELSE 'prov_b' END AS provider, 'model-x' AS model,
 'model-x-1' AS model_returned,
 CASE WHEN event_id % 13 = 4 THEN 'length' ELSE 'stop' END AS finish_reason,
 CASE WHEN event_id % 13 = 7 THEN 'timeout' END AS call_error,
 CASE event_id % 13
  WHEN 0 THEN '{{"category": "REAL_BUG", "evidence": "same error", "confidence": 0.9}}'
  WHEN 1 THEN concat('{{"category": "flaky", "evidence": "mixed", "confidence": ', CAST(event_id % 5 AS {S}), '}}')
  WHEN 2 THEN 'not json at all'
  WHEN 3 THEN '{{"category": "WEATHER", "confidence": -0.5}}'
  WHEN 4 THEN 'thinking about it'
  WHEN 5 THEN '{{"category": "INFRA", "evidence": "oom", "confidence": "high"}}'
  WHEN 6 THEN '{{}}'
  WHEN 8 THEN '{{"category": null, "confidence": 0.4}}'
  WHEN 9 THEN '[1, 2]'
  WHEN 10 THEN '{{"category": "INFRA", "evidence": "net", "confidence": "0.75"}}'
  WHEN 11 THEN '{{"category": "INFRA"}} and more'
  WHEN 12 THEN '{{"category": "REAL_BUG", "evidence": "x", "confidence": null}}' END AS content,
 ts AS called_at, value AS latency_seconds,
 CAST(700 + event_id % 200 AS BIGINT) AS prompt_tokens, CAST(50 + event_id % 50 AS BIGINT) AS completion_tokens,
 CAST(750 + event_id % 200 + event_id % 50 AS BIGINT) AS total_tokens
FROM {events}
"""


def duck(sql: str, **tables: str) -> str:
    """The text for the SQL checker, with sub-selects for table names."""
    names = {"events": "events", "S": "VARCHAR", "BS": "chr(92)",
             "EXPLODE_K": "unnest([0, 1, 2, 3, 4])", "ONCE": "", "END_ONCE": ""}
    return sql.format(**names | tables)


def _spark_sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    slots = {name: "{" + name + "}" for name in tables}
    text = sql.format(S="STRING", BS="char(92)", EXPLODE_K="explode(array(0, 1, 2, 3, 4))",
                      ONCE="explode(array(", END_ONCE="))", **slots)
    # what is left of {{ }} are JSON braces in literals
    for name in tables:
        text = text.replace("{" + name + "}", "\0" + name + "\1")
    text = text.replace("{", "{{").replace("}", "}}")
    return spark.sql(text.replace("\0", "{").replace("\1", "}"), **tables)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def _table(spark: SparkSession, folder: str, name: str, sql: str) -> DataFrame:
    """A derived table, written once per application and then scanned, so that
    filters and columns are pushed into the scan like for any table.  The event
    table is a few small files; its rows, which are far smaller than the derived ones, are dealt
    out by run, and each core derives a file of whole runs."""

    def build() -> DataFrame:
        run = F.floor(F.col("event_id") / 20)
        dealt = events(spark, folder).repartition(spark.sparkContext.defaultParallelism, run)
        return _spark_sql(spark, sql, events=dealt)

    return stage_once(spark, f"{name}:{folder}", build)


def results(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "results", RESULTS)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of :func:`results`, with one or two jobs."""
    table = _spark_sql(spark, RUNS, results=results(spark, folder))
    return table.withColumn("jobs", jobs())


def jobs():
    """Jobs by run id: one test job; a lint job and a test job; only lint jobs."""
    def job(number, name):
        return F.struct(
            (F.col("run_id") * 10 + number).alias("job_id"),
            F.lit(name).alias("name"),
            F.col("conclusion").alias("conclusion"),
            F.lit("").alias("logs_url"),
        )

    return (
        F.when(F.col("run_id") % 3 == 0, F.array(job(0, "test (3.11)")))
        .when(F.col("run_id") % 3 == 1, F.array(job(0, "lint"), job(1, "job")))
        .otherwise(F.array(job(0, "lint"), job(1, "docs")))
    )


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "log_lines", LOG_LINES)


def block_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "block_lines", BLOCK_LINES)


def responses(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "responses", RESPONSES)


def log_runs(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    """Runs of the derived logs, one per (repo, run_id); some have failed."""
    seen = (log_lines(spark, folder) if lines is None else lines).groupBy("repo", "run_id").agg(
        F.max("line_no").alias("last_line")
    )
    return seen.select(
        "repo", "run_id",
        F.when(F.col("run_id") % 2 == 0, "CI").otherwise("Nightly").alias("workflow_name"),
        F.lit("completed").alias("status"),
        F.when(F.col("run_id") % 7 == 0, "success").otherwise("failure").alias("conclusion"),
        F.timestamp_add("MINUTE", F.col("run_id"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
        .alias("timestamp"),
        F.lit("").alias("html_url"),
    ).withColumn("jobs", jobs())
