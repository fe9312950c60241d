"""Log lines to test results."""

from pyspark.sql import functions as F

from testpulse.catalog.registry import query, sql_strip, sql_with
from testpulse.functions import fixed
from testpulse.operators import extract as E
from testpulse.plans import ci_tables as C

LOG = "repo, run_id, filename"


def _group(pattern, n):
    return f"regexp_extract(line, '{pattern}', {n})"


def _path(pattern, n):
    return f"translate({_group(pattern, n)}, '/' || chr(92), '..')"


# rule, priority, order within the framework, pattern, status word, test name
_RULES = [
    ("pytest_name_status", 11, 0, fixed.PYTEST_NAME_STATUS, 2, _group(fixed.PYTEST_NAME_STATUS, 1)),
    ("pytest_status_name", 12, 0, fixed.PYTEST_STATUS_NAME, 1, _group(fixed.PYTEST_STATUS_NAME, 2)),
    ("unittest_dots", 21, 0, fixed.UNITTEST_DOTS, 3,
     f"{_group(fixed.UNITTEST_DOTS, 2)} || '.' || {_group(fixed.UNITTEST_DOTS, 1)}"),
    ("unittest_loose", 22, 0, fixed.UNITTEST_LOOSE, 3,
     f"{_group(fixed.UNITTEST_LOOSE, 2)} || '.' || {_group(fixed.UNITTEST_LOOSE, 1)}"),
    ("jest_suite", 30, 0, fixed.JEST_SUITE, 1, _path(fixed.JEST_SUITE, 2)),
    ("js_generic", 30, 1, fixed.JS_GENERIC, 1, _path(fixed.JS_GENERIC, 2)),
    ("vitest", 40, 0, fixed.VITEST_FILE, 1, _path(fixed.VITEST_FILE, 2)),
    ("suite_word", 50, 0, fixed.SUITE_WORD_FILE, 1, _path(fixed.SUITE_WORD_FILE, 2)),
    ("go", 60, 0, fixed.GO_RESULT, 1, _group(fixed.GO_RESULT, 2)),
    ("phpunit", 70, 0, fixed.PHPUNIT_CLASS, 1,
     f"replace({_group(fixed.PHPUNIT_CLASS, 2)}, chr(92), '.')"),
    ("rspec", 80, 0, fixed.RSPEC_FAILURE, None, sql_strip(_group(fixed.RSPEC_FAILURE, 2))),
    ("minitest", 90, 0, fixed.MINITEST_TOTALS, None, "'minitest_summary'"),
    ("mocha", 100, 0, fixed.MOCHA_RESULT, 1, sql_strip(_group(fixed.MOCHA_RESULT, 2))),
    ("junit", 110, 0, fixed.JUNIT_FAILURE, None,
     f"{_group(fixed.JUNIT_FAILURE, 2)} || '.' || {_group(fixed.JUNIT_FAILURE, 1)}"),
    ("cypress", 120, 0, fixed.CYPRESS_RESULT, 1, sql_strip(_group(fixed.CYPRESS_RESULT, 2))),
]


def _status(pattern, group):
    if group is None:
        return "'FAILED'"
    cases = " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in fixed.STATUS_WORDS.items())
    return f"CASE {_group(pattern, group)} {cases} END"


def _rule_sql(rule, priority, rule_ord, pattern, status, name, table="log_lines"):
    where = f"regexp_matches(line, '{pattern}')"
    if rule == "js_generic":
        where += f" AND NOT regexp_matches(line, '{fixed.JEST_SUITE}')"
    message = "''"
    if rule == "minitest":
        count = f"CAST({_group(pattern, 3)} AS INTEGER)"
        where += f" AND {count} > 0"
        message = f"{count} || ' failures'"
    return f"""SELECT {LOG}, line_no, {priority} AS priority, '{rule}' AS rule,
  {rule_ord} AS rule_ord, {_status(pattern, status)} AS status, {name} AS test_name,
  {message} AS message, line FROM {table} WHERE {where}"""


def _candidates(table="log_lines", rules=None):
    return "\nUNION ALL\n".join(
        _rule_sql(*r, table=table) for r in _RULES if rules is None or r[0] in rules
    )


def _won(table):
    return f"SELECT {LOG}, min(priority) AS priority FROM {table} GROUP BY ALL"


_IDS = {
    "pytest_name_status": "EX1", "pytest_status_name": "EX2", "unittest_dots": "EX3",
    "unittest_loose": "EX4", "jest_suite": "EX5", "js_generic": "EX6 JN9 SET2", "vitest": "EX8",
    "suite_word": "EX9", "go": "EX10", "phpunit": "EX11", "rspec": "EX12", "minitest": "EX13",
    "mocha": "EX14", "junit": "EX15", "cypress": "EX16",
}


def _register_rule(rule):
    @query(f"{rule[0]}_lines", _IDS[rule[0]],
           sql_with(f"SELECT {LOG}, line_no, status, test_name, message FROM c",
                    c=_rule_sql(*rule)))
    def lines_of_rule(spark, d):
        number = next(i for i, r in enumerate(E.RESULT_RULES) if r.rule == rule[0])
        line = F.col("line")
        hits = C.log_lines(spark, d).filter(E.matches_rule(line, E.RESULT_RULES[number]))
        keep = ["repo", "run_id", "filename", "line_no"]
        return E.with_event_fields(hits.withColumn("code", F.lit(number)), keep).select(
            *keep, "status", F.col("name").alias("test_name"), F.col("detail").alias("message")
        )


for _rule in _RULES:
    _register_rule(_rule)


@query("extracted_results", "WIN7 WIN8 SET1 FLT8 FN8 EX1 EX2 EX3 EX4",
       sql_with(f"""SELECT {LOG}, line_no, status, test_name, message, rule,
  row_number() OVER (PARTITION BY repo ORDER BY CAST(run_id AS VARCHAR), rule_ord, line_no)
    AS place FROM c JOIN w USING ({LOG}, priority)""",
                c=_candidates(), w=_won("c")))
def extracted_results(spark, d):
    """All rules and the choice of the framework per log, in result order."""
    from testpulse.operators.spread import number_rows

    results = E.extract_results(C.log_lines(spark, d))
    numbered = number_rows(
        results, ["repo"], [F.col("result_ord")], F.substring(F.col("run_id").cast("string"), 1, 8),
        name="place",
    )
    line_no = (F.col("result_ord") % F.lit(10**10).cast("decimal(38,0)")).cast("bigint")
    return numbered.select(
        "repo", "run_id", "filename", line_no.alias("line_no"), "status", "test_name",
        F.col("error_message").alias("message"), "rule", (F.col("place") + 1).alias("place"),
    )


@query("results_per_framework", "WIN7 AGG1",
       sql_with(f"SELECT rule, status, count(*) AS n FROM c JOIN w USING ({LOG}, priority) GROUP BY ALL",
                c=_candidates(), w=_won("c")))
def results_per_framework(spark, d):
    results = E.extract_results(C.log_lines(spark, d))
    return results.groupBy("rule", "status").agg(F.count(F.lit(1)).alias("n"))


@query("hinted_framework_results", "EX16 EX14",
       sql_with(f"SELECT {LOG}, line_no, status, test_name FROM c", c=_candidates(rules=["cypress"])))
def hinted_framework_results(spark, d):
    """Logs known to be Cypress, whose lines Mocha would claim otherwise."""
    results = E.extract_results(C.log_lines(spark, d), framework="cypress")
    line_no = (F.col("result_ord") % F.lit(10**10).cast("decimal(38,0)")).cast("bigint")
    return results.select("repo", "run_id", "filename", line_no.alias("line_no"), "status",
                          "test_name")


@query("unmatched_logs", "EX17",
       sql_with(f"SELECT DISTINCT {LOG} FROM log_lines WHERE (repo, run_id) NOT IN "
                "(SELECT (repo, run_id) FROM c)", c=_candidates()))
def unmatched_logs(spark, d):
    lines = C.log_lines(spark, d)
    return E.unmatched_logs(lines, E.line_events(lines))


@query("log_durations", "FN7",
       sql_with(f"""SELECT {LOG}, w.priority, CASE WHEN w.priority IN (11, 12, 21, 22, 30, 40, 50)
  THEN coalesce(TRY_CAST(t.duration AS DOUBLE), 0.0) ELSE 0.0 END AS timing_seconds
FROM w LEFT JOIN t USING ({LOG})""",
                c=_candidates("block_lines"), w=_won("c"),
                t=f"""SELECT {LOG}, arg_min(regexp_extract(line, '{fixed.DURATION}', 1), line_no)
  AS duration FROM block_lines WHERE regexp_matches(line, '{fixed.DURATION}') GROUP BY ALL"""))
def log_durations(spark, d):
    logs = E.log_frameworks(E.line_events(C.block_lines(spark, d)))
    return logs.select("repo", "run_id", "filename", F.col("won").alias("priority"),
                       "timing_seconds")


_BARE = sql_strip("line")
_BLOCK_CTES = {
    "c": _candidates("block_lines"),
    "w": _won("c"),
    "rows": f"SELECT c.*, CASE WHEN priority < 20 THEN 'pytest' WHEN priority < 30 THEN 'unittest' "
            f"WHEN priority = 30 THEN 'jest' END AS style FROM c JOIN w USING ({LOG}, priority)",
    "styled": f"""SELECT l.*, CASE WHEN priority < 20 THEN 'pytest' WHEN priority < 30
  THEN 'unittest' WHEN priority = 30 THEN 'jest' END AS style
  FROM block_lines l JOIN w USING ({LOG})""",
    "marked": f"""SELECT *, CASE
  WHEN style = 'pytest' AND regexp_matches(line, '{fixed.PYTEST_HEADER}')
    THEN {sql_strip(_group(fixed.PYTEST_HEADER, 1))}
  WHEN style = 'unittest' AND regexp_matches(line, '{fixed.UNITTEST_HEADER}')
    THEN {_group(fixed.UNITTEST_HEADER, 2)}
  WHEN style = 'unittest' AND (starts_with(line, 'Ran ')
    OR regexp_matches(line, '{fixed.UNITTEST_RULER}')) THEN ''
  WHEN style = 'jest' AND regexp_matches(line, '{fixed.JEST_HEADER}')
    THEN {sql_strip(_group(fixed.JEST_HEADER, 1))}
  WHEN style = 'jest' AND (regexp_matches(line, '{fixed.JEST_SUITE}')
    OR regexp_matches(line, '{fixed.JS_GENERIC}') OR regexp_matches(line, '{fixed.JEST_TOTALS}'))
    THEN '' END AS mark FROM styled""",
    "grouped": f"SELECT *, count(mark) OVER (PARTITION BY {LOG} ORDER BY line_no) AS g, "
               f"{_BARE} AS bare FROM marked",
    "blocks": f"""SELECT {LOG}, style, g, max(mark) AS name, min(line_no) AS start,
  string_agg(line, chr(10) ORDER BY line_no) FILTER (mark IS NULL AND NOT
    (style = 'unittest' AND starts_with(line, '---'))) AS body,
  string_agg({sql_strip('substr(line, 3)')}, chr(10) ORDER BY line_no)
    FILTER (mark IS NULL AND starts_with(line, 'E ')) AS errors,
  arg_min(regexp_extract(line, '{fixed.SOURCE_LOCATION}', 1), line_no)
    FILTER (mark IS NULL AND regexp_matches(line, '{fixed.SOURCE_LOCATION}')) AS location,
  arg_max(bare, line_no) FILTER (mark IS NULL AND bare <> '' AND NOT starts_with(line, '---')
    AND NOT starts_with(bare, 'Traceback') AND NOT starts_with(bare, 'File ')) AS last_line,
  arg_min(bare, line_no) FILTER (mark IS NULL AND starts_with(bare, 'expect')) AS expect,
  arg_min(bare, line_no) FILTER (mark IS NULL AND bare <> '' AND NOT starts_with(bare, 'at ')
    AND NOT starts_with(bare, '> ') AND NOT starts_with(bare, 'File ')
    AND NOT starts_with(bare, '|')) AS plain
  FROM grouped WHERE g > 0 GROUP BY {LOG}, style, g""",
    "named": f"""SELECT {LOG}, style, name, arg_max(coalesce({sql_strip('body')}, ''), start) AS stack_trace,
  arg_max(coalesce(CASE style WHEN 'pytest' THEN {sql_strip("coalesce(nullif(errors, ''), location)")}
    WHEN 'unittest' THEN last_line ELSE coalesce(expect, plain) END, ''), start) AS message,
  min(start) AS first_start FROM blocks WHERE name <> '' GROUP BY {LOG}, style, name""",
    "js": f"""SELECT {LOG}, string_agg(CASE WHEN message = '' THEN name ELSE name || ': ' || message END,
  '; ' ORDER BY first_start) AS message FROM named WHERE style = 'jest' GROUP BY ALL""",
}


@query("failure_messages", "EX7 WIN5 WIN6 WIN9 JN2 JN8 FN9 FN10 FN11 FN12",
       sql_with(f"""SELECT r.repo, r.run_id, r.line_no, r.status, r.test_name,
  CASE WHEN r.status NOT IN ('FAILED', 'ERROR') THEN ''
    WHEN r.style = 'jest' THEN coalesce(js.message, '') ELSE coalesce(n.message, '') END
    AS error_message,
  CASE WHEN r.status NOT IN ('FAILED', 'ERROR') OR r.style = 'jest' THEN ''
    ELSE coalesce(n.stack_trace, '') END AS stack_trace
FROM rows r LEFT JOIN named n ON n.repo = r.repo AND n.run_id = r.run_id AND n.style = r.style
  AND n.name = CASE r.style WHEN 'pytest' THEN split_part(r.test_name, '::', -1)
    ELSE split_part(r.test_name, '.', -1) END
LEFT JOIN js ON js.repo = r.repo AND js.run_id = r.run_id""", **_BLOCK_CTES))
def failure_messages(spark, d):
    """Results with the message and stack trace from their failure blocks."""
    results = E.extract_results(C.block_lines(spark, d))
    line_no = (F.col("result_ord") % F.lit(10**10).cast("decimal(38,0)")).cast("bigint")
    return results.select("repo", "run_id", line_no.alias("line_no"), "status", "test_name",
                          "error_message", "stack_trace")


@query("last_blocks", "WIN6",
       sql_with("SELECT repo, run_id, name AS block_key, max(start) AS block_start, "
                "min(start) AS first_start FROM blocks WHERE name <> '' GROUP BY repo, run_id, name",
                **_BLOCK_CTES))
def last_blocks(spark, d):
    events = E.line_events(C.block_lines(spark, d))
    won = E.log_frameworks(events).withColumn("style", E.block_style(F.col("won")))
    return E.last_blocks(events).join(won, [*E.LOG, "style"], "left_semi").select(
        "repo", "run_id", "block_key", "block_start", "first_start"
    )


@query("jobs_of_logs", "JN1",
       sql_with("""SELECT DISTINCT repo, run_id, CASE run_id % 3 WHEN 0 THEN 'test (3.11)'
  WHEN 1 THEN 'job' ELSE 'job.txt' END AS job_name FROM log_lines"""))
def jobs_of_logs(spark, d):
    lines = C.log_lines(spark, d)
    logs = lines.select(*E.LOG).distinct()
    return E.with_run_fields(logs, C.log_runs(spark, d, lines)).select("repo", "run_id", "job_name")


@query("colour_codes_stripped", "FN1",
       """SELECT event_id, 'FAILED tests/t.py::t' || user_id AS line FROM events""")
def colour_codes_stripped(spark, d):
    from testpulse.functions import text as T

    painted = F.concat(
        F.lit("\x1b[31mFAILED\x1b[0m tests/t.py::"), F.lit("\x1b[1mt"),
        F.col("user_id").cast("string"), F.lit("\x1b[0m"),
    )
    return C.events(spark, d).select("event_id", T.strip_ansi(painted).alias("line"))


@query("log_line_explosion", "SRC4",
       sql_with(f"""SELECT {LOG}, row_number() OVER (PARTITION BY {LOG} ORDER BY line_no) - 1
  AS line_no, line FROM log_lines"""))
def log_line_explosion(spark, d):
    """Whole logs, joined with mixed line endings, split into lines again."""
    from testpulse.operators.spread import concat_in_order

    ending = (
        F.when(F.col("line_no") % 20 == 0, "")
        .when(F.col("line_no") % 3 == 0, "\r\n").when(F.col("line_no") % 3 == 1, "\n")
        .otherwise("\r")
    )
    lines = C.log_lines(spark, d).withColumn("line", F.concat(ending, "line"))
    logs = concat_in_order(lines, E.LOG, "line_no", "line", "").select(
        *E.LOG, F.lit(0).alias("entry_ord"), F.col("line").alias("content")
    )
    return E.explode_lines(logs).select(*E.LOG, "line_no", "line")
