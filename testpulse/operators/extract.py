"""Test results from CI log lines of a dozen test frameworks.

Input is one row per log line.  A narrow pass turns lines into *events* (a
result line, a duration, the start or end of a failure block); nearly all
lines yield none and are gone before the first shuffle.  Which framework a log
belongs to, which block a failure has and what its message is are then
joins and aggregations over events; the lines themselves are read once more,
only for the blocks that a failing test needs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from testpulse.functions import fixed
from testpulse.functions import text as T
from testpulse.operators.spread import (
    attach_per_key,
    prefilter,
    concat_in_order,
    joined_in_order,
    next_line,
)
from testpulse.session import stage

LOG = ["repo", "run_id", "filename"]
PLACE = [*LOG, "entry_ord", "line_no"]
BLOCK_CHUNK = 4096


@dataclass(frozen=True)
class ResultRule:
    """How a line of one framework becomes a result row.

    ``priority`` orders the frameworks: a log belongs to the lowest priority
    that has a row.  ``hints`` are plain substrings, one of which every
    matching line has; they spare the pattern on almost all lines.  The groups
    number the parts of the pattern: test name, status word (none: failed) and
    an extra part, which ``shape`` puts in front of or after the name.
    """

    rule: str
    framework: str
    priority: int
    pattern: str
    hints: tuple[str, ...]
    name_group: int | None
    status_group: int | None = None
    extra_group: int | None = None
    shape: str = "plain"
    rule_ord: int = 0
    timed: bool = False


RESULT_RULES = [
    ResultRule("pytest_name_status", "pytest", 11, fixed.PYTEST_NAME_STATUS, ("::",),
               1, 2, timed=True),
    ResultRule("pytest_status_name", "pytest", 12, fixed.PYTEST_STATUS_NAME, ("::",),
               2, 1, timed=True),
    ResultRule("unittest_dots", "unittest", 21, fixed.UNITTEST_DOTS, ("...",),
               2, 3, 1, "member", timed=True),
    ResultRule("unittest_loose", "unittest", 22, fixed.UNITTEST_LOOSE, ("..",),
               2, 3, 1, "member", timed=True),
    ResultRule("jest_suite", "jest", 30, fixed.JEST_SUITE, ("FAIL", "PASS", "SKIP"),
               2, 1, shape="path", timed=True),
    ResultRule("js_generic", "jest", 30, fixed.JS_GENERIC, ("FAIL", "PASS", "SKIP", "ERROR"),
               2, 1, shape="path", rule_ord=1, timed=True),
    ResultRule("vitest", "vitest", 40, fixed.VITEST_FILE, ("✓", "✗"),
               2, 1, shape="path", timed=True),
    ResultRule("suite_word", "suite_word", 50, fixed.SUITE_WORD_FILE, ("FAIL", "PASS"),
               2, 1, shape="path", timed=True),
    ResultRule("go", "go", 60, fixed.GO_RESULT, ("--- ",), 2, 1),
    ResultRule("phpunit", "phpunit", 70, fixed.PHPUNIT_CLASS, ("Tests",), 2, 1, shape="class"),
    ResultRule("rspec", "rspec", 80, fixed.RSPEC_FAILURE, (")",), 2, shape="strip"),
    ResultRule("minitest", "minitest", 90, fixed.MINITEST_TOTALS, (" runs,",),
               None, None, 3, "totals"),
    ResultRule("mocha", "mocha", 100, fixed.MOCHA_RESULT, ("✓", "✗"), 2, 1, shape="strip"),
    ResultRule("junit", "junit", 110, fixed.JUNIT_FAILURE, ("<<<",), 2, None, 1, "member"),
    ResultRule("cypress", "cypress", 120, fixed.CYPRESS_RESULT, ("✓", "✗"), 2, 1, shape="strip"),
]
STYLE_OF = {11: "pytest", 12: "pytest", 21: "unittest", 22: "unittest", 30: "jest"}


def explode_lines(logs: DataFrame) -> DataFrame:
    """One row per line from one row per log file (any line ending)."""
    parts = F.split("content", r"\r\n|\n|\r")
    return logs.select(
        *LOG, "entry_ord", F.posexplode(parts).alias("_at", "line")
    ).select(*LOG, "entry_ord", F.col("_at").cast("bigint").alias("line_no"), "line")


def _hinted(line: Column, hints: tuple[str, ...]) -> Column:
    found = F.contains(line, F.lit(hints[0]))
    for hint in hints[1:]:
        found = found | F.contains(line, F.lit(hint))
    return found


def matches_rule(line: Column, rule: ResultRule) -> Column:
    """Does the line hold a result row under this rule?"""
    found = _hinted(line, rule.hints) & line.rlike(T.java(rule.pattern))
    if rule.rule == "js_generic":  # only where the Jest pattern did not take the line
        found = found & ~line.rlike(T.java(fixed.JEST_SUITE))
    if rule.shape == "totals":  # a row only if anything failed
        number = F.regexp_extract(line, T.java(rule.pattern), rule.extra_group)
        found = found & number.rlike("[1-9]")
    return found


@dataclass(frozen=True)
class Mark:
    """A line that starts (``opens``) or ends a failure block of one style.

    ``name`` is the pattern whose group ``name_group`` names the block.
    """

    style: str
    opens: bool
    test: Callable[[Column], Column]
    name: str = ""
    name_group: int = 0


def _has(line: Column, pattern: str, *starts: str) -> Column:
    """Pattern test, tried only on lines with one of the given beginnings."""
    found = line.rlike(T.java(pattern))
    if not starts:
        return found
    begins = F.startswith(line, F.lit(starts[0]))
    for start in starts[1:]:
        begins = begins | F.startswith(line, F.lit(start))
    return begins & found


def _jest_header(line: Column) -> Column:
    return F.contains(line, F.lit("●")) & _has(line, fixed.JEST_HEADER)


MARKS = [
    Mark("pytest", True, lambda line: _has(line, fixed.PYTEST_HEADER, "___"),
         fixed.PYTEST_HEADER, 1),
    Mark("unittest", True, lambda line: _has(line, fixed.UNITTEST_HEADER, "FAIL:", "ERROR:"),
         fixed.UNITTEST_HEADER, 2),
    Mark("unittest", False, lambda line: F.startswith(line, F.lit("Ran "))
         | _has(line, fixed.UNITTEST_RULER, "====")),
    Mark("jest", True, _jest_header, fixed.JEST_HEADER, 1),
    Mark("jest", False, lambda line: ~_jest_header(line) & (
        _has(line, fixed.JEST_TOTALS, "Test")
        | (_hinted(line, ("FAIL", "PASS", "SKIP", "ERROR"))
           & (_has(line, fixed.JEST_SUITE) | _has(line, fixed.JS_GENERIC))))),
]
DURATION = len(RESULT_RULES)
FIRST_MARK = DURATION + 1


def event_codes(line: Column, framework: str | None = None) -> Column:
    """Array with the number of every rule, duration or mark a line matches,
    null for the others."""
    codes = [
        F.when(matches_rule(line, rule), code)
        for code, rule in enumerate(RESULT_RULES)
        if framework in (None, rule.framework)
    ]
    codes.append(F.when(T.duration_in(line).isNotNull(), DURATION))
    codes += [F.when(mark.test(line), FIRST_MARK + i) for i, mark in enumerate(MARKS)]
    return F.array(*codes)


def _looked_up(of_rules: list, of_duration=None, of_marks=None) -> Column:
    """The value that belongs to ``code``."""
    values = [*of_rules, of_duration, *(of_marks or [None] * len(MARKS))]
    return F.get(F.array(*[F.lit(v) for v in values]), F.col("code"))


def _of_rule(field: str) -> Column:
    return _looked_up([getattr(r, field) for r in RESULT_RULES])


def with_event_fields(hits: DataFrame, keep: list[str]) -> DataFrame:
    """What each line means under the rule, duration or mark with number ``code``.

    Pattern and groups are looked up by ``code``, so that three extractions
    serve all rules: an expression per rule would grow into a generated method
    that the JVM does not compile.
    """
    line, code = F.col("line"), F.col("code")

    def shaped(*shapes: str) -> Column:
        return code.isin([i for i, r in enumerate(RESULT_RULES) if r.shape in shapes])

    pattern = _looked_up([T.java(r.pattern) for r in RESULT_RULES], T.java(fixed.DURATION),
                        [T.java(m.name) for m in MARKS])
    name_group = _looked_up([r.name_group for r in RESULT_RULES], None,
                           [m.name_group if m.opens else None for m in MARKS])

    def group(number: Column) -> Column:
        return F.call_function("regexp_extract", line, pattern, number.cast("int"))

    cut = hits.select(
        *keep, "code",
        group(name_group).alias("main"),
        group(_of_rule("status_group")).alias("word"),
        group(_looked_up([r.extra_group for r in RESULT_RULES], 1)).alias("extra"),
    )
    main, extra = F.col("main"), F.col("extra")
    is_result, is_mark = code < DURATION, code > DURATION
    member = shaped("member")
    named = cut.withColumn(
        "name",
        F.when(shaped("totals"), "minitest_summary")
        .when(member, F.concat(main, F.lit("."), extra))
        .when(shaped("path"), T.dotted_path(main))
        .when(shaped("class"), F.translate(main, "\\", "."))
        .when(shaped("strip") | is_mark, T.strip(F.coalesce(main, F.lit(""))))
        .otherwise(main),
    )
    name = F.col("name")
    opens = _looked_up([None] * len(RESULT_RULES), None, [m.opens for m in MARKS])
    pytest = code.isin([i for i, r in enumerate(RESULT_RULES) if r.framework == "pytest"])
    fields = {
        "kind": F.when(is_result, "result").when(is_mark, "mark").otherwise("duration"),
        "priority": _of_rule("priority"),
        "rule": _of_rule("rule"),
        "rule_ord": _of_rule("rule_ord"),
        "status": F.when(is_result, T.status_of(F.coalesce("word", F.lit("FAILED")))),
        "name": name,
        "block_key": F.when(pytest, F.substring_index(name, "::", -1))
        .when(member, extra).when(is_result, ""),
        "style": _looked_up([None] * len(RESULT_RULES), None, [m.style for m in MARKS]),
        "opens": opens & (name != ""),
        "detail": F.when(shaped("totals"), F.concat(F.ltrim(extra, F.lit("0")), F.lit(" failures")))
        .when(is_result, "").when(code == DURATION, extra),
    }
    return named.select(*keep, *[c.alias(n) for n, c in fields.items()])


def line_events(
    lines: DataFrame, *, framework: str | None = None, strip_timestamps: bool = False
) -> DataFrame:
    """Result, duration and block-mark events of log lines.

    A narrow pass over all lines keeps those that match something, with the
    number of what they match; these are written down, and fields are cut out
    of them as far as a reader asks for them.  (In one pass the two steps would
    also be one generated method, too long for the JVM to compile.)
    ``framework`` restricts result lines to one framework (for logs that an
    earlier one would claim); ``strip_timestamps`` lets failure blocks start on
    lines that carry the CI runner's timestamp.
    """
    return with_event_fields(_line_hits(lines, framework, strip_timestamps), PLACE)


def _line_hits(lines: DataFrame, framework: str | None, strip_timestamps: bool) -> DataFrame:
    """The lines that match something, once for each ``code`` of what they match, written down."""
    codes = F.explode(event_codes(F.col("line"), framework)).alias("code")
    hits = (
        clean_lines(lines, strip_timestamps)
        .select(*PLACE, "line", codes)
        .filter(F.col("code").isNotNull())
    )
    return stage(hits, "line-hits")


def clean_lines(lines: DataFrame, strip_timestamps: bool = False) -> DataFrame:
    line = T.strip_ansi(F.col("line"))
    return lines.withColumn("line", T.strip_stamp(line) if strip_timestamps else line)


def log_frameworks(events: DataFrame) -> DataFrame:
    """Per log the rule priority that wins, its number of result lines and the
    log's duration (first one in the log, where the framework reports one)."""
    rows = (
        events.filter(F.col("kind") == "result")
        .groupBy(*LOG)
        .agg(F.min("priority").alias("won"), F.count(F.lit(1)).alias("n_results"))
    )
    first = (
        events.filter(F.col("kind") == "duration")
        .groupBy(*LOG)
        .agg(F.min_by(T.seconds(F.col("detail")), "line_no").alias("duration"))
    )
    timed = F.col("won").isin(*{r.priority for r in RESULT_RULES if r.timed})
    return rows.join(first, LOG, "left").select(
        *LOG, "won", "n_results",
        F.when(timed, F.coalesce("duration", F.lit(0.0))).otherwise(F.lit(0.0)).alias("timing_seconds"),
    )


def job_of_log(filename: Column, jobs: Column) -> Column:
    """Name of the job a log file belongs to: the only job of the run, else the
    first whose name holds or is held by the file name, else the file name."""
    fits = F.filter(
        jobs, lambda job: F.contains(filename, job["name"]) | F.contains(job["name"], filename)
    )
    return F.when(F.size(jobs) == 1, F.try_element_at(jobs, F.lit(1))["name"]).otherwise(
        F.coalesce(F.try_element_at(fits, F.lit(1))["name"], filename)
    )


def _block_bounds(events: DataFrame, wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """First and last line of each wanted block.

    ``wanted`` has one row per block (log, style, block_start).  Unique keys on
    both sides of every join, so no log can pile up in one task.  Only marks of logs with a
    wanted block are looked at, and only logs whose last block is wanted are asked for
    their end, by a scan of line numbers alone.
    """
    in_logs = wanted.select(*LOG, "style").distinct()
    marks = events.filter(F.col("kind") == "mark").select(*LOG, "style", "line_no")
    marks = marks.join(in_logs, [*LOG, "style"], "left_semi")
    starts = next_line(marks, [*LOG, "style"]).withColumnRenamed("line_no", "block_start")
    bounded = stage(wanted.join(starts, [*LOG, "style", "block_start"]), "block-bounds")
    closed = bounded.filter(F.col("next_line_no").isNotNull()).select(
        *LOG, "style", "block_start", (F.col("next_line_no") - 1).alias("block_end")
    )
    last = bounded.filter(F.col("next_line_no").isNull()).select(*LOG, "style", "block_start")
    if last.isEmpty():
        return closed
    numbers = prefilter(lines.select(*LOG, "line_no"), last, LOG)
    log_end = numbers.groupBy(*LOG).agg(F.max("line_no").alias("block_end"))
    return closed.unionByName(last.join(log_end, LOG))


def _lines_in_blocks(bounds: DataFrame, lines: DataFrame) -> DataFrame:
    """(log, style, block_start, _chunk, line_no, line) of the lines behind the header of each
    block.

    A block is an interval; nothing is unrolled to line numbers.  Every chunk of lines that a
    block reaches gets one row that says which block is open there, and a running "last one
    opened" over the chunk hands it to the lines.  A log has one style, so its blocks do
    not overlap.  Only lines of such chunks are shuffled; the others are left where they are.
    """
    first, end = F.col("block_start") + 1, F.col("block_end")
    reached = F.explode(F.sequence(F.floor(first / BLOCK_CHUNK), F.floor(end / BLOCK_CHUNK)))
    opened = stage(
        bounds.filter(end >= first).select(*LOG, "style", "block_start", "block_end", reached.alias("_chunk")),
        "block-chunks",
    )
    at = F.greatest(first, F.col("_chunk") * BLOCK_CHUNK)
    headers = opened.select(
        *LOG, "_chunk", at.alias("line_no"), F.lit(None).cast("string").alias("line"),
        F.struct("style", "block_start", "block_end").alias("_opened"),
    )
    chunk = F.floor(F.col("line_no") / BLOCK_CHUNK).alias("_chunk")
    near = prefilter(lines.select(*LOG, chunk, "line_no", "line"), opened, [*LOG, "_chunk"])
    nothing = F.lit(None).cast(headers.schema["_opened"].dataType)
    # A header comes before the line at which it opens.
    along = Window.partitionBy(*LOG, "_chunk").orderBy("line_no", F.col("_opened").isNull())
    both = headers.unionByName(near.withColumn("_opened", nothing))
    inside = both.withColumn("_block", F.last("_opened", ignorenulls=True).over(along)).filter(
        F.col("_opened").isNull() & (F.col("line_no") <= F.col("_block.block_end"))
    )
    return inside.select(*LOG, "_block.style", "_block.block_start", "_chunk", "line_no", "line")


def _block_line_features(line: Column, style: Column) -> dict[str, Column]:
    """What one line contributes to the message of its block."""
    bare = T.strip(line)
    is_pytest, is_unittest, is_jest = (style == s for s in ("pytest", "unittest", "jest"))

    def starts(*prefixes):
        test = F.startswith(bare, F.lit(prefixes[0]))
        for prefix in prefixes[1:]:
            test = test | F.startswith(bare, F.lit(prefix))
        return test

    return {
        "error": F.when(
            is_pytest & F.startswith(line, F.lit("E ")), T.strip(F.substring(line, 3, 2**31 - 1))
        ),
        "location": F.when(
            is_pytest & line.rlike(T.java(fixed.SOURCE_LOCATION)),
            F.regexp_extract(line, T.java(fixed.SOURCE_LOCATION), 1),
        ),
        "last": F.when(is_unittest & (bare != "") & ~starts("Traceback", "File "), bare),
        "expect": F.when(is_jest & starts("expect"), bare),
        "plain": F.when(is_jest & (bare != "") & ~starts("at ", "> ", "File ", "|"), bare),
    }


def block_texts(events: DataFrame, wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """Message and stack trace of each wanted block, put together per chunk of lines first and
    per block second.  Jest blocks only have a message."""
    inside = _lines_in_blocks(_block_bounds(events, wanted, lines), lines)
    inside = inside.filter(
        ~((F.col("style") == "unittest") & F.startswith(F.col("line"), F.lit("---")))
    )
    features = _block_line_features(F.col("line"), F.col("style"))
    at = F.col("line_no")
    whole_line = F.struct(at.alias("at"), F.col("line").alias("text"))
    block = [*LOG, "style", "block_start"]

    def spot(name):
        return F.when(F.col(name).isNotNull(), F.struct(at.alias("at"), F.col(name).alias("text")))

    chunked = (
        inside.withColumns(features)
        .groupBy(*block, F.col("_chunk").alias("chunk"))
        .agg(
            joined_in_order(
                F.collect_list(F.when(F.col("style") != "jest", whole_line)), "\n"
            ).alias("body"),
            joined_in_order(F.collect_list(spot("error")), "\n").alias("errors"),
            F.min(spot("error")).alias("any_error"),
            F.min(spot("location")).alias("location"),
            F.max(spot("last")).alias("last"),
            F.min(spot("expect")).alias("expect"),
            F.min(spot("plain")).alias("plain"),
        )
    )

    def part(name):
        return F.struct(F.col("chunk").alias("at"), F.col(name).alias("text"))

    whole = chunked.groupBy(*block).agg(
        T.strip(joined_in_order(F.collect_list(part("body")), "\n")).alias("stack_trace"),
        joined_in_order(
            F.collect_list(F.when(F.col("any_error").isNotNull(), part("errors"))), "\n"
        ).alias("errors"),
        F.min("location")["text"].alias("location"),
        F.max("last")["text"].alias("last"),
        F.min("expect")["text"].alias("expect"),
        F.min("plain")["text"].alias("plain"),
    )
    by_style = (
        F.when(
            F.col("style") == "pytest",
            T.strip(F.coalesce(F.nullif(F.col("errors"), F.lit("")), F.col("location"))),
        )
        .when(F.col("style") == "unittest", F.col("last"))
        .otherwise(F.coalesce(F.col("expect"), F.col("plain")))
    )
    return whole.select(
        *block, "stack_trace", F.coalesce(by_style, F.lit("")).alias("error_message")
    )


def last_blocks(events: DataFrame) -> DataFrame:
    """Blocks by name: the last start wins, the first keeps the position."""
    opening = events.filter((F.col("kind") == "mark") & F.col("opens"))
    return opening.groupBy(*LOG, "style", F.col("name").alias("block_key")).agg(
        F.max("line_no").alias("block_start"), F.min("line_no").alias("first_start")
    )


def block_style(won: Column) -> Column:
    """Block style of the framework a log belongs to; null without blocks."""
    pairs = [F.lit(part) for pair in STYLE_OF.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), won)


def failure_texts(events: DataFrame, failing: DataFrame, lines: DataFrame) -> DataFrame:
    """Message and stack trace for every (log, block_key) of a failing row, with
    ``n_failing``, the number of failing rows that take it; empty if no block.

    A failed JS suite has no block of its own: it takes the messages of all
    individual failures in its log.
    """
    wanted = stage(
        failing.groupBy(*LOG, "style", "block_key").agg(F.count(F.lit(1)).alias("n_failing")),
        "wanted-blocks",
    )
    taken_by = F.when(F.col("style") == "jest", "").otherwise(F.col("block_key"))
    named = last_blocks(events).withColumn("_taken_by", taken_by)
    takers = wanted.select(*LOG, "style", F.col("block_key").alias("_taken_by"))
    columns = [*LOG, "style", "block_key", "block_start", "first_start"]
    blocks = stage(named.join(takers, [*LOG, "style", "_taken_by"]).select(columns), "blocks")

    if blocks.isEmpty():
        nothing = {"error_message": F.lit(""), "stack_trace": F.lit("")}
        return wanted.withColumns(nothing)
    texts = block_texts(events, blocks.select(*LOG, "style", "block_start"), lines)
    known = stage(blocks.join(texts, [*LOG, "style", "block_start"], "left").fillna(
        "", ["error_message", "stack_trace"]
    ), "block-texts")
    per_test = known.filter(F.col("style") != "jest").select(
        *LOG, "style", "block_key", "error_message", "stack_trace"
    )
    labelled = known.filter(F.col("style") == "jest").select(
        *LOG, "first_start",
        F.when(F.col("error_message") == "", F.col("block_key"))
        .otherwise(F.concat("block_key", F.lit(": "), "error_message"))
        .alias("error_message"),
    )
    per_log = concat_in_order(labelled, LOG, "first_start", "error_message", "; ").select(
        *LOG, F.lit("jest").alias("style"), F.lit("").alias("block_key"), "error_message",
        F.lit("").alias("stack_trace"),
    )
    found = per_test.unionByName(per_log)
    return wanted.join(found, [*LOG, "style", "block_key"], "left").fillna(
        "", ["error_message", "stack_trace"]
    )


def extract_results(
    lines: DataFrame,
    runs: DataFrame | None = None,
    *,
    framework: str | None = None,
    strip_timestamps: bool = False,
    newest_first: bool = False,
) -> DataFrame:
    """One row per test execution found in log lines.

    ``runs`` adds workflow, job and time of the run.  ``result_ord`` orders the
    executions, see :func:`result_order`.  Matching lines, result lines and block
    texts are small next to the logs and read several times, so each is written
    down once; the logs are read for matching lines and, where a test failed,
    for its block.  Fields of result lines are cut out only where the framework has won
    its log, and log by log: one pattern follows itself and is seldom compiled anew.
    """
    if framework is not None and framework not in {r.framework for r in RESULT_RULES}:
        raise ValueError(f"unknown framework {framework!r}")
    hits = _line_hits(lines, framework, strip_timestamps)
    events = with_event_fields(hits, PLACE)
    logs = stage(with_run_fields(log_frameworks(events), runs), "logs")
    found = attach_per_key(
        hits.filter(F.col("code") < DURATION), logs, LOG, "n_results", F.col("line_no")
    ).filter(_of_rule("priority") == F.col("won"))
    of_log = [c for c in logs.columns if c not in LOG]
    rows = with_event_fields(found, [*PLACE, *of_log]).drop("kind", "opens")
    rows = stage(rows.withColumn("style", block_style(F.col("won"))), "result-lines")
    has_block = T.is_failing(F.col("status")) & F.col("style").isNotNull()
    failing = rows.filter(has_block)
    texts = failure_texts(events, failing, clean_lines(lines, strip_timestamps))
    texts = stage(texts, "failure-texts")
    explained = attach_per_key(
        failing, texts, [*LOG, "style", "block_key"], "n_failing", F.col("line_no")
    ).drop("n_failing")
    others = rows.filter(~F.coalesce(has_block, F.lit(False))).withColumns(
        {"error_message": F.col("detail"), "stack_trace": F.lit("")}
    )
    together = explained.unionByName(others)

    return together.select(
        "repo", "run_id",
        result_order(newest_first).alias("result_ord"),
        F.col("name").alias("test_name"), "status", "error_message", "stack_trace",
        "timing_seconds", "workflow_name", "job_name", "timestamp", "filename", "rule",
    )


def result_order(newest_first: bool = False) -> Column:
    """Order of an execution among all of its repo, as one number of 38 digits:
    21 for the run, 6 for the file in the archive, 1 for the rule, 10 for the line.

    A number has a fixed width, so its minimum is kept by a hash aggregation; a
    struct or text would make Spark sort all executions first.  By default
    runs count in the text order of their id ("10" before "9").
    """
    run_text = F.col("run_id").cast("string")
    if newest_first:
        run = F.lpad((F.lit(10**18) - F.unix_micros(F.col("timestamp").cast("timestamp"))).cast("string"), 21, "0")
    else:
        run = F.concat(
            F.rpad(run_text, 19, "0"), F.lpad(F.length(run_text).cast("string"), 2, "0")
        )
    digits = F.concat(
        run,
        F.lpad(F.col("entry_ord").cast("string"), 6, "0"),
        F.col("rule_ord").cast("string"),
        F.lpad(F.col("line_no").cast("string"), 10, "0"),
    )
    fits = (F.col("entry_ord") < 10**6) & (F.col("line_no") < 10**10) & (F.col("run_id") >= 0)
    return F.when(fits, digits.cast("decimal(38,0)")).otherwise(
        F.raise_error(F.lit("entry, line or run number out of range"))
    )


def with_run_fields(logs: DataFrame, runs: DataFrame | None) -> DataFrame:
    """Add workflow, job name and time of the run to one row per log."""
    if runs is None:
        return logs.withColumns({
            "workflow_name": F.lit(""),
            "job_name": F.col("filename"),
            "timestamp": F.lit(None).cast("timestamp"),
        })
    fields = runs.select("repo", "run_id", "workflow_name", "timestamp", "jobs")
    no_jobs = F.array().cast(fields.schema["jobs"].dataType)
    job_name = job_of_log(F.col("filename"), F.coalesce("jobs", no_jobs))
    return (
        logs.join(fields, ["repo", "run_id"], "left")
        .withColumn("job_name", job_name)
        .drop("jobs")
    )


def unmatched_logs(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Logs in which no rule found a result."""
    matched = events.filter(F.col("kind") == "result").select(*LOG).distinct()
    return lines.select(*LOG).distinct().join(matched, LOG, "left_anti")
