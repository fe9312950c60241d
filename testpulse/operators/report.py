"""Health reports as tables of lines.

A report is never one big string: it is rows whose lines, in the order of
``ORDER``, are the document.  A repo with very many failing tests gives very
many rows, not a huge cell; the sort that writes them is range-partitioned.

Sections: 0 is the head, 10 the tail; 2, 4, 6, 8 open the categories, 3, 5, 7,
9 hold their tests in order of first appearance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testpulse.functions import fixed
from testpulse.functions import text as T
from testpulse.operators.runs import pass_rates
from testpulse.operators.spread import attach_per_key
from testpulse.operators.stats import TEST

AUDIT = [
    "llm_call_count", "llm_truncated_count", "llm_parse_error_count", "llm_fallback_count",
]
ORDER = ["repo", "section", "place", "part", "minus_count", "sub_place"]
COLUMNS = [*ORDER, "line"]


def summary(runs: DataFrame, stats: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """One row of totals per repo."""
    def n(category: str) -> Column:
        return F.count_if(F.col("final_category") == category)

    tests = stats.groupBy("repo").agg(
        F.sum("total_failures").alias("total_failures"),
        F.count(F.lit(1)).alias("total_tests_analyzed"),
        n("FLAKY").alias("flaky_count"),
        n("REAL_BUG").alias("real_bug_count"),
        n("INFRA").alias("infra_count"),
        n("INSUFFICIENT_DATA").alias("insufficient_data_count"),
        F.avg(F.when(F.col("final_category") == "FLAKY", F.col("flake_rate"))).alias(
            "avg_flake_rate"
        ),
    )
    joined = pass_rates(runs).join(tests, "repo", "left")
    if audit is not None:
        joined = joined.join(audit.select("repo", *AUDIT), "repo", "left")
    else:
        joined = joined.withColumns({c: F.lit(0).cast("bigint") for c in AUDIT})
    counts = [
        "total_failures", "total_tests_analyzed", "flaky_count", "real_bug_count",
        "infra_count", "insufficient_data_count", *AUDIT,
    ]
    return joined.fillna(0, counts).fillna(0.0, ["avg_flake_rate"]).select(
        "repo", "total_runs", *counts[:6], "overall_pass_rate", "avg_flake_rate", *AUDIT
    )


def degraded() -> Column:
    return (
        F.col("llm_truncated_count") + F.col("llm_parse_error_count")
        + F.col("llm_fallback_count")
    )


def clean_message(total_runs: Column, n_workflows: Column) -> Column:
    plural = F.when(n_workflows != 1, "s").otherwise("")
    return F.concat(
        F.lit("No failures in "), total_runs.cast("string"), F.lit(" runs across "),
        n_workflows.cast("string"), F.lit(" workflow"), plural, F.lit(". CI health: clean."),
    )


def clean_repos(totals: DataFrame, quality: DataFrame) -> DataFrame:
    """Repos without failures and the message their report consists of."""
    return (
        totals.filter(F.col("total_failures") == 0)
        .join(quality.select("repo", "workflows_analyzed"), "repo")
        .select(
            "repo", "total_runs", "overall_pass_rate",
            clean_message(F.col("total_runs"), F.size("workflows_analyzed")).alias("message"),
        )
    )


def batch_summary(
    totals: DataFrame,
    quality: DataFrame,
    *,
    provider: str = "no-llm",
    model: str = "N/A",
    offset: int = 0,
    size: int | None = None,
    output: str = "runs",
) -> DataFrame:
    """One row per repo and batch, for comparing providers and batches."""
    label = T.batch_label(F.lit(offset), F.lit(size).cast("int"))
    return totals.join(quality.select("repo", "runs_with_failures"), "repo").select(
        "repo",
        F.lit(provider).alias("provider"),
        F.lit(model).alias("model"),
        label.alias("batch"),
        F.lit(offset).alias("offset"),
        F.lit(size).cast("int").alias("batch_size"),
        F.col("total_runs").alias("runs_analyzed"),
        "runs_with_failures",
        "flaky_count", "real_bug_count", "infra_count", "insufficient_data_count",
        "overall_pass_rate", "avg_flake_rate", *AUDIT,
        F.concat_ws("/", F.lit(output), T.repo_slug(F.col("repo")), F.lit(provider), label).alias(
            "output_dir"
        ),
    )


def report_frame(totals: DataFrame, quality: DataFrame) -> DataFrame:
    """What the fixed lines of a report need: one row per repo."""
    shared = [c for c in quality.columns if c != "repo"]
    return totals.join(quality.select("repo", *shared), "repo")


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _section_of(category: Column, step: int) -> Column:
    number = F.lit(None).cast("int")
    for index, name in enumerate(fixed.SECTION_TITLES):
        number = F.when(category == name, 2 + 2 * index + step).otherwise(number)
    return number


def _fixed_lines(frame: DataFrame, blocks: dict[int, list], place_type) -> DataFrame:
    """Rows for the lines that exist once per repo; null lines are left out."""
    items = []
    for section, lines in blocks.items():
        for part, line in enumerate(lines):
            line = line if isinstance(line, Column) else F.lit(line)
            items.append(
                F.struct(
                    F.lit(section).alias("section"), F.lit(part).alias("part"), line.alias("line")
                )
            )
    rows = frame.select("repo", F.explode(F.array(*items)).alias("l"))
    nothing = F.lit(None).cast(place_type)
    return rows.select(
        "repo", "l.section", nothing.alias("place"), "l.part",
        F.lit(0).cast("bigint").alias("minus_count"), nothing.alias("sub_place"), "l.line",
    ).filter(F.col("line").isNotNull())


def _test_lines(tests: DataFrame, line: Column, place_type, part: int = 0) -> DataFrame:
    return tests.select(
        "repo", _section_of(F.col("final_category"), 1).alias("section"),
        F.col("first_ord").alias("place"), F.lit(part).alias("part"),
        F.lit(0).cast("bigint").alias("minus_count"),
        F.lit(None).cast(place_type).alias("sub_place"), line.alias("line"),
    )


def _only_when(condition: Column, lines: list) -> list:
    return [F.when(condition, line) for line in lines]


def _counts_of(category: str) -> Column:
    return F.col(category.lower() + "_count")


def table_lines(frame: DataFrame, stats: DataFrame, generated: str) -> DataFrame:
    """The plain-text report."""
    place_type = stats.schema["first_ord"].dataType
    clean = F.col("total_failures") == 0
    calls = F.col("llm_call_count")
    blocks: dict[int, list] = {
        0: [
            _text("=== CI Health Report: ", F.col("repo"), " ==="),
            f"Generated: {generated}",
            "",
            F.when(clean, clean_message(F.col("total_runs"), F.size("workflows_analyzed"))),
            *_only_when(~clean, [
                "Summary:",
                _text("  Total runs: ", F.col("total_runs")),
                _text("  Total failures: ", F.col("total_failures")),
                _text("  Tests analyzed: ", F.col("total_tests_analyzed")),
                _text("  Flaky: ", F.col("flaky_count"), " | Real bugs: ",
                      F.col("real_bug_count"), " | Infra: ", F.col("infra_count"),
                      " | Insufficient data: ", F.col("insufficient_data_count")),
                _text("  Pass rate: ", T.percent(F.col("overall_pass_rate"), 1)),
                F.when(calls > 0, _text(
                    "  LLM calls: ", calls, " (degraded: ", degraded(), " — truncated ",
                    F.col("llm_truncated_count"), ", parse-error ",
                    F.col("llm_parse_error_count"), ", fallback ",
                    F.col("llm_fallback_count"), ")")),
                "",
            ]),
        ],
        10: _only_when(~clean, [
            "Data Quality:",
            _text("  Runs requested: ", F.col("runs_requested")),
            _text("  Runs fetched: ", F.col("runs_fetched")),
            _text("  Effective sample: ", F.col("effective_sample")),
            _text("  Skipped (expired): ", F.col("runs_skipped_expired")),
            _text("  Skipped (error): ", F.col("runs_skipped_error")),
        ]),
    }
    for index, (category, title) in enumerate(fixed.SECTION_TITLES.items()):
        some = _counts_of(category) > 0
        blocks[2 + 2 * index] = [F.when(~clean, F.when(some, f"  {title}:").otherwise(""))]
    line = _text(
        "    ", F.col("test_name"), " — ", T.fixed_point(F.col("flake_rate"), 1),
        "% flake rate, ", F.col("n_signatures"), " sig(s), last: ",
        T.iso_date(F.col("last_seen_run")),
    )
    return _fixed_lines(frame, blocks, place_type).unionByName(
        _test_lines(_reported(stats, frame), line, place_type)
    )


def markdown_lines(frame: DataFrame, stats: DataFrame, generated: str) -> DataFrame:
    """The Markdown report."""
    place_type = stats.schema["first_ord"].dataType
    clean = F.col("total_failures") == 0
    calls = F.col("llm_call_count")

    def row(name, value):
        return _text(f"| {name} | ", value, " |")

    blocks: dict[int, list] = {
        0: [
            _text("# CI Health Report: ", F.col("repo")),
            "",
            f"**Generated:** {generated}",
            "",
            F.when(clean, clean_message(F.col("total_runs"), F.size("workflows_analyzed"))),
            F.when(clean, ""),
            *_only_when(~clean, [
                "## Summary",
                "| Metric | Value |",
                "|---|---|",
                row("Total runs", F.col("total_runs")),
                row("Total failures", F.col("total_failures")),
                row("Tests analyzed", F.col("total_tests_analyzed")),
                row("Flaky", F.col("flaky_count")),
                row("Real bugs", F.col("real_bug_count")),
                row("Infra", F.col("infra_count")),
                row("Insufficient data", F.col("insufficient_data_count")),
                row("Pass rate", T.percent(F.col("overall_pass_rate"), 1)),
                F.when(calls > 0, row("LLM calls", calls)),
                F.when(calls > 0, _text(
                    "| LLM degraded | ", degraded(), " (truncated ",
                    F.col("llm_truncated_count"), ", parse-error ",
                    F.col("llm_parse_error_count"), ", fallback ",
                    F.col("llm_fallback_count"), ") |")),
                "",
            ]),
        ],
        10: [
            F.when(~clean, ""),
            "## Data Quality",
            "| Metric | Value |",
            "|---|---|",
            row("Runs requested", F.col("runs_requested")),
            row("Runs fetched", F.col("runs_fetched")),
            *_only_when(~clean, [
                row("Runs with logs", F.col("runs_with_logs")),
                row("Effective sample", F.col("effective_sample")),
                row("Skipped (expired)", F.col("runs_skipped_expired")),
                row("Skipped (error)", F.col("runs_skipped_error")),
            ]),
        ],
    }
    for index, (category, title) in enumerate(fixed.SECTION_TITLES.items()):
        some = ~clean & (_counts_of(category) > 0)
        blocks[2 + 2 * index] = [
            F.when(~clean, F.when(_counts_of(category) > 0, f"## {title}").otherwise("")),
            *_only_when(some, [
                "",
                "| Test | Flake Rate | Signatures | Dominant Error | Last Seen |",
                "|---|---|---|---|---|",
            ]),
        ]
    line = _text(
        "| ", F.col("test_name"), " | ", T.fixed_point(F.col("flake_rate"), 1), "% | ",
        F.col("n_signatures"), " | ",
        F.coalesce("dominant_signature", F.lit("—")), " | ",
        T.iso_date(F.col("last_seen_run")), " |",
    )
    return _fixed_lines(frame, blocks, place_type).unionByName(
        _test_lines(_reported(stats, frame), line, place_type)
    )


def _reported(stats: DataFrame, frame: DataFrame) -> DataFrame:
    """Tests of repos that have a failure; the others get the clean message."""
    sizes = frame.select(
        "repo", "total_tests_analyzed", F.col("total_failures").alias("repo_failures")
    )
    tests = attach_per_key(stats, sizes, ["repo"], "total_tests_analyzed", F.col("test_name"))
    return tests.filter(F.col("repo_failures") > 0).drop("total_tests_analyzed", "repo_failures")


def _json_text(column: Column) -> Column:
    """A text as a JSON string, null as null."""
    quoted = F.to_json(F.struct(column.alias("v")))
    return F.when(column.isNull(), "null").otherwise(
        F.substring(quoted, 6, F.length(quoted) - 6)
    )


def _json_record(fields: dict[str, Column]) -> Column:
    """The inside of a JSON object: ``"name": value`` pairs."""
    record = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]),
                       {"ignoreNullFields": "false"})
    return F.substring(record, 2, F.length(record) - 2)


def json_lines(
    frame: DataFrame, stats: DataFrame, sigs: DataFrame, verdicts: DataFrame, generated: str
) -> DataFrame:
    """The nested JSON report; all lines of a repo, in order, are one document.

    A test opens on one line, then has one line per signature, most frequent
    first, then closes.  Its classifications are equal, so they are given once
    with their number.
    """
    place_type = stats.schema["first_ord"].dataType
    failed = F.col("total_failures") > 0
    quality = {
        name: F.col(name)
        for name in ("runs_requested", "runs_fetched", "runs_with_failures", "runs_with_logs",
                     "runs_skipped_expired", "runs_skipped_error", "effective_sample",
                     "workflows_analyzed")
    }
    totals = {
        name: F.col(name)
        for name in ("total_runs", "total_failures", "total_tests_analyzed", "flaky_count",
                     "real_bug_count", "infra_count", "insufficient_data_count",
                     "overall_pass_rate", "avg_flake_rate", *AUDIT)
    }
    keys = list(fixed.SECTION_KEYS.values())
    blocks: dict[int, list] = {
        0: [
            _text('{"repo":', _json_text(F.col("repo")), f',"timestamp":"{generated}",'),
            _text('"data_quality":{', _json_record(quality), "},"),
            _text('"summary":{', _json_record(totals), "},"),
        ],
        2: [f'"{keys[0]}":['],
        10: ["]}"],
    }
    for index, key in enumerate(keys[1:], start=1):
        blocks[2 + 2 * index] = [f'],"{key}":[']

    # the first test of a section has no comma before it
    leaders = stats.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_tests"),
        *[
            F.min(F.when(F.col("final_category") == c, F.col("first_ord"))).alias("lead_" + c)
            for c in fixed.SECTION_TITLES
        ],
    )
    frame_sizes = frame.select("repo", "total_failures")
    leaders = leaders.join(
        frame_sizes.withColumnRenamed("total_failures", "repo_failures"), "repo"
    )
    tests = attach_per_key(stats, leaders, ["repo"], "n_tests", F.col("test_name")).filter(
        F.col("repo_failures") > 0
    )
    given = verdicts.select(
        *TEST, F.col("run_id").alias("verdict_run"), "category", "evidence", "confidence",
        "classified_by", F.col("total_failures").alias("n_verdicts"),
    )
    tests = tests.join(given, TEST, "left")
    leads = F.lit(None).cast(place_type)
    for category in fixed.SECTION_TITLES:
        leads = F.when(
            F.col("final_category") == category, F.col("lead_" + category)
        ).otherwise(leads)
    comma = F.when(F.col("first_ord") == leads, "").otherwise(",")
    opening = _text(
        comma, "{",
        _json_record({n: F.col(n) for n in ("test_name", "total_executions", "total_failures",
                                            "flake_rate", "failure_rate")}),
        ',"error_signatures":[',
    )
    classified = F.when(
        F.col("category").isNull(), F.lit("[]")
    ).otherwise(_text("[{", _json_record({
        "test_name": F.col("test_name"), "run_id": F.col("verdict_run"),
        "category": F.col("category"), "evidence": F.col("evidence"),
        "confidence": F.col("confidence"), "classified_by": F.col("classified_by"),
        "count": F.col("n_verdicts"),
    }), "}]"))
    closing = _text(
        "],",
        _json_record({n: F.col(n) for n in ("dominant_signature", "dominant_signature_ratio")}),
        ',"classifications":', classified, ",",
        _json_record({
            "final_category": F.col("final_category"),
            "first_seen_run": T.iso_time(F.col("first_seen_run")),
            "last_seen_run": T.iso_time(F.col("last_seen_run")),
            "workflows_affected": F.col("workflows_affected"),
        }),
        "}",
    )
    owners = tests.filter(F.col("n_signatures") > 0).select(
        *TEST, "final_category", "first_ord", "n_signatures", "dominant_signature"
    )
    owned = attach_per_key(sigs, owners, TEST, "n_signatures", F.col("signature_hash"))
    sig_line = _text(
        F.when(F.col("signature_hash") == F.col("dominant_signature"), "").otherwise(","), "{",
        _json_record({
            "signature_hash": F.col("signature_hash"),
            "sample_message": F.col("sample_message"),
            "count": F.col("count"),
            "first_seen": T.iso_time(F.col("first_seen")),
            "last_seen": T.iso_time(F.col("last_seen")),
        }),
        "}",
    )
    sig_lines = owned.select(
        "repo", _section_of(F.col("final_category"), 1).alias("section"),
        F.col("first_ord").alias("place"), F.lit(1).alias("part"),
        (-F.col("count")).alias("minus_count"),
        F.col("first.result_ord").alias("sub_place"), sig_line.alias("line"),
    )
    return (
        _fixed_lines(frame, blocks, place_type)
        .unionByName(_test_lines(tests, opening, place_type, part=0))
        .unionByName(sig_lines)
        .unionByName(_test_lines(tests, closing, place_type, part=2))
    )


def in_order(lines: DataFrame) -> DataFrame:
    """Lines sorted into documents, repo by repo."""
    return lines.select(*COLUMNS).orderBy(*[F.col(c).asc_nulls_first() for c in ORDER])
