"""The whole analysis, as named DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testpulse.functions import fixed
from testpulse.operators import classify, report, runs as R, scoring, stats as S
from testpulse.operators.extract import extract_results
from testpulse.operators.spread import prefilter
from testpulse.session import stage


@dataclass(frozen=True)
class Analysis:
    """All tables of one analysis."""

    runs: DataFrame
    results: DataFrame
    signatures: DataFrame
    stats: DataFrame
    verdicts: DataFrame
    fresh_verdicts: DataFrame | None
    responses: DataFrame | None
    quality: DataFrame
    summary: DataFrame

    def classifications(self) -> DataFrame:
        """One row per failing execution."""
        return classify.classifications(self.results, self.verdicts)

    def call_log(self) -> DataFrame | None:
        """The calls of the scorer, from the responses that the verdicts come from."""
        return None if self.responses is None else scoring.call_log(self.responses)

    def documents(self, generated: str) -> dict[str, DataFrame]:
        """Report lines by format."""
        frame = report.report_frame(self.summary, self.quality)
        return {
            "table": report.table_lines(frame, self.stats, generated),
            "markdown": report.markdown_lines(frame, self.stats, generated),
            "json": report.json_lines(
                frame, self.stats, self.signatures, self.verdicts, generated
            ),
        }


def analyze(
    runs: DataFrame,
    results: DataFrame | None = None,
    *,
    lines: DataFrame | None = None,
    archives: DataFrame | None = None,
    workflow: str | None = None,
    since: str | None = None,
    offset: int = 0,
    batch_size: int | None = None,
    scope: str = "failed_runs",
    min_sample: int = fixed.MIN_SAMPLE,
    forced: bool = False,
    limit: int = 0,
    scorer: classify.Scorer | None = None,
    provider: str = "no-llm",
    model: str = "N/A",
    cache: DataFrame | None = None,
    **extraction,
) -> Analysis:
    """Run metadata plus log lines (or ready results) to categories and totals.

    ``scope="failed_runs"`` counts only executions in failed runs, which makes
    rates higher than over ``"all_runs"``.  ``archives`` has the archive state
    per run; without it every run with a result counts as having logs.
    ``lines`` is read several times and should be a table: see
    :func:`testpulse.sources.archives.compact_logs` for zipped logs.
    """
    if scope not in ("failed_runs", "all_runs"):
        raise ValueError(f"unknown scope {scope!r}")
    if (results is None) == (lines is None):
        raise ValueError("give either results or lines")
    runs = R.since(R.of_workflow(runs, workflow), since)
    if offset or batch_size is not None:
        runs = stage(R.run_slice(runs, offset, batch_size), "runs")
    wanted = R.runs_with_logs_in_scope(runs, all_runs=scope == "all_runs").select(*R.RUN)

    if results is None:
        # Lines of other runs are mostly left out without a shuffle; the exact join is on results.
        results = extract_results(prefilter(lines, wanted, R.RUN), runs, **extraction)
    results = stage(R.in_runs(results, wanted, F.col("result_ord")), "results")

    # per test and per signature: small, and read by everything below
    sigs = stage(S.signatures(results), "signatures")
    stats = stage(S.test_stats(results, sigs), "stats")

    verdicts = classify.with_cutoff(
        classify.rule_verdicts(stats, min_sample=min_sample, forced=forced), limit
    )
    fresh = responses = None
    if scorer is not None:
        undecided = classify.ambiguous(verdicts).filter(
            classify.before_cutoff(F.col("first_ord"))
        )
        questions = scoring.prompts(undecided, stats, sigs)
        scored, fresh, responses = scoring.score(questions, scorer, provider, model, cache)
        verdicts = classify.with_scores(verdicts, scored)
    verdicts = classify.default_verdicts(verdicts, forced=forced and scorer is None)
    verdicts = stage(verdicts, "verdicts")
    stats = stage(
        classify.with_verdict_category(stats, verdicts, min_sample=min_sample, forced=forced),
        "categories",
    )

    if archives is None:
        archives = results.select(*R.RUN).distinct().withColumn("status", F.lit("ok"))
    quality = stage(R.data_quality(runs, archives), "quality")
    audit = scoring.outcome_audit(verdicts.filter(classify.before_cutoff(F.col("first_ord"))))
    return Analysis(
        runs=runs,
        results=results,
        signatures=sigs,
        stats=stats,
        verdicts=verdicts,
        fresh_verdicts=fresh,
        responses=responses,
        quality=quality,
        summary=stage(report.summary(runs, stats, audit), "summary"),
    )
