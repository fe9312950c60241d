"""Query registry and the common parts of the checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from testpulse.functions import fixed
from testpulse.plans import ci_tables as C


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query under ``name``; ``covers`` lists SURVEY ids."""

    def register(function):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(function, sql, tuple(covers.split()))
        return function

    return register


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def sql_strip(text: str) -> str:
    return f"trim({text}, {BLANKS})"


def sql_normalize(text: str) -> str:
    for pattern, token in fixed.ERROR_REWRITES:
        text = f"regexp_replace({text}, '{pattern}', '{token}', 'g')"
    return sql_strip(text)


def sql_signature(text: str) -> str:
    return f"substr(sha256({sql_normalize(text)}), 1, 16)"


def sql_infra(haystack: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({haystack}, '(?i){p}') THEN '{p}'" for p in fixed.INFRA_PATTERNS
    )
    return f"CASE {cases} END"


def sql_percent(fraction: str, places: int = 0) -> str:
    return f"printf('%.{places}f', {fraction} * 100) || '%'"


_CTES = {
    "results": C.duck(C.RESULTS),
    "runs": C.duck(C.RUNS, results="results"),
    "failing": "SELECT * FROM results WHERE status IN ('FAILED', 'ERROR')",
    "signed": f"SELECT *, {sql_signature('error_message')} AS signature_hash FROM failing",
    "sigs": """
        SELECT repo, test_name, signature_hash, count(*) AS count,
          min(timestamp) AS first_seen, max(timestamp) AS last_seen,
          min(result_ord) AS first_ord,
          coalesce(nullif(arg_min(error_message, result_ord), ''), '(no error message)')
            AS sample_message
        FROM signed GROUP BY repo, test_name, signature_hash""",
    "ranked": """
        SELECT *, row_number() OVER (PARTITION BY repo, test_name
          ORDER BY count DESC, first_ord) AS place FROM sigs""",
    "execs": """
        SELECT repo, test_name, count(*) AS total_executions,
          count(*) FILTER (status IN ('FAILED', 'ERROR')) AS total_failures,
          min(timestamp) AS first_seen_run, max(timestamp) AS last_seen_run,
          min(result_ord) AS first_ord,
          string_agg(DISTINCT workflow_name, ',' ORDER BY workflow_name) AS workflows
        FROM results GROUP BY repo, test_name""",
    "first_failures": """
        SELECT repo, test_name, min(result_ord) AS fail_ord, arg_min(run_id, result_ord) AS run_id,
          arg_min(error_message, result_ord) AS error_message,
          arg_min(stack_trace, result_ord) AS stack_trace
        FROM failing GROUP BY repo, test_name""",
    "stats": """
        SELECT e.*, total_failures / total_executions * 100 AS flake_rate,
          total_failures / total_executions AS failure_rate,
          coalesce(g.n, 0) AS n_signatures,
          r.signature_hash AS dominant_signature,
          coalesce(r.count / total_failures, 0.0) AS dominant_signature_ratio,
          f.fail_ord, f.run_id, f.error_message, f.stack_trace
        FROM execs e
        LEFT JOIN (SELECT repo, test_name, count(*) AS n FROM sigs GROUP BY ALL) g
          USING (repo, test_name)
        LEFT JOIN (SELECT * EXCLUDE (first_ord) FROM ranked WHERE place = 1) r
          USING (repo, test_name)
        LEFT JOIN first_failures f USING (repo, test_name)""",
    "ruled": f"""
        SELECT *, {sql_infra("error_message || chr(10) || stack_trace")} AS infra
        FROM stats WHERE fail_ord IS NOT NULL""",
    "decided": """
        SELECT *, CASE WHEN infra IS NOT NULL THEN 'infra'
          WHEN total_executions < 50 THEN 'insufficient'
          WHEN dominant_signature_ratio >= 0.9 AND failure_rate > 0.5 THEN 'real_bug'
          WHEN n_signatures > 1 AND failure_rate < 0.5 THEN 'flaky'
          ELSE 'default' END AS rule FROM ruled""",
    "verdicts": f"""
        SELECT repo, test_name, run_id, fail_ord, total_failures, rule,
          CASE rule WHEN 'infra' THEN 'INFRA' WHEN 'insufficient' THEN 'INSUFFICIENT_DATA'
            WHEN 'real_bug' THEN 'REAL_BUG' ELSE 'FLAKY' END AS category,
          CASE rule WHEN 'infra' THEN 'Infra pattern detected: ' || infra
            WHEN 'insufficient' THEN 'Only ' || total_executions || ' executions (< 50 minimum)'
            WHEN 'real_bug' THEN 'Dominant signature ' || dominant_signature || ' in '
              || {sql_percent('dominant_signature_ratio')} || ' of failures, failure rate '
              || {sql_percent('failure_rate')}
            WHEN 'flaky' THEN n_signatures || ' distinct error signatures, failure rate '
              || {sql_percent('failure_rate')}
            ELSE '{fixed.AMBIGUOUS_EVIDENCE}' END AS evidence,
          CASE rule WHEN 'infra' THEN 0.9 WHEN 'insufficient' THEN 1.0 WHEN 'real_bug' THEN 0.85
            WHEN 'flaky' THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence,
          'rules' AS classified_by FROM decided""",
    "final": """
        SELECT s.*, CASE WHEN total_executions < 50 THEN 'INSUFFICIENT_DATA'
          ELSE coalesce(v.category, 'FLAKY') END AS final_category
        FROM stats s LEFT JOIN (SELECT repo, test_name, category FROM verdicts) v
          USING (repo, test_name)""",
    "responses": C.duck(C.RESPONSES),
    "log_lines": C.duck(C.LOG_LINES),
    "block_lines": C.duck(C.BLOCK_LINES),
}


def sql_with(body: str, **more: str) -> str:
    """``body`` with all common table expressions in front of it."""
    ctes = _CTES | more
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in ctes.items()) + "\n" + body
