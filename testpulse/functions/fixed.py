"""Fixed values that decide results.

Everything in this module is a value, not logic: the rewrite list, the infra
patterns, the log-line patterns, the status words, thresholds and message
texts.  They must stay exactly as they are for results to be comparable, so
they are written out plainly, in order, in one place.
"""

# --- fixed values: error text rewrites, applied in this order ---------------
ERROR_REWRITES = [
    (r"/Users/[^/\s]+/", "<PATH>/"),
    (r"/home/[^/\s]+/", "<PATH>/"),
    (r"/tmp/[^/\s]+/", "<PATH>/"),
    (r"/runner/[^/\s]+/", "<PATH>/"),
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "<TIMESTAMP>"),
    (r"\d{10,13}", "<TIMESTAMP>"),
    (r":\d+:", ":<LINE>:"),
    (r"0x[0-9a-fA-F]+", "<ADDR>"),
    (r"pid\s*\d+", "pid <PID>"),
    (r"port\s*\d+", "port <PORT>"),
]

# --- fixed values: infra patterns, case-insensitive, first match wins -------
INFRA_PATTERNS = [
    r"timeout",
    r"timed?\s*out",
    r"out\s+of\s+memory",
    r"OOM",
    r"OOMKilled",
    r"killed",
    r"SIGKILL",
    r"SIGTERM",
    r"runner",
    r"self-hosted",
    r"network",
    r"connection\s+refused",
    r"ETIMEDOUT",
    r"ECONNRESET",
    r"ECONNREFUSED",
    r"ENOTFOUND",
    r"503",
    r"502",
    r"504",
]

# --- fixed values: terminal colour codes ------------------------------------
ANSI = r"\x1b\[[0-9;]*[a-zA-Z]"

# --- fixed values: log line patterns (matched against one line) -------------
# Every result-line pattern allows the CI runner's timestamp prefix.
STAMP = r"(?:\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z\s+)?"

PYTEST_NAME_STATUS = rf"^{STAMP}(\S+::\S+)\s+(FAILED|ERROR|PASSED|SKIPPED)\s*$"
PYTEST_STATUS_NAME = rf"^{STAMP}(FAILED|ERROR)\s+(\S+::\S+)\s*-?\s*"
UNITTEST_DOTS = rf"^{STAMP}(\S+)\s+\((\S+)\)\s+\.\.\.\s+(FAIL|ERROR|ok|skip)$"
UNITTEST_LOOSE = rf"^{STAMP}(\S+)\s+\(([^)]+)\)\s+\.{{2,}}\s*(FAIL|ERROR|ok|skip)\s*$"
JEST_SUITE = rf"^{STAMP}(FAIL|PASS|SKIP)\s+(\S+\.(?:test|spec|e2e|unit)\.(?:[jt]sx?|mjs|cjs))"
JS_GENERIC = (
    rf"^{STAMP}(FAIL|PASS|ERROR|SKIP)\s+((?:__tests__/\S+|\S+__tests__\S+|"
    r"\S+\.(?:test|spec|e2e|unit|integ)\.(?:[jt]sx?|mjs|cjs)))"
)
VITEST_FILE = rf"^{STAMP}([✓✗])\s+\S+\s+(\S+__tests__\S+\.spec\.\S+)"
SUITE_WORD_FILE = rf"^{STAMP}(FAIL|PASS)\s+\w+\s+(\S+\.(?:test|spec)\.(?:[jt]sx?))"
GO_RESULT = rf"^{STAMP}--- (PASS|FAIL):\s+(\S+)"
PHPUNIT_CLASS = rf"^{STAMP}(PASS|FAIL)\s+(Tests[A-Za-z0-9_\\\.]+)"
RSPEC_FAILURE = rf"^{STAMP}(\d+)\)\s+(.+?)(?:\s+FAILED)?$"
MINITEST_TOTALS = rf"^{STAMP}(\d+) runs,\s+(\d+) assertions,\s+(\d+) failures"
MOCHA_RESULT = rf"^{STAMP}\s*([✓✗])\s+(.+)$"
JUNIT_FAILURE = (
    rf"^{STAMP}(\S+)\((\S+)\)\s+Time elapsed:\s+[\d.]+\s*s\s+<<<\s+(FAILURE|ERROR)!"
)
CYPRESS_RESULT = rf"^{STAMP}\s*([✓✗])\s+(.+?)\s+\(\d+ms\)$"

DURATION = r"in\s+([\d.]+)s"

PYTEST_HEADER = r"^_{3,}\s*(.+?)\s*_{3,}\s*$"
UNITTEST_HEADER = r"^(FAIL|ERROR):\s+(\S+)\s*\((\S+)\)"
UNITTEST_RULER = r"^={60,}"
JEST_HEADER = r"^\s{2}●\s+(.+)$"
JEST_TOTALS = r"^(Tests:|Test Suites:)"
SOURCE_LOCATION = r"^[\w./]+:\d+:\s+(.+)$"

# --- fixed values: status words of all frameworks ---------------------------
STATUS_WORDS = {
    "FAILED": "FAILED",
    "ERROR": "ERROR",
    "PASSED": "PASSED",
    "SKIPPED": "SKIPPED",
    "PASS": "PASSED",
    "FAIL": "FAILED",
    "SKIP": "SKIPPED",
    "OK": "PASSED",
    "ok": "PASSED",
    "skip": "SKIPPED",
    "✓": "PASSED",
    "✗": "FAILED",
}
FAILING = ("FAILED", "ERROR")

# --- fixed values: categories, vote tie-break weights, thresholds -----------
CATEGORIES = ("FLAKY", "INFRA", "REAL_BUG", "INSUFFICIENT_DATA")
VOTE_WEIGHT = {"FLAKY": 3, "INFRA": 2, "REAL_BUG": 1, "INSUFFICIENT_DATA": 0}
MIN_SAMPLE = 50
DOMINANT_RATIO = 0.9
HALF = 0.5

# --- fixed values: evidence texts -------------------------------------------
AMBIGUOUS_EVIDENCE = "Ambiguous classification, no LLM available for fallback"
FORCED_EVIDENCE = "force_llm enabled but no LLM adapter available"
NO_CHOICE_EVIDENCE = "LLM response had no parseable choice; defaulted to flaky"
BAD_JSON_EVIDENCE = "LLM response could not be parsed as JSON; defaulted to flaky"
DEFAULT_EVIDENCE = "LLM classification"
NO_MESSAGE = "(no error message)"

# --- fixed values: prompt texts ---------------------------------------------
PROMPT_HEAD = (
    "You are a CI log classifier. Classify this test failure as one of:\n"
    "  REAL_BUG (reproducible, deterministic failure)\n"
    "  FLAKY (intermittent, non-deterministic)\n"
    "  INFRA (environment issue: timeout, OOM, network)\n"
)
PROMPT_TAIL = (
    "Respond with ONLY the JSON object below — no reasoning, no "
    "explanation, no markdown fences:\n"
    '{"category": "REAL_BUG|FLAKY|INFRA", "evidence": "one-sentence'
    ' justification", "confidence": 0.0-1.0}'
)

# --- fixed values: report titles, by category -------------------------------
SECTION_TITLES = {
    "FLAKY": "Flaky Tests",
    "REAL_BUG": "Real Bugs",
    "INFRA": "Infra Issues",
    "INSUFFICIENT_DATA": "Insufficient Data",
}
SECTION_KEYS = {
    "FLAKY": "flaky_tests",
    "REAL_BUG": "real_bugs",
    "INFRA": "infra_issues",
    "INSUFFICIENT_DATA": "insufficient_data",
}
