"""Log lines to results: each framework, blocks, cascade, and a brute-force check."""

import random
import re

import pytest
from pyspark.sql import functions as F

from testpulse.functions import fixed
from testpulse.operators import extract as E
from testpulse.plans import ci_tables as C

STAMP = "2026-07-16T12:21:56.1234567Z "


@pytest.fixture(scope="module")
def run(make_lines):
    """Extract {(run, file): text} and give the rows in order."""

    def extract(logs, runs=None, **options):
        return E.extract_results(make_lines(logs), runs, **options).orderBy("result_ord").collect()

    return extract


@pytest.fixture(scope="module")
def parse(run):
    """Rows of one of the logs below; all are extracted together, once."""
    texts = list(dict.fromkeys(LOGS))
    done = {}
    for row in run({(i, "job_log.txt"): text for i, text in enumerate(texts)}):
        done.setdefault(texts[row.run_id], []).append(row)
    return lambda text: done.get(text, []) if text in texts else pytest.fail("log not listed")


def brief(rows):
    return [(r.test_name, r.status, r.error_message) for r in rows]


PYTEST_LOG = """tests/test_auth.py::test_login FAILED
tests/test_auth.py::test_logout PASSED
tests/test_x.py::test_skip SKIPPED
=================== FAILURES ===================
_______________ test_login _______________

    def test_login():
>       assert response.status_code == 302
E       AssertionError: assert 200 == 302
E        +  where 200 = x

tests/test_auth.py:15: AssertionError
=== 1 failed, 1 passed in 0.32s ===
"""


def test_pytest(parse):
    rows = parse(PYTEST_LOG)
    assert [(r.test_name, r.status) for r in rows] == [
        ("tests/test_auth.py::test_login", "FAILED"),
        ("tests/test_auth.py::test_logout", "PASSED"), ("tests/test_x.py::test_skip", "SKIPPED")]
    assert rows[0].error_message == "AssertionError: assert 200 == 302\n+  where 200 = x"
    assert rows[0].stack_trace.startswith("def test_login():")
    assert rows[0].stack_trace.endswith("in 0.32s ===")
    assert rows[1].error_message == "" and rows[1].stack_trace == ""
    assert {r.timing_seconds for r in rows} == {0.32}


LOCATION_LOG = ("tests/test_b.py::test_bar FAILED\n======= FAILURES =======\n"
                "_______ test_bar ________\ntests/test_b.py:5: AssertionError\nassert False\n")


def test_pytest_location_line_when_there_are_no_error_lines(parse):
    rows = parse(LOCATION_LOG)
    assert brief(rows) == [("tests/test_b.py::test_bar", "FAILED", "AssertionError")]


BEFORE_LOG = f"{STAMP}FAILED tests/a.py::t - AssertionError: x\nERROR tests/a.py::u"
BOTH_LOG = BEFORE_LOG + "\ntests/a.py::v PASSED"


def test_pytest_status_before_name_only_without_the_other_form(parse):
    assert brief(parse(BEFORE_LOG)) == [
        ("tests/a.py::t", "FAILED", ""), ("tests/a.py::u", "ERROR", "")]
    assert brief(parse(BOTH_LOG)) == [("tests/a.py::v", "PASSED", "")]


CLASS_LOG = "t.py::TestX::test_y FAILED\n____ TestX.test_y ____\nE   boom"


def test_pytest_class_header_does_not_name_the_test(parse):
    rows = parse(CLASS_LOG)
    assert brief(rows) == [("t.py::TestX::test_y", "FAILED", "")]


STAMPED_LOG = f"{STAMP}t.py::test_y FAILED\n{STAMP}____ test_y ____\n{STAMP}E   boom"


def test_timestamped_blocks_need_the_option(parse, run):
    assert brief(parse(STAMPED_LOG)) == [("t.py::test_y", "FAILED", "")]
    assert brief(run({(1, "x"): STAMPED_LOG}, strip_timestamps=True)) == [("t.py::test_y", "FAILED", "boom")]


UNITTEST_LOG = """test_login (test_auth.TestAuth) ... FAIL
test_logout (test_auth.TestAuth) ... ok
test_edge (test_parser.TestParser) ... ERROR
test_skip (test_parser.TestParser) ... skip

======================================================================
FAIL: test_login (test_auth.TestAuth)
----------------------------------------------------------------------
Traceback (most recent call last):
  File "/p/test_auth.py", line 10, in test_login
    self.assertEqual(200, 302)
AssertionError: 200 != 302

======================================================================
ERROR: test_edge (test_parser.TestParser)
----------------------------------------------------------------------
Traceback (most recent call last):
  File "/p/test_parser.py", line 20, in test_edge
ValueError: bad

----------------------------------------------------------------------
Ran 4 tests in 0.25s
"""


def test_unittest(parse):
    rows = parse(UNITTEST_LOG)
    assert brief(rows) == [
        ("test_auth.TestAuth.test_login", "FAILED", "AssertionError: 200 != 302"),
        ("test_auth.TestAuth.test_logout", "PASSED", ""),
        ("test_parser.TestParser.test_edge", "ERROR", "ValueError: bad"),
        ("test_parser.TestParser.test_skip", "SKIPPED", "")]
    assert "self.assertEqual" in rows[0].stack_trace and "---" not in rows[0].stack_trace
    assert rows[0].timing_seconds == 0.25


LOOSE_LOG = "test_a (mod.Case [x y]) ..... ok"
STRICT_LOG = LOOSE_LOG + "\ntest_b (m.C) ... ok"


def test_unittest_loose_form_only_without_the_strict_one(parse):
    assert brief(parse(LOOSE_LOG)) == [("mod.Case [x y].test_a", "PASSED", "")]
    assert brief(parse(STRICT_LOG)) == [("m.C.test_b", "PASSED", "")]


JEST_LOG = """PASS packages/foo/bar.test.js
FAIL packages/baz/qux.test.js
  ● Foo › renders
    at first
    expect(received).toBe(expected)
    Expected: true

  ● Bar › handles empty state
    TypeError: Cannot read property
      at Bar (bar.js:42)

ERROR __tests__/api.ts
Test Suites: 1 failed, 5 passed
Tests:       2 failed in 3s
"""


def test_jest_suites_take_all_messages_of_the_log(parse):
    message = ("Foo › renders: expect(received).toBe(expected); "
               "Bar › handles empty state: TypeError: Cannot read property")
    assert brief(parse(JEST_LOG)) == [
        ("packages.foo.bar.test.js", "PASSED", ""), ("packages.baz.qux.test.js", "FAILED", message),
        ("__tests__.api.ts", "ERROR", message)]


TWICE_LOG = "FAIL a.test.ts\n  ● one\n    x\n  ● two\n    at y\n  ● one\n    z\nTests: 3 failed"


def test_jest_name_keeps_first_place_and_last_message(parse):
    assert parse(TWICE_LOG)[0].error_message == "one: z; two"


OTHERS = [
    ("FAIL __tests__/integration/api.test.ts\nPASS src/header.spec.jsx\nERROR tests/login.e2e.ts",
     [("__tests__.integration.api.test.ts", "FAILED", ""), ("src.header.spec.jsx", "PASSED", ""),
      ("tests.login.e2e.ts", "ERROR", "")]),
    (f"{STAMP}✗ unit a/__tests__/f.spec.ts (3 tests) 5ms\n✓ unit a/__tests__/g.spec.ts",
     [("a.__tests__.f.spec.ts", "FAILED", ""), ("a.__tests__.g.spec.ts", "PASSED", "")]),
    (f"{STAMP}FAIL Turbopack test/dev.test.ts (4.1 s)", [("test.dev.test.ts", "FAILED", "")]),
    ("--- PASS: TestA (0.00s)\n--- FAIL: TestB/sub (0.1s)\n    f.go:4: no",
     [("TestA", "PASSED", ""), ("TestB/sub", "FAILED", "")]),
    ("PASS  Tests\\Unit\\A\nFAIL  Tests\\Unit\\B",
     [("Tests.Unit.A", "PASSED", ""), ("Tests.Unit.B", "FAILED", "")]),
    ("1) Cop::Lint should detect FAILED\n   Failure/Error: x", [("Cop::Lint should detect", "FAILED", "")]),
    (f"{STAMP}100 runs, 200 assertions, 3 failures, 1 errors, 0 skips",
     [("minitest_summary", "FAILED", "3 failures")]),
    ("10 runs, 20 assertions, 0 failures, 0 errors", []),
    ("  ✓ should render\n  ✗ should handle error\n  1 passing (10ms)",
     [("should render", "PASSED", ""), ("should handle error", "FAILED", "")]),
    (f"{STAMP}testMethod(TestClass)  Time elapsed: 1.234 s  <<< ERROR!\nTests run: 5, Failures: 1",
     [("TestClass.testMethod", "FAILED", "")]),
    ("  ✓ renders correctly (234ms)", [("renders correctly (234ms)", "PASSED", "")]),
    ("tests/a.py::t NOT_A_STATUS\nsome garbage", []),
    ("\x1b[31mt.py::a\x1b[0m \x1b[1mFAILED\x1b[0m", [("t.py::a", "FAILED", "")]),
]


@pytest.mark.parametrize("text, want", OTHERS)
def test_other_frameworks(parse, text, want):
    assert brief(parse(text)) == want


def test_hint_reaches_a_framework_that_another_hides(run):
    rows = run({(1, "x"): "  ✓ renders correctly (234ms)\n  ✗ no (1ms)\n  ✓ plain"},
               framework="cypress")
    assert brief(rows) == [("renders correctly", "PASSED", ""), ("no", "FAILED", "")]
    with pytest.raises(ValueError):
        run({(1, "x"): "x"}, framework="nose")


GO_LOG = "--- PASS: A\nok in 3.2s"
TURBO_LOG = "FAIL Turbopack test/dev.test.ts in 3.2s"


def test_go_and_others_have_no_duration(parse):
    assert parse(GO_LOG)[0].timing_seconds == 0.0
    assert parse(TURBO_LOG)[0].timing_seconds == 3.2


MIXED_LOG = "1) anything\n--- PASS: A"
MORE_LOG = MIXED_LOG + "\nt.py::x PASSED"
LOGS = [PYTEST_LOG, LOCATION_LOG, BEFORE_LOG, BOTH_LOG, CLASS_LOG, STAMPED_LOG, UNITTEST_LOG,
        LOOSE_LOG, STRICT_LOG, JEST_LOG, TWICE_LOG, GO_LOG, TURBO_LOG, MIXED_LOG, MORE_LOG,
        *[text for text, _ in OTHERS]]


def test_first_framework_with_a_row_takes_the_log(parse):
    assert [r.rule for r in parse(MORE_LOG)] == ["pytest_name_status"]
    assert [r.rule for r in parse(MIXED_LOG)] == ["go"]


def test_run_fields_and_order(run, make_runs):
    jobs = [(1, "lint", "success", ""), (2, "test (3.14)", "failure", "")]
    runs = make_runs([("org/app", 9, "failure"), ("org/app", 10, "failure", "Nightly", jobs)])
    logs = {(9, "a.txt"): "t.py::a PASSED", (10, "b.txt"): "t.py::c PASSED\nt.py::b PASSED",
            (10, "1_test (3.14).txt"): "t.py::d PASSED"}
    rows = run(logs, runs)
    # "10" comes before "9" in text order
    assert [r.test_name[-1] for r in rows] == ["c", "b", "d", "a"]
    assert [r.job_name for r in rows] == ["b.txt", "b.txt", "test (3.14)", "test (3.11)"]
    assert [r.workflow_name for r in rows] == ["Nightly"] * 3 + ["CI"]
    newest = run(logs, runs, newest_first=True)
    assert [r.test_name[-1] for r in newest] == ["c", "b", "d", "a"]


def test_lines_of_any_ending(spark):
    logs = spark.createDataFrame([("r", 1, "f", 0, "a\r\nb\rc\n\nd")],
                                 "repo string, run_id bigint, filename string, entry_ord int, content string")
    lines = E.explode_lines(logs).orderBy("line_no").collect()
    assert [r.line for r in lines] == ["a", "b", "c", "", "d"]
    assert [r.line_no for r in lines] == [0, 1, 2, 3, 4]


def test_unmatched(make_lines):
    lines = make_lines({(1, "a"): "t.py::a PASSED", (2, "b"): "nothing"})
    got = E.unmatched_logs(lines, E.line_events(lines)).collect()
    assert [(r.run_id, r.filename) for r in got] == [(2, "b")]


# --- brute force over random logs -------------------------------------------

PIECES = {
    "pytest": ["t.py::a FAILED", "t.py::b ERROR", "t.py::c PASSED", "x.py::a FAILED",
               "____ a ____", "______ b ______", "_______", "E   one", "E", "E  ", "E two",
               "t.py:3: Err", "  note", "", "FAILED t.py::z - m"],
    "unittest": ["a (m.C) ... FAIL", "b (m.C) ... ERROR", "c (m.C) ... ok", "FAIL: a (m.C)",
                 "ERROR: b (m.C)", "FAIL: b(m.C)", "-" * 70, "=" * 70, "=" * 10,
                 "Traceback (most recent call last):", '  File "x", line 1', "Err: 1", "  Err: 2 ",
                 "", "Ran 3 tests in 0.1s"],
    "jest": ["FAIL p/a.test.ts", "PASS p/b.spec.js", "ERROR __tests__/c", "  ● one", "  ● two › x",
             "   ● three", "    expect(a)", "    at f", "    > 1 |", "    | ^", "    TypeError: b",
             "Tests: 1", "Test Suites: 2", "", "  File x"],
}


def brute_force(kind, lines):
    """Failing rows of one log as (line number, message, stack trace)."""
    header = {"pytest": fixed.PYTEST_HEADER, "unittest": fixed.UNITTEST_HEADER,
              "jest": fixed.JEST_HEADER}[kind]
    group = 2 if kind == "unittest" else 1
    stops = {"pytest": r"(?!)", "unittest": r"={60,}|Ran ",
             "jest": fixed.JS_GENERIC + "|" + fixed.JEST_SUITE + "|Tests:|Test Suites:"}[kind]
    starts = [i for i, s in enumerate(lines) if re.match(header, s)]
    ends = starts + [i for i, s in enumerate(lines) if re.match(stops, s)] + [len(lines)]
    blocks = {}
    for i in starts:
        body = lines[i + 1:min(e for e in ends if e > i)]
        if kind == "unittest":
            body = [s for s in body if s[:3] != "---"]
        bare = [s.strip() for s in body if s.strip()]
        name = re.match(header, lines[i]).group(group).strip()
        if kind == "pytest":
            errors = "\n".join(s[2:].strip() for s in body if s[:2] == "E ")
            places = [m.group(1) for s in body if (m := re.match(fixed.SOURCE_LOCATION, s))]
            message = (errors or (places + [""])[0]).strip()
        elif kind == "unittest":
            good = [s for s in bare if not s.startswith(("Traceback", "File "))]
            message = ([""] + good)[-1]
        else:
            wanted = [s for s in bare if s.startswith("expect")]
            plain = [s for s in bare if not s.startswith(("at ", "> ", "File ", "|"))]
            message = (wanted + plain + [""])[0]
        blocks[name] = (message, "\n".join(body).strip())
    blocks.pop("", None)
    together = "; ".join(f"{n}: {m}" if m else n for n, (m, _) in blocks.items())
    out = []
    for i, s in enumerate(lines):
        if kind == "pytest" and (m := re.match(r"\S+::(\S+) (FAILED|ERROR)$", s)):
            out.append((i, *blocks.get(m.group(1), ("", ""))))
        if kind == "unittest" and (m := re.match(r"(\S+) \(m.C\) \.\.\. (FAIL|ERROR)$", s)):
            out.append((i, *blocks.get(m.group(1), ("", ""))))
        if kind == "jest" and re.match(r"(FAIL|ERROR) (p/|__)", s):
            out.append((i, together, ""))
    return out


def test_blocks_equal_brute_force(make_lines):
    dice = random.Random(11)
    logs, want = {}, []
    for run in range(300):
        kind = ["pytest", "unittest", "jest"][run % 3]
        lines = [dice.choice(PIECES[kind]) for _ in range(dice.randrange(3, 40))]
        anchor = {"pytest": "t.py::c PASSED", "unittest": "c (m.C) ... ok", "jest": "PASS p/b.spec.js"}
        lines.append(anchor[kind])  # the log is of this kind whatever else it has
        logs[run, "log"] = "\n".join(lines)
        want += [(run, *row) for row in brute_force(kind, lines)]
    assert len(want) > 800
    results = E.extract_results(make_lines(logs))
    line_no = (F.col("result_ord") % F.lit(10**10).cast("decimal(38,0)")).cast("bigint")
    got = results.filter("status in ('FAILED', 'ERROR')").select(
        "run_id", line_no, "error_message", "stack_trace").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_blocks_across_chunks(make_lines, monkeypatch):
    """A block far longer than a chunk is put together in order."""
    monkeypatch.setattr(E, "BLOCK_CHUNK", 16)
    body = [f"E   line {i}" for i in range(500)]
    text = "\n".join(["t.py::a FAILED", "____ a ____", *body])
    rows = E.extract_results(make_lines({(1, "x"): text})).collect()
    assert rows[0].error_message == "\n".join(f"line {i}" for i in range(500))
    assert rows[0].stack_trace == "\n".join(body)


def written(monkeypatch):
    """{name: optimized plan} of the tables written from now on."""
    plans, write = {}, E.stage

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(E, "stage", spy)
    return plans


def test_block_lines_are_put_together_once(make_lines, monkeypatch):
    """Both the blocks of tests and those of JS suites are taken from one pass over the lines."""
    plans = written(monkeypatch)
    text = "t.py::a FAILED\n____ a ____\nE   x"
    suite = "FAIL pkg/a.test.js\n  ● S › a\n    expect(1)\n  ● S › b\n    boom"
    rows = E.extract_results(make_lines({(1, "x"): text, (2, "x"): suite})).collect()
    assert sorted((r.run_id, r.error_message, r.stack_trace) for r in rows) == [
        (1, "x", "E   x"), (2, "S › a: expect(1); S › b: boom", "")
    ]
    running = [plan.count("last(_opened") for plan in plans.values()]
    assert sum(running) == 1


def test_only_results_of_the_winner_are_cut_out(make_lines, monkeypatch):
    """Patterns of groups run above the join that leaves out the other frameworks."""
    plans = written(monkeypatch)
    text = "t.py::a PASSED\nb (m.C) ... FAIL\nc (m.C) ... ok"
    rows = E.extract_results(make_lines({(1, "x"): text, (2, "y"): "b (m.C) ... ok"})).collect()
    assert sorted((r.run_id, r.test_name, r.rule) for r in rows) == [
        (1, "t.py::a", "pytest_name_status"), (2, "m.C.b", "unittest_dots")
    ]
    nodes = plans["result-lines"].splitlines()
    joins = [i for i, node in enumerate(nodes) if "Join" in node]
    cuts = [i for i, node in enumerate(nodes) if "regexp_extract" in node]
    assert joins and cuts and max(cuts) < min(joins)


def test_lines_of_events_are_derived_once(spark, monkeypatch):
    """The filter on lines does not repeat the text that makes them; every event keeps its lines."""
    rows = [(i, i % 7, ["error", "view", "purchase", "signup"][i % 4]) for i in range(240)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string")
    plans = []

    def build_only(spark, name, build):
        table = build()
        plans.append(table._jdf.queryExecution().optimizedPlan().toString())
        return table

    monkeypatch.setattr(C, "events", lambda spark, folder: events)
    monkeypatch.setattr(C, "stage_once", build_only)
    lines = C.block_lines(spark, "nowhere").collect()
    assert plans[0].count("Traceback (most recent call last)") == 1
    assert all(r.line is not None for r in lines)
    got = sorted((r.line_no, r.line) for r in lines if r.run_id == 1002 and r.line_no < 215)
    assert got == [  # run 1002 is a pytest log
        (200, "tests/test_m.py::test_u5 FAILED"), (201, "_______ test_u5 _______"),
        (202, "    def test_it():"), (203, "E   AssertionError: got 40"), (204, "E    + where x is 3"),
        (205, "tests/test_m.py::test_u6 PASSED"), (210, "tests/test_m.py::test_u0 ERROR"),
        (211, "_______ test_u0 _______"), (212, "    def test_it():"),
        (213, "tests/test_m.py:42: ValueError: bad port 42"), (214, "1 error in 0.32s"),
    ]
