"""Normalization, signatures, formatting and small mappings."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from testpulse.functions import fixed
from testpulse.functions import text as T


def values(spark, rows, build, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("x"))).collect()]


def test_rewrites(spark):
    cases = {
        "/Users/me/app/t.py:42: boom": "<PATH>/app/t.py:<LINE>: boom",
        "/home/ci/app and /tmp/x1/y": "<PATH>/app and <PATH>/y",
        "/runner/w1/z": "<PATH>/z",
        "at 2024-01-02T10:00:00 it": "at <TIMESTAMP> it",
        "epoch 1700000000 and 1700000000000": "epoch <TIMESTAMP> and <TIMESTAMP>",
        "14 digits 12345678901234": "14 digits <TIMESTAMP>4",
        "a:1:2:": "a:<LINE>:2:",
        "ptr 0xDEADbeef": "ptr <ADDR>",
        "pid 77 pid88": "pid <PID> pid <PID>",
        "port 8080 busy": "port <PORT> busy",
        " \t\x0b padded \n": "padded",
        "": "",
    }
    assert values(spark, cases, T.normalize_error) == list(cases.values())


def test_same_cause_same_signature(spark):
    got = values(spark, ["/home/a/t.py:1: E", "/home/b/t.py:99: E", "/home/a/t.py:1: F", ""],
                 T.error_signature)
    assert got[0] == got[1] != got[2]
    assert all(len(g) == 16 for g in got)
    assert got[3] == hashlib.sha256(b"").hexdigest()[:16]


def test_status_words(spark):
    words = [*fixed.STATUS_WORDS, "XFAIL", ""]
    assert values(spark, words, T.status_of) == [*fixed.STATUS_WORDS.values(), None, None]


def test_decimals_round_like_the_exact_binary_value(spark):
    dice = random.Random(1)
    numbers = [2.25, 0.35, 2.75, 12.5, 0.05, 99.95, 100.0, 0.0]
    numbers += [a / b * 100 for a in range(1, 60) for b in range(a, 60)]
    numbers += [dice.random() * 1000 for _ in range(300)]
    for places in (0, 1):
        want = [f"{n:.{places}f}" for n in numbers]
        assert values(spark, numbers, lambda x: T.fixed_point(x, places), "double") == want
    assert values(spark, [0.684, 1.0], lambda x: T.percent(x, 1), "double") == ["68.4%", "100.0%"]


def test_durations(spark):
    lines = ["3 passed in 0.12s", "in  7s", "within 1.2.3s", "in .s", "no", "min 5s in 6s"]
    got = values(spark, lines, lambda x: T.seconds(T.duration_in(x)), "string")
    assert got == [0.12, 7.0, 0.0, 0.0, 0.0, 5.0]


def test_colours_names_and_labels(spark):
    assert values(spark, ["\x1b[31mFAILED\x1b[0m x", "plain"], T.strip_ansi) == ["FAILED x", "plain"]
    assert values(spark, ["a/b\\c.test.ts"], T.dotted_path) == ["a.b.c.test.ts"]
    assert values(spark, ["org/app"], T.repo_slug) == ["org_app"]
    assert values(spark, [100, None], lambda x: T.batch_label(F.lit(0), x), "int") == [
        "batch-0000-0100", "batch-0000-all"]
    assert values(spark, ["tests/a.py::t x"], lambda x: T.cache_name(F.lit("p"), F.lit("m"), x)) == [
        "p_m_tests_a.py_t_x.json"]


@pytest.mark.parametrize("code, outcome", [
    (200, "ok"), (202, "ok"), (410, "expired"), (404, "error"), (429, "error"), (503, "error"),
    (302, "error")])
def test_fetch_outcomes(spark, code, outcome):
    assert values(spark, [code], T.fetch_outcome, "int") == [outcome]
