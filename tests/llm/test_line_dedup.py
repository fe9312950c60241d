"""Winnowed line dedup against a plain quadratic version."""

import random
import re

import pytest

from testpulse.llm import linededup as L

SCHEMA = "doc_id long, text string"


def lines_of(text):
    parts = re.split(r"(?<=\n)|(?<=[.!?][\x20\x09])", text or "")
    return [w for w in (" ".join(re.findall(r"[^\x20\x09-\x0D]+", p)) for p in parts) if w]


def plain_runs(texts, min_words=25):
    """{doc: longest runs (first, last) that occur whole at an earlier place}, by comparing all."""
    lines = [lines_of(t) for t in texts]
    found = {}
    for d, own in enumerate(lines):
        runs = set()
        for e in range(d + 1):
            other = lines[e]
            for i in range(len(own)):
                for j in range(len(other)):
                    if (e, j) >= (d, i) or own[i] != other[j]:
                        continue
                    if i and j and own[i - 1] == other[j - 1]:
                        continue  # not the start of a run
                    n = 0
                    while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                        n += 1
                    if sum(len(x.split()) for x in own[i : i + n]) >= min_words:
                        runs.add((i, i + n - 1))
        longest = {r for r in runs if not any(a <= r[0] and r[1] <= b and (a, b) != r for a, b in runs)}
        if longest:
            found[d] = longest
    return found


def runs_of(spark, texts, **more):
    rows = L.repeated_runs(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3), **more).collect()
    found = {}
    for r in rows:
        found.setdefault(r._id, set()).add((r.first_line, r.last_line))
    return rows, found


def sentence(name, n):
    return " ".join(f"{name}{i}" for i in range(n)) + ". "


def corpus(seed, docs=60):
    """Documents of own lines, frequent lines, and passages of one to nine lines at any place."""
    draw = random.Random(seed)
    frequent = [sentence(f"often{i}", draw.randint(1, 6)) for i in range(4)]
    passages = [
        "".join(sentence(f"p{i}.{k}.", draw.randint(4, 30)) for k in range(draw.randint(1, 9))) for i in range(8)
    ]
    texts = []
    for d in range(docs):
        text = ""
        for k in range(draw.randint(1, 8)):
            kind = draw.random()
            if kind < 0.3:
                text += draw.choice(passages)
            elif kind < 0.5:
                text += draw.choice(frequent)
            else:
                text += sentence(f"d{d}.{k}.", draw.randint(3, 12))
            text += draw.choice(["", "", "\n", " \t"])
        texts.append(text)
    return texts + texts[5:9]  # and whole copies


def covered(runs):
    return {(d, i) for d, own in runs.items() for a, b in own for i in range(a, b + 1)}


@pytest.mark.parametrize(("seed", "chunk"), [(1, 128), (2, 128), (3, 16), (4, 16)])
def test_covers_what_the_quadratic_version_covers(spark, monkeypatch, seed, chunk):
    """Passages among frequent lines: all of every passage; a frequent line beside it may stay."""
    monkeypatch.setattr(L, "CHUNK", chunk)
    texts = corpus(seed)
    rows, found = runs_of(spark, texts)
    check_sources(rows, texts)
    true, lines = covered(plain_runs(texts)), [lines_of(t) for t in texts]
    assert covered(found) <= true
    missed = true - covered(found)
    assert all(lines[d][i].startswith("often") or len(lines[d][i].split()) < 13 for d, i in missed)
    assert len(missed) <= 0.03 * len(true)


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_quadratic_version(spark, seed):
    """Passages between lines of their own: the same runs."""
    draw = random.Random(seed)
    passages = ["".join(sentence(f"p{i}.{k}.", draw.randint(3, 20)) for k in range(draw.randint(3, 9))) for i in range(10)]
    texts = [
        "".join(sentence(f"d{d}.{k}.", 5) + draw.choice(passages) for k in range(draw.randint(1, 3)))
        + sentence(f"e{d}", 4) for d in range(50)
    ]
    rows, found = runs_of(spark, texts)
    assert found == plain_runs(texts)
    check_sources(rows, texts)


def check_sources(rows, texts):
    """Every run occurs whole in the document that it names, at an earlier place."""
    lines = [lines_of(t) for t in texts]
    for r in rows:
        part, other = lines[r._id][r.first_line : r.last_line + 1], lines[r.first_id]
        assert sum(len(x.split()) for x in part) == r.n_words
        assert any(
            other[j : j + len(part)] == part and (r.first_id, j) < (r._id, r.first_line) for j in range(len(other))
        )


@pytest.mark.parametrize("seed", range(3))
def test_few_different_lines(spark, seed):
    """Every line and pair is frequent: what is found is right."""
    draw = random.Random(seed)
    kinds = [sentence(f"k{i}", 6) for i in range(4)]
    texts = ["".join(draw.choice(kinds) for _ in range(draw.randint(1, 14))) for _ in range(40)]
    rows, found = runs_of(spark, texts)
    check_sources(rows, texts)
    true = covered(plain_runs(texts))
    assert covered(found) <= true
    assert len(covered(found)) >= 0.7 * len(true)


@pytest.mark.parametrize("chunk", [128, 2])
def test_frequent_lines_lose_no_run(spark, monkeypatch, chunk):
    """All is frequent and the first place of a gram seldom has the longest run: the same runs."""
    monkeypatch.setattr(L, "CHUNK", chunk)
    draw = random.Random(7)
    kinds = [sentence(f"k{i}", draw.randint(1, 8)) for i in range(3)]
    texts = ["".join(draw.choice(kinds) for _ in range(draw.randint(0, 30))) for _ in range(30)]
    rows, found = runs_of(spark, texts + texts[3:6])
    assert found == plain_runs(texts + texts[3:6])
    check_sources(rows, texts + texts[3:6])


def test_runs_are_not_chained_from_different_places(spark):
    a, b, c = (sentence(x, 9) for x in "ABC")
    _, found = runs_of(spark, [a + b, b + c, a + b + c])
    assert found == {}


def test_repeats_within_a_document_and_without_id(spark):
    passage = sentence("p", 12) + sentence("q", 14)
    made = [(1, passage + sentence("own", 5) + passage), (None, sentence("other", 4) + passage), (1, passage)]
    rows = L.repeated_runs(spark.createDataFrame(made, SCHEMA)).collect()
    spans = sorted((r._id, r.first_line, r.last_line, r.first_id) for r in rows)
    assert spans == [(1, 0, 1, None), (1, 0, 1, None), (1, 3, 4, None)]
    text = {t for _, t in made}
    assert all(r._id is not None for r in rows) and len(text) == 3


def test_hot_text_and_marks(spark):
    """A third of all rows is one text without an id, and texts hold the mark itself."""
    passage = sentence("p", 30) + sentence("q", 14)
    made = [(None, passage)] * 500 + [(i, sentence(f"s{i}", 8) + passage) for i in range(400)]
    made += [(1000 + i, f"a\x01b{i}.\n" + passage) for i in range(3)] + [(2000, "\x01")]
    df = spark.createDataFrame(made, SCHEMA).repartition(4)
    rows = L.repeated_runs(df).collect()
    assert len(rows) == 403 and {(r.first_line, r.last_line, r.first_id) for r in rows} == {(1, 2, None)}
    left = {r.doc_id: r.text for r in L.remove_repeats(df).collect()}
    assert left[3].strip() == sentence("s3", 8).strip() and left[1000] == "a\x01b0.\n"
    assert left[2000] == "\x01" and left[None] == passage


def test_long_documents(spark):
    """Runs over many chunks, far apart in both documents."""
    run = "".join(sentence(f"r{i}.", 5) for i in range(700))
    head = "".join(sentence(f"h{i}.", 3) for i in range(333))
    texts = [sentence("a", 4) + run + sentence("b", 4), head + run + sentence("c", 4), run[: len(run) // 2]]
    rows, found = runs_of(spark, texts)
    assert found[1] == {(333, 1032)} and min(found[2])[0] == 0
    check_sources(rows, texts)


def test_one_line_over_and_over(spark):
    """A document of one line lies along itself once, and so do its copies; nothing is quadratic."""
    line = sentence("w", 14)
    texts = [line * 3000, line * 3000 + sentence("own", 3), line * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    hashed = L.line_hashes(docs, "doc_id", "text").cache()
    assert L.alignments(hashed).count() <= 4 * 3 * (3000 // L.CHUNK + 2)
    _, found = runs_of(spark, texts)
    assert covered(found) == {(0, i) for i in range(1, 3000)} | {(1, i) for i in range(3000)} | {(2, i) for i in range(2000)}


def test_a_passage_repeated_whole_is_one_unit(spark):
    """The descent has a row a passage, not one a line, and finds the lines behind its last gram."""
    short = [sentence(f"s{k}.", 2) for k in range(3)]
    passages = ["".join(sentence(f"p{i}.{k}.", 9) for k in range(30)) for i in range(4)]
    texts = [
        "".join(sentence(f"d{d}.{i}.", 7) + p + "".join(short[: (d + i) % 4]) for i, p in enumerate(passages))
        + sentence(f"e{d}.", 5) for d in range(6)
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    ordered, bits = L._in_order(L.line_hashes(docs, "doc_id", "text"))
    units = sum(len(r.units) for r in L.segments(ordered, bits, L.MIN_WORDS).collect())
    assert units <= 6 * 4 * 5  # of 720 lines in passages: the passage, and what its last lines begin
    rows, found = runs_of(spark, texts)
    assert found == plain_runs(texts)
    check_sources(rows, texts)


def test_lines_are_cut_the_same_however_they_are_found(spark):
    """Lines and their words by plain searches are those of the patterns, at all kinds of white space and ends."""
    draw = random.Random(5)
    parts = ["a", "bc", "é", ".", "!", "?", ". ", "! ", "? ", ".\t", "!\t", "?\t", "\n", "\r\n", "\r", "\v", "\f", " ", "  ", "\t"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(400)] + ["", "\n", " \n\n "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA)
    rows = df.select(
        "doc_id", L.pieces(L.F.col("text")).alias("pieces"), L.worded_lines(L.F.col("text")).alias("lines"),
        L._trimmed(L.F.col("text")).alias("words"),
    ).collect()
    hashed = {r._id: [tuple(x) for x in r.lines] for r in L._hashed(df, "doc_id", "text").collect()}
    for r in rows:
        text = texts[r.doc_id]
        cut = re.split(r"(?<=\n)|(?<=[.!?][\x20\x09])", text)
        cut = cut[:-1] if len(cut) > 1 and cut[-1] == "" else cut
        assert r.pieces == cut and r.words == [" ".join(re.findall(r"[^\x20\x09-\x0D]+", p)) for p in cut]
        assert [(x.n, x.at) for x in r.lines] == [(len(w.split(" ")), k) for k, w in enumerate(r.words) if w]
        assert hashed[r.doc_id] == [(x.h, x.n) for x in r.lines]


def test_narrow_steps(spark, monkeypatch):
    """Lines go through no aggregation, and only grams with several places are written one by one."""
    written = {}
    stage = L.stage

    def kept(df, name):
        written[name] = stage(df, name)
        return written[name]

    monkeypatch.setattr(L, "stage", kept)
    monkeypatch.setattr(L, "unstage", lambda *tables: None)
    passage = "".join(sentence(f"p{k}.", 14) for k in range(3))
    texts = ["".join(sentence(f"d{d}.{k}.", 14) for k in range(20)) + passage for d in range(4)]
    _, found = runs_of(spark, texts + texts[:1])
    assert found == {1: {(20, 22)}, 2: {(20, 22)}, 3: {(20, 22)}, 4: {(0, 22)}}
    assert "lines" not in written["copied-contents"].columns
    assert written["places-of-grams"].count() == 4 * 3
