"""Suffix arrays and decontamination against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from testpulse.llm import decontamination as D

SCHEMA = "doc_id long, text string"
ITEMS = "item_id string, text string"


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def windows_of(text, width):
    words = words_of(text)
    if not words:
        return set()
    w = min(width, len(words))
    return {tuple(words[i : i + w]) for i in range(len(words) - w + 1)}


def plain(docs, items, width=10):
    windows = [(name or "", win) for name, text in items for win in windows_of(text, width)]
    found = []
    for doc_id, text in docs:
        words, hit, names = words_of(text), set(), set()
        for name, win in windows:
            for i in range(len(words) - len(win) + 1):
                if tuple(words[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    names.add(name)
        found.append((doc_id, len(words), len(hit), sorted(names)))
    return sorted(found, key=str)


def rows(found):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=str)


@pytest.mark.parametrize("depth", [None, 1, 3, 10])
def test_suffix_array(depth):
    draw = np.random.default_rng(3)
    for n in (1, 2, 50, 400):
        marks = max(1, n // 10)
        values = draw.integers(0, 3, n) + marks
        places = np.append(draw.choice(n - 1, marks - 1, replace=False), n - 1) if n > 1 else np.array([0])
        values[places] = np.arange(marks)
        order = D.suffix_array(values, depth)
        assert sorted(order.tolist()) == list(range(n))
        upto = n if depth is None else depth

        def key(p, values=values, marks=marks, upto=upto):
            part = values[p : p + upto].tolist()
            end = next((i + 1 for i, v in enumerate(part) if v < marks), len(part))
            return part[:end]

        keys = [key(p) for p in order]
        assert keys == sorted(keys)


def cases(seed):
    draw = random.Random(seed)
    letters = ["a", "B", "c", "d"]

    def text(n):
        return " ".join(draw.choice(letters) for _ in range(n))

    items = [(str(i), text(draw.choice([0, 1, 2, 3, 4, 7, 12]))) for i in range(6)] + [(None, "b, B! b"), ("5", "a d a d a")]
    docs = [(i, text(draw.randint(0, 40))) for i in range(40)] + [(None, "d d d d"), (1, "a"), (2, None), (3, "")]
    long = text(60)
    return docs + [(50, long), (50, long), (51, "x " + long + " y z " + long)], [*items, ("9", long)]


@pytest.mark.parametrize(("seed", "width", "shard", "block"), [
    (1, 3, 10**6, 10**6), (2, 5, 30, 10**6), (3, 4, 1, 12), (4, 10, 200, 40),
])
def test_equals_plain_version(spark, seed, width, shard, block):
    docs, items = cases(seed)
    found = D.contaminated(
        spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, ITEMS),
        width=width, shard_words=shard, block_words=block,
    )
    assert rows(found) == plain(docs, items, width)
    for r in found.collect():
        spans = [(s.start, s.end) for s in r.spans]
        assert sum(b - a for a, b in spans) == r.n_hit
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))  # apart and in order


@pytest.mark.parametrize("shard", [20, 10**6])
def test_longest_matches(spark, shard):
    docs, items = cases(5)
    docs, items, width = docs[:30] + docs[-3:], [(n or "", t) for n, t in items], 4
    found = {
        (r.item_id, r.start): (r.n_words, r.doc_id, r.at)
        for r in D.longest_matches(
            spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS), width=width, shard_words=shard
        ).collect()
    }
    best = {}
    for name, text in items:
        own = words_of(text)
        w = min(width, len(own))
        for j in range(max(0, len(own) - w + 1) if own else 0):
            for doc_id, doc in docs:
                words = words_of(doc)
                for p in range(len(words)):
                    n = 0
                    while j + n < len(own) and p + n < len(words) and own[j + n] == words[p + n]:
                        n += 1
                    if n >= w:
                        value = (-n, doc_id, p)
                        best[(name, j)] = min(best.get((name, j), value), value)
    assert found == {k: (-n, d, p) for k, (n, d, p) in best.items()}


def test_odd_rows_and_removal(spark):
    long = " ".join(f"word{i % 977}" for i in range(120_000))
    docs = [(1, None), (2, ""), (None, long), (3, long), (3, long), (3, "clean"), (4, "word1 word2 word3")]
    made = spark.createDataFrame(docs, SCHEMA)
    for name in ("items", "spans", "_version", "_id", "n_hit", "item"):
        made = made.withColumn(name, F.lit("x"))
    items = spark.createDataFrame([("q", "word5 WORD6, word7 word8"), (None, None), ("e", "")], ITEMS)
    items = items.withColumn("n", F.lit(1)).withColumn("first", F.lit(2))
    found = rows(D.contaminated(made, items, width=4))
    hits = 4 * 123  # 122 whole rounds of 977 words and the start of another
    assert found == sorted(
        [(1, 0, 0, []), (2, 0, 0, []), (None, 120_000, hits, ["q"]), (3, 120_000, hits, ["q"]),
         (3, 120_000, hits, ["q"]), (3, 1, 0, []), (4, 3, 0, [])], key=str)
    left = D.decontaminate(made, items, width=4)
    assert left.columns == made.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4]
    assert D.contaminated(made.limit(0), items).count() == 0
    assert {r.n_hit for r in D.contaminated(made, items.limit(0)).collect()} == {0}
    assert D.longest_matches(made, items.limit(0)).count() == 0
