"""Counts and probabilities of the language models against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from testpulse.llm import toxicity as X


def plain_grams(words):
    """{gram: counts by kind} with counts for n-grams of full context only."""
    grams = defaultdict(lambda: [0] * len(X.KINDS))
    for word, counts in words.items():
        marked = f"^{word}$"
        for end in range(2, len(marked) + 1):
            first = max(0, end - X.ORDER)
            for start in range(first, end):
                row = grams[marked[start:end]]
                if start == first:
                    for i, n in enumerate(counts):
                        row[i] += n
    return grams


@pytest.fixture(scope="module")
def words(spark):
    draw = random.Random(4)
    texts, counts = [], defaultdict(lambda: [0] * len(X.KINDS))
    for _ in range(200):
        kind = draw.choice([None, 0, 1, 2, 3])
        text = " ".join(
            draw.choice(["Über", "maß", "a_1", "naïve", "x", "東京", "y" * draw.randint(1, 12)]) for _ in range(20)
        ) + ("," + "z" * 700 if draw.random() < 0.1 else "")
        texts.append((text, kind))
        for word in re.findall(r"\w+", text.lower()):
            row = counts[word]
            if kind is not None:
                row[kind] += 1
    made = spark.createDataFrame([*texts, (None, 1), ("", 0)], "_text string, _kind int").repartition(3)
    return X.count_words(made).cache(), counts


def test_words_and_grams(words):
    counted, true = words
    found = {r.word: [r[k] for k in X.KINDS] for r in counted.collect()}
    assert found == dict(true)
    grams = {r.gram: [r[k] for k in X.KINDS] for r in X.count_grams(counted).collect()}
    assert grams == dict(plain_grams(true))  # words of over PIECE characters, too


def test_kneser_ney(words):
    """Evidence of every n-gram and context as the formulas say, by plain dictionaries."""
    counted, true = words
    grams = plain_grams(true)
    continuations = Counter(g[1:] for g in grams if len(g) > 1)
    total, types = Counter(), Counter()
    for rest, n in continuations.items():
        total[rest[:-1]] += n
        types[rest[:-1]] += 1

    def shared(rest):
        if rest not in continuations:
            return None
        context = rest[:-1]
        own = max(continuations[rest] - X.DISCOUNT, 0) / total[context]
        off = X.DISCOUNT * types[context] / total[context]
        return own + (off / (types[context] + 1) if len(rest) == 1 else off * shared(rest[1:]))

    seen = {g: (c[0], c[1]) for g, c in grams.items() if c[0] + c[1] > 0}
    sums = defaultdict(lambda: [0, 0, 0, 0])
    for g, (a, b) in seen.items():
        row = sums[g[:-1]]
        row[0] += a
        row[1] += b
        row[2] += a > 0
        row[3] += b > 0

    def likely(gram, c):
        t, k = sums[gram[:-1]][c], sums[gram[:-1]][2 + c]
        off = X.DISCOUNT * k / t if t else 1.0
        own = max(seen[gram][c] - X.DISCOUNT, 0) / t if t else 0.0
        return own + off * shared(gram[1:])

    made = X.count_grams(counted).cache()
    values = X.evidence(made, X._shared(made).cache())
    for gram in seen:
        assert values[gram] == pytest.approx(math.log(likely(gram, 1) / likely(gram, 0)), abs=1e-9)
    for context, (a, b, ka, kb) in sums.items():
        off = [X.DISCOUNT * k / t if t else 1.0 for t, k in ((a, ka), (b, kb))]
        assert values[" " + context] == pytest.approx(math.log(off[1] / off[0]), abs=1e-9)
    assert len(values) == len(seen) + len(sums)
