"""Importance resampling against a plain version, odd rows and ties."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from testpulse.llm import resampling as R

SCHEMA = "doc_id long, text string"


def plain(docs, target, share=10, least=20, longest=1, buckets=10_000):
    """(weights, scores, ranks) by plain Python, in the order of docs."""

    def features(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    own, aim = [features(t) for _, t in docs], [features(t) for t in target]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for total, side in ((s, own), (t, aim)):
        for _, found in side:
            for b in found:
                total[b] += 1
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets))))
        for b in range(buckets)
    ]
    weights = [sum(gain[b] for b in found) for _, found in own]
    scores = []
    for (doc_id, _), weight in zip(docs, weights):
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        scores.append(weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    order = sorted(
        (i for i, (n, _) in enumerate(own) if n >= least),
        key=lambda i: (-scores[i], docs[i][0] is None, docs[i][0] or 0),
    )
    ranks = dict.fromkeys(range(len(docs)))
    for place, i in enumerate(order[: len(order) * share // 100]):
        ranks[i] = place + 1
    return [(d, len(f), w, sc, ranks[i]) for i, ((d, _), (_, f), w, sc) in enumerate(zip(docs, own, weights, scores))]


def rows(found):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_equals_plain_version(spark, longest):
    draw = np.random.default_rng(1)
    vocabulary = ["Über", "the", "Of", "naïve", "a1", "x-y", "東京", "z"]
    docs = [(int(i), " ".join(draw.choice(vocabulary, draw.integers(0, 60)))) for i in range(400)]
    target = [" ".join(draw.choice(vocabulary[:3], 15)) for _ in range(20)]
    found = R.resample(
        spark.createDataFrame(docs, SCHEMA).repartition(7),
        spark.createDataFrame([(t,) for t in target], "text string"),
        longest=longest, share=37, buckets=97,
    )
    assert rows(found) == sorted(plain(docs, target, 37, 20, longest, 97), key=str)


def test_odd_rows(spark):
    long = " ".join(f"word{i % 977}" for i in range(120_000))
    docs = [(1, None), (2, ""), (None, long), (3, long), (3, long), (4, "one two"), (None, "a b " * 20)]
    made = spark.createDataFrame(docs, SCHEMA)
    for name in ("rank", "score", "weight", "_range", "_no", "_joins", "n_words", "word"):
        made = made.withColumn(name, F.lit(None).cast("string"))
    target = spark.createDataFrame([("word1 word2",), (None,), ("",)], "text string").withColumn("score", F.lit(1))
    found = rows(R.resample(made, target, share=100))
    assert found == sorted(plain(docs, ["word1 word2", None, ""], 100), key=str)
    assert R.resample(made.limit(0), target).count() == 0
    untargeted = rows(R.resample(made, target.limit(0), share=50))
    assert untargeted == sorted(plain(docs, [], 50), key=str)


@pytest.mark.parametrize("ranges", [1, 2, 9, 64])
def test_ranks_of_ties_and_hot_rows(spark, ranges):
    """Two thirds of all rows are one row, and scores tie throughout."""
    made = [(7, 5)] * 400 + [(i, i % 3) for i in range(200)] + [(None, 5)] * 3
    df = spark.createDataFrame(made, "doc_id long, score long").repartition(5)
    found = R.ranked(df, F.col("score") > 0, 60, ranges).collect()
    members = sorted((x for x in made if x[1] > 0), key=lambda x: (-x[1], x[0] is None, x[0] or 0))
    drawn = members[: len(members) * 60 // 100]
    assert [(r.doc_id, r.score) for r in sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, len(drawn) + 1))
    assert len(found) == len(made)


def test_ranges_are_even(spark):
    """A range has its regular share, though one row makes up most of the table."""
    made = spark.range(0, 20_000, 1, 8).select(
        F.lit(1).cast("long").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(5).alias("score"),
    )
    keyed = made.select("score", F.col("doc_id").alias("_order_id"), F.monotonically_increasing_id().alias("_no"))
    runs = keyed.sortWithinPartitions(*R._order())
    cuts = R.splitters(runs, 20_000, 16)
    keys = np.array([(-r.score, r._order_id, r._no) for r in keyed.collect()])
    sizes = np.bincount(R.range_of(keys, cuts), minlength=16)
    assert len(cuts) == 15 and sizes.max() <= 20_000 / 16 + 8
