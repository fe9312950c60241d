"""Hot keys are cut up and nothing is lost or doubled."""

import random
from collections import Counter

from pyspark.sql import functions as F

from testpulse.operators import spread as X


def hot_rows(spark, n=4000):
    dice = random.Random(3)
    rows = [("hot" if dice.random() < 0.4 else f"k{dice.randrange(300)}", i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, i bigint").repartition(5)


def test_attach_per_key_splits_hot_keys(spark):
    rows, df = hot_rows(spark)
    sizes = Counter(k for k, _ in rows)
    per_key = df.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    joined = X.attach_per_key(df, per_key, ["k"], "n", F.col("i"), rows_per_piece=10)
    got = sorted((r.k, r.i, r.n, r.top) for r in joined.collect())
    top = {k: max(i for kk, i in rows if kk == k) for k in sizes}
    assert got == sorted((k, i, sizes[k], top[k]) for k, i in rows)


def test_attach_per_key_left_keeps_rows_without_match(spark):
    rows, df = hot_rows(spark, 500)
    per_key = df.filter("k = 'hot'").groupBy("k").agg(F.count("*").alias("n"))
    joined = X.attach_per_key(df, per_key, ["k"], "n", F.col("i"), "left", rows_per_piece=5)
    assert joined.count() == 500
    assert joined.filter("n is not null").count() == sum(k == "hot" for k, _ in rows)


def test_hot_key_is_really_dealt_out(spark):
    """Without adaptive merging, no task gets more than a share of the hot key."""
    rows, df = hot_rows(spark)
    hot = sum(k == "hot" for k, _ in rows)
    per_key = df.groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        joined = X.attach_per_key(df, per_key, ["k"], "n", F.col("i"), rows_per_piece=10)
        sizes = [r["count"] for r in joined.filter("k = 'hot'")
                 .groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == hot and len(sizes) > 1 and max(sizes) < hot


def test_keep_matching(spark):
    rows, df = hot_rows(spark)
    wanted = spark.createDataFrame([("hot",), ("k7",), ("none",)], "k string")
    got = sorted((r.k, r.i) for r in X.keep_matching(df, wanted, ["k"], F.col("i")).collect())
    assert got == sorted((k, i) for k, i in rows if k in ("hot", "k7"))


def test_number_rows_equals_a_plain_ranking(spark):
    rows, df = hot_rows(spark)
    numbered = X.number_rows(df, ["k"], [F.col("i").desc()], F.floor(F.col("i") / 100),
                             descending=True, low=5, high=40)
    want = []
    for key in {k for k, _ in rows}:
        mine = sorted((i for k, i in rows if k == key), reverse=True)
        want += [(key, i, n) for n, i in enumerate(mine) if 5 <= n < 40]
    assert sorted((r.k, r.i, r.row_no) for r in numbered.collect()) == sorted(want)


def test_first_rows_are_cut_before_the_shuffle(spark):
    _, df = hot_rows(spark)
    top = X.first_rows(df, ["k"], [F.col("i")], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert top.groupBy("k").count().agg(F.max("count")).first()[0] == 3


def test_next_line_crosses_chunks(spark):
    dice = random.Random(5)
    numbers = sorted(dice.sample(range(10_000), 300))
    df = spark.createDataFrame([("a", n) for n in numbers], "k string, line_no bigint")
    got = {r.line_no: r.next_line_no for r in X.next_line(df, ["k"], 64).collect()}
    assert got == dict(zip(numbers, [*numbers[1:], None]))


def test_concat_in_order(spark):
    dice = random.Random(6)
    words = {k: [f"{k}{n}" for n in range(50)] for k in "ab"}
    rows = [(k, n, w) for k, ws in words.items() for n, w in enumerate(ws)]
    dice.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at bigint, w string")
    got = {r.k: r.w for r in X.concat_in_order(df, ["k"], "at", "w", "|", chunk=7).collect()}
    assert got == {k: "|".join(ws) for k, ws in words.items()}


def test_prefilter_loses_nothing_and_shuffles_no_row(spark):
    rows = spark.range(5000).select((F.col("id") % 500).alias("k"), "id")
    wanted = spark.createDataFrame([(3,), (3,), (77,)], "k long")
    for bits in (7, 20):
        kept = X.prefilter(rows, wanted, ["k"], bits)
        found = kept.groupBy("k").count().collect()
        assert {(r.k, r["count"]) for r in found} >= {(3, 10), (77, 10)}
        assert kept.columns == ["k", "id"]
    assert len(found) < 20
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
