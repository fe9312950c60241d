r"""Importance resampling towards a target distribution, ranked by a parallel sort.

*Weights.*  Features of a text are its runs of 1 to ``longest`` words, hashed to
``buckets``.  Two arrays of bucket counts, of all documents and of all target texts, give
one array of gains, floor(1000 ln of the smoothed ratio); the weight of a document is the
sum of the gains of its features, looked up in that array.  Both arrays have a fixed
length; they are all that leaves the tasks.

*Draw.*  A document's score is its weight plus a Gumbel variate made from a hash of its
id, so the highest scores are a sample without replacement.

*Ranks* come from a parallel sort by regular sampling:

1. every task sorts its documents locally; the sorted runs are written;
2. each run gives every ``step``-th of its keys (the step follows from the number of rows, so
   that all runs together give ``SAMPLES`` keys and at most one more each);
3. regular places of the sorted sample are the splitters of at most ``RANGES`` ranges;
4. the sizes of the ranges are counted before anything is moved; their prefix counts
   tell how many documents come before a range, and which ranges hold ranks to be drawn;
5. the segments of those ranges are exchanged, each range is merged by Spark's sort, and
   a document's rank is the prefix count of its range and its place in it.  Documents of
   later ranges, and too short ones, are not moved at all.

A key is (score falling, id, number of the row), so it occurs once: a range has at most
its regular share of rows and one step a run, also if all rows are equal.

Defined results: a null or empty text has no words, weight 0 and no rank; a null id is
hashed as an empty one and comes after all others in ties; rows of the same id take part
each for itself, equal ones in any order; without target texts every target count is 0; an
empty table gives an empty result.  Very long texts are one list of words in their task.
Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from testpulse.llm.bytewords import Buckets, runs_of, words_of
from testpulse.llm.columns import table
from testpulse.session import stage

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bounds of the sort: runs, ranges, and keys sampled from all runs together.
RUNS = 8192
RANGES = 4096
SAMPLES = 65_536
#: Rows that a range has, roughly, as long as there are at most RANGES of them.
ROWS_PER_RANGE = 50_000

LAST_ID = 2**63 - 1
KEY = ["score", "_order_id", "_no"]


def bucket_counts(
    docs: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS
) -> np.ndarray:
    """Features in each bucket over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts = Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = list(map(of.__getitem__, runs_of(words_of(text.as_py()), longest)))
                if found:
                    counts += np.bincount(found, minlength=buckets)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], ["bucket", "n"])

    rows = (
        docs.select(F.col(text_col).cast("binary"))
        .mapInArrow(count, "bucket long, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # at most one row a bucket
    )
    counts = np.zeros(buckets, dtype=np.int64)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of target over source share), each bucket with one more count."""
    buckets, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (all_source + buckets) / ((s + 1.0) * (all_target + buckets))))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        dtype=np.int64,
    )


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """floor(-1000 ln(-ln u)) of the uniform variate u in an id's hash."""
    name = "" if doc_id is None else doc_id
    h = int.from_bytes(hashlib.sha256(f"{seed}:{name}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(
    docs: DataFrame,
    gain: np.ndarray,
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = LONGEST,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Buckets(len(gain))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            made = []
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                words = words_of(text.as_py())
                found = list(map(of.__getitem__, runs_of(words, longest)))
                weight = int(gain[found].sum()) if found else 0
                made.append((len(words), len(found), weight, weight + gumbel(doc_id, seed)))
            numbers = np.array(made, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(numbers[:, i]) for i in range(4))],
                ["doc_id", "n_words", "n_features", "weight", "score"],
            )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("_text")
    ).mapInArrow(rate, "doc_id long, n_words long, n_features long, weight long, score long")


def _order() -> list[Column]:
    return [F.desc("score"), F.asc("_order_id"), F.asc("_no")]


def _regular(step: int):
    """Every ``step``-th key of a sorted run."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = step // 2  # rows until the next key
        for batch in batches:
            yield batch.take(pa.array(range(at, batch.num_rows, step), pa.int64()))
            at = at - batch.num_rows if at >= batch.num_rows else (at - batch.num_rows) % step

    return pick


def splitters(runs: DataFrame, n_rows: int, ranges: int) -> np.ndarray:
    """Keys (a row each; score negated, so that they rise) at regular places of the sample."""
    step = max(1, n_rows // SAMPLES)
    rows = runs.select(*KEY).mapInArrow(_regular(step), "score long, _order_id long, _no long").toArrow()
    keys = np.column_stack([-rows["score"].to_numpy(), rows["_order_id"].to_numpy(), rows["_no"].to_numpy()])
    keys = keys[np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))]
    places = np.unique(np.arange(1, ranges) * len(keys) // ranges)
    return keys[places[places < len(keys)]]


def range_of(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The number of splitters up to each key, by binary search over the whole key."""
    low, high = np.zeros(len(keys), dtype=np.int64), np.full(len(keys), len(cuts), dtype=np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        cut, key = cuts[middle], keys[open_]
        last = cut[:, 2] <= key[:, 2]
        second = (cut[:, 1] < key[:, 1]) | (cut[:, 1] == key[:, 1]) & last
        up_to = (cut[:, 0] < key[:, 0]) | (cut[:, 0] == key[:, 0]) & second
        low[open_[up_to]] = middle[up_to] + 1
        high[open_[~up_to]] = middle[~up_to]
    return low


def _placed(cuts: np.ndarray):
    """Appends the range of each row that takes part, -1 for others."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in KEY])
            keys[:, 0] = -keys[:, 0]
            at = np.full(batch.num_rows, -1, dtype=np.int64)
            joins = np.flatnonzero(batch.column("_joins").to_numpy(zero_copy_only=False))
            at[joins] = range_of(keys[joins], cuts)
            yield batch.append_column("_range", pa.array(at))

    return place


def ranked(rows: DataFrame, joins: Column, share: int, ranges: int | None = None) -> DataFrame:
    """``rows`` (with doc_id and score) and ``rank``: 1, 2, 3... by falling score and rising id
    of the first ``share`` percent (rounded down) of the rows for which ``joins`` holds; null for
    the rest."""
    columns = rows.columns
    # An id greater than all others stands for none; the row number ends every tie.
    keyed = rows.select(
        "*",
        F.coalesce(joins, F.lit(False)).alias("_joins"),
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("_order_id"),
        F.monotonically_increasing_id().alias("_no"),
    )
    runs = stage(keyed.sortWithinPartitions(*_order()), "sorted-runs").coalesce(RUNS)
    members = runs.filter("_joins")
    n_rows = members.count()
    drawn = n_rows * share // 100
    if ranges is None:
        parallel = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = min(RANGES, max(n_rows // ROWS_PER_RANGE, parallel))
    cuts = splitters(members, n_rows, max(1, ranges))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema) + ", _range long"
    placed = runs.mapInArrow(_placed(cuts), schema)
    sizes = placed.filter("_range >= 0").groupBy("_range").count().collect()  # one row a range
    size = np.zeros(len(cuts) + 1, dtype=np.int64)
    for row in sizes:
        size[row["_range"]] = row["count"]
    before = np.cumsum(size) - size
    needed = int((before < drawn).sum())  # ranges that hold a rank to be drawn
    if not drawn:
        return runs.select(*columns, F.lit(None).cast("long").alias("rank"))
    starts = rows.sparkSession.createDataFrame(
        [(i, int(before[i])) for i in range(needed)], "_range long, _before long"
    )
    inside = Window.partitionBy("_range").orderBy(*_order())
    exchanged = (
        placed.filter(F.col("_range").between(0, needed - 1))
        .withColumn("_at", F.row_number().over(inside))
        .join(F.broadcast(starts), "_range")  # at most RANGES rows
        .withColumn("_rank", F.col("_before") + F.col("_at"))
        .select(*columns, F.when(F.col("_rank") <= drawn, F.col("_rank")).alias("rank"))
    )
    stay = placed.filter((F.col("_range") < 0) | (F.col("_range") >= needed))
    return exchanged.union(stay.select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    share: int = PERCENT,
    least_words: int = LEAST_WORDS,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; rank is null
    for those that are not drawn."""
    gain = gains(
        bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets)
    )
    rated = scored(docs, gain, id_col, text_col, longest, seed)
    return ranked(rated, F.col("n_words") >= least_words, share)


def op11_resampling(spark: SparkSession, folder: str) -> DataFrame:
    found = resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 (reflected polynomial edb88320) of the bytes given as hexadecimal digits.
_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k:
      CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, b) ORDER BY b) AS t
  FROM range(256) r(b)),
worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
target AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
own AS (SELECT doc_id, unnest(words) AS word FROM worded),
own_counts AS (SELECT word, count(*) AS n FROM own GROUP BY word),
target_counts AS (SELECT word, count(*) AS n FROM target GROUP BY word),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM own_counts UNION SELECT word FROM target_counts)),
bucketed AS (
  SELECT word, xor(list_reduce(list_transform(range(length(h) // 2),
      lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
  FROM hexed, crc_table),
s AS (SELECT bucket, sum(n) AS n FROM own_counts JOIN bucketed USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM target_counts JOIN bucketed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all),
gained AS (
  SELECT b.word, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (s_all + 10000)
    / ((s.n::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM bucketed b JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals),
weighed AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM own JOIN gained USING (word) GROUP BY doc_id),
rated AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM worded w LEFT JOIN weighed USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM rated)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= (SELECT count(*) * 10 // 100 FROM rated WHERE n_features >= 20)
    THEN place END AS rank
FROM placed"""


def sql() -> str:
    return _SQL
