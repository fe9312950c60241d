"""Joins, ranks and concatenations that stay spread out when one key is huge.

A window or join keyed by test, log or repository puts all rows of one key in
one task.  The helpers here cut a key into pieces whose size has a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_PIECE = 4_000_000
TOP_K = 1000  # largest row limit that Spark applies before the shuffle
FILTER_BITS = 26


def attach_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    size: str,
    spread_on: Column,
    how: str = "inner",
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """Join columns that exist once per key onto the many rows of that key.

    ``per_key`` holds one row per key with the number of its rows in ``size``.
    A key with more than ``rows_per_piece`` rows is hot: its rows are dealt out over
    several join keys by the hash of ``spread_on``, and its one row is repeated for
    each, so a piece has about that many rows whatever the size of the table.  Of n
    rows, n / ``rows_per_piece`` keys can be hot: 250,000 short rows to broadcast for
    10^12 rows.  ``per_key`` is read twice; stage it where it is costly to compute.
    """
    share = rows_per_piece
    n_pieces = F.when(F.col(size) > share, F.ceil(F.col(size) / share)).otherwise(1).cast("int")
    hot = per_key.filter(F.col(size) > share).select(*keys, n_pieces.alias("_pieces"))
    piece = F.pmod(F.xxhash64(spread_on), F.coalesce(F.col("_pieces"), F.lit(1)))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_piece", piece.cast("int"))
    copies = per_key.withColumn("_piece", F.explode(F.sequence(F.lit(0), n_pieces - 1)))
    return dealt.drop("_pieces").join(copies, [*keys, "_piece"], how).drop("_piece")


def keep_matching(
    rows: DataFrame, wanted: DataFrame, keys: list[str], spread_on: Column
) -> DataFrame:
    """Rows whose keys are in ``wanted``: a semi join in which a hot key, wanted
    or not, is dealt out like in :func:`attach_per_key`."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_rows"))
    named = wanted.select(*keys).distinct().withColumn("_wanted", F.lit(True))
    per_key = sizes.join(named, keys, "left")
    return (
        attach_per_key(rows, per_key, keys, "_n_rows", spread_on)
        .filter(F.col("_wanted"))
        .drop("_n_rows", "_wanted")
    )


def prefilter(rows: DataFrame, wanted: DataFrame, keys: list[str], bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose keys may be in ``wanted``, without a shuffle of ``rows``.

    The keys' hashes are marked in a bitmap of 2 ** ``bits`` bits, which is broadcast
    as one row per word of 64 bits: at most a million rows however many keys there are.
    No wanted row is lost; of the others some pass (all, once the bitmap is full), so
    an exact join follows.
    """
    place = F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits)
    word, bit = F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")
    marks = (
        wanted.select(word.alias("_word"), bit.alias("_bit"))
        .groupBy("_word")
        .agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_marks"))
    )
    placed = rows.withColumns({"_at": word, "_bit": bit})
    marked = (F.col("_at") == F.col("_word")) & (F.expr("shiftrightunsigned(_marks, _bit) & 1L") == 1)
    return placed.join(F.broadcast(marks), marked, "left_semi").drop("_at", "_bit")


def number_rows(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    bucket: Column,
    *,
    name: str = "row_no",
    descending: bool = False,
    low: int = 0,
    high: int | None = None,
) -> DataFrame:
    """Number the rows of each group from 0 in ``order``; keep [low, high).

    ``bucket`` must never disagree with ``order`` (a prefix of the sort key, the
    hour of a time).  Rows are only sorted within a bucket; what lies before a
    bucket is a running sum over bucket sizes.  Buckets wholly outside the
    range are dropped before any row is sorted.
    """
    rows = df.withColumn("_bucket", bucket)
    named = [f"_group_{i}" for i in range(len(group))]
    side = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    earlier = Window.partitionBy(*group).orderBy(side).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy(*group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .filter(F.col("_before") + F.col("_n") > low)
    )
    if high is not None:
        before = before.filter(F.col("_before") < high)
    before = before.select(
        *[F.col(g).alias(n) for g, n in zip(group, named, strict=True)],
        F.col("_bucket").alias("_of"), "_n", "_before",
    )
    same = F.col("_bucket").eqNullSafe(F.col("_of"))  # null groups and buckets are kept
    for g, n in zip(group, named, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(n))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    numbered = rows.join(before, same).drop(*named, "_of").withColumn(
        name, (F.col("_before") + F.row_number().over(inside) - 1).cast("bigint")
    )
    kept = numbered.filter(F.col(name) >= low)
    if high is not None:
        kept = kept.filter(F.col(name) < high)
    return kept.drop("_bucket", "_n", "_before")


def first_rows(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1: a top-k that Spark
    cuts in every map task before the shuffle, for up to ``TOP_K`` rows."""
    top = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("row_no", F.row_number().over(top).cast("bigint"))
        .filter(F.col("row_no") <= n)
    )


def next_line(df: DataFrame, keys: list[str], chunk_lines: int = 65_536) -> DataFrame:
    """Add ``next_line_no``: the next greater line_no of the same keys, or null.

    Looks ahead within chunks of ``chunk_lines`` lines; only the first line of
    each chunk is compared across chunks.
    """
    rows = df.withColumn("_chunk", F.floor(F.col("line_no") / chunk_lines))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    following = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.min("line_no").alias("_first"))
        .select(*keys, "_chunk", F.lead("_first").over(across).alias("_beyond"))
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy("line_no")
    return (
        rows.join(following, [*keys, "_chunk"])
        .withColumn(
            "next_line_no",
            F.coalesce(F.lead("line_no").over(within), F.col("_beyond")),
        )
        .drop("_chunk", "_beyond")
    )


def joined_in_order(items: Column, separator: str) -> Column:
    """Array of (position, text) structs to one text, in position order."""
    return F.array_join(
        F.transform(F.array_sort(items), lambda item: item["text"]), separator
    )


def concat_in_order(
    df: DataFrame,
    keys: list[str],
    position: str,
    text: str,
    separator: str,
    chunk: int = 4096,
) -> DataFrame:
    """One text per key from its rows in ``position`` order, built in two steps
    so that no list holds more than ``chunk`` rows of a key."""
    piece = F.struct(F.col(position).alias("at"), F.col(text).alias("text"))
    part = F.struct(F.col("_chunk").alias("at"), F.col("_part").alias("text"))
    return (
        df.groupBy(*keys, F.floor(F.col(position) / chunk).alias("_chunk"))
        .agg(joined_in_order(F.collect_list(piece), separator).alias("_part"))
        .groupBy(*keys)
        .agg(joined_in_order(F.collect_list(part), separator).alias(text))
    )
