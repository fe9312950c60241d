"""Sharding: a Feistel permutation of global row numbers, with cycle walking.

A row's number is its place in a fixed order of the rows (see ``numbering``).
The permutation is a balanced network of keyed rounds over the smallest power
of two that holds all numbers; a value outside the table is permuted again until
it falls inside, which keeps it a permutation of exactly the row numbers.  Place
``p`` of the shuffled order is shard ``p mod shards``, slot ``p div shards``: both
follow from the row number alone, and :func:`row_number_of` goes back.

Only built-in functions are used.  Counts of shards differ by one at most.

Defined results: null columns are values like any other; wholly equal rows get
neighbouring numbers (which of them gets which makes no difference); an empty
table gives an empty result; input columns named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from testpulse.llm.columns import let, table
from testpulse.llm.numbering import numbered

ROUNDS = 6
#: Steps of a walk.  Less than half of all values lie outside, so that a walk
#: is longer with a chance of 2 ** -64 a row; it then raises instead of guessing.
WALK = 64
SHARDS = 24
SEED = 42


def _network(value: Column, n_rows: int, seed: int, backwards: bool) -> Column:
    """One pass through the rounds, a bijection of the numbers below 2 ** bits."""
    bits = max(2, (n_rows - 1).bit_length())
    right_bits = bits // 2
    left_mask, right_mask = (1 << (bits - right_bits)) - 1, (1 << right_bits) - 1

    def mask(number: Column) -> Column:
        return F.when(number % 2 == 0, F.lit(left_mask)).otherwise(F.lit(right_mask)).cast("long")

    def keyed(half: Column, number: Column) -> Column:
        return F.xxhash64(half, number, F.lit(seed)).bitwiseAND(mask(number))

    def forward(pair: Column, number: Column) -> Column:
        mixed = pair["l"].bitwiseXOR(keyed(pair["r"], number))
        return F.struct(pair["r"].alias("l"), mixed.alias("r"))

    def backward(pair: Column, number: Column) -> Column:
        mixed = pair["r"].bitwiseXOR(keyed(pair["l"], number))
        return F.struct(mixed.alias("l"), pair["l"].alias("r"))

    halves = F.struct(
        F.shiftright(value, right_bits).alias("l"),
        value.bitwiseAND(F.lit(right_mask).cast("long")).alias("r"),
    )
    numbers = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if backwards else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(
        numbers,
        halves,
        backward if backwards else forward,
        lambda pair: F.shiftleft(pair["l"], right_bits).bitwiseOR(pair["r"]),
    )


def permuted(number: Column, n_rows: int, seed: int = SEED, backwards: bool = False) -> Column:
    """The place of a row number (long, below ``n_rows``) in the shuffled order."""
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        _network(number, n_rows, seed, backwards),
        lambda x, _: F.when(x < n_rows, x).otherwise(_network(x, n_rows, seed, backwards)),
    )
    unended = F.raise_error(F.lit("a cycle walk did not end")).cast("long")
    return let(walked, lambda place: F.when(place < n_rows, place).otherwise(unended))


def row_number_of(shard: Column, slot: Column, n_rows: int, shards: int = SHARDS, seed: int = SEED) -> Column:
    """The row number that lies at a slot of a shard."""
    return permuted(slot.cast("long") * shards + shard, n_rows, seed, backwards=True)


def assign(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with ``row_number``, ``shard`` and ``slot``.

    All columns decide the order, and all of them are shuffled once: give the
    narrow ones that name a row, and join what is wide by them.
    """
    named = rows.drop("row_number", "shard", "slot")
    n_rows = named.count()
    place = permuted(F.col("row_number"), n_rows, seed)
    return (
        numbered(named, n_rows, "row_number")
        .withColumn("_place", place)
        .withColumn("shard", (F.col("_place") % shards).cast("int"))
        .withColumn("slot", F.expr(f"_place div {int(shards)}"))
        .drop("_place")
    )


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = table(spark, folder, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return assign(sized).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
