"""Gapless row numbers that do not depend on how rows are partitioned.

Rows are ordered by the unsigned 64-bit hash of all their columns (ties: by the
columns).  The hash's leading bits form buckets of a few thousand rows, so
sorting happens within small buckets; what lies before a bucket is a running
sum over bucket totals, itself taken in two steps.  Wholly equal rows are
counted before the shuffle and told apart only at the end; a row that makes up a
third of the table is cut into pieces that lie in different buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 2048
BUCKETS_PER_SUM = 4096
COPIES_PER_PIECE = 4096


def _before(totals: DataFrame, group: list[str]) -> DataFrame:
    """Rows before each bucket of a group, from the bucket totals."""
    spans = totals.withColumn("_span", F.floor(F.col("_bucket") / BUCKETS_PER_SUM))
    earlier = Window.orderBy("_span") if not group else Window.partitionBy(*group).orderBy("_span")
    sums = (
        spans.groupBy(*group, "_span")
        .agg(F.sum("_rows").alias("_span_rows"))
        .withColumn(
            "_span_before",
            F.sum("_span_rows").over(earlier.rowsBetween(Window.unboundedPreceding, -1)),
        )
        .drop("_span_rows")
    )
    inside = Window.partitionBy(*group, "_span").orderBy("_bucket")
    return spans.withColumn(
        "_in_span", F.sum("_rows").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    ).join(sums, [*group, "_span"]).select(
        *group,
        "_bucket",
        (F.coalesce("_span_before", F.lit(0)) + F.coalesce("_in_span", F.lit(0))).alias("_before"),
    )


def numbered(rows: DataFrame, n_rows: int, name: str = "_no", group: Column | None = None) -> DataFrame:
    """``rows`` with their number from 0 (within ``group``, if given) as ``name``.

    ``n_rows`` only sets the number of buckets; it does not change the numbers.
    """
    bits = max(1, (max(n_rows, 1) // ROWS_PER_BUCKET).bit_length())
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"))
    keys = ["_group"] if group is not None else []
    counted = packed.groupBy("_row").agg(F.count(F.lit(1)).alias("_all"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("_all") - 1, F.lit(COPIES_PER_PIECE).cast("long"))
    hashed = counted.select("_row", "_all", F.explode(starts).alias("_piece")).select(
        "_row",
        "_piece",
        F.least(F.col("_all") - F.col("_piece"), F.lit(COPIES_PER_PIECE)).alias("_copies"),
        F.xxhash64("_row", "_piece").alias("_hash"),
    )
    if group is not None:
        lifted = hashed.select("*", "_row.*").withColumn("_group_value", group)
        hashed = lifted.select("_row", "_piece", "_copies", "_hash", F.col("_group_value").alias("_group"))
    hashed = hashed.withColumn("_bucket", F.shiftrightunsigned("_hash", 64 - bits))
    totals = hashed.groupBy(*keys, "_bucket").agg(F.sum("_copies").alias("_rows"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_hash", "_row", "_piece")
    placed = hashed.withColumn(
        "_first",
        F.coalesce(
            F.sum("_copies").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    ).join(_before(totals, keys), [*keys, "_bucket"])
    first = F.col("_before") + F.col("_first")
    return placed.select(
        "_row", F.explode(F.sequence(first, first + F.col("_copies") - 1)).alias(name)
    ).select("_row.*", name)
