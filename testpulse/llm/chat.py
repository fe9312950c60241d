"""Chat formatting by perspective rotation.

For every participant of a dialogue the whole dialogue is rendered once more, with that
participant as the assistant and everyone else as a named user.  The mask is 1 on what the
assistant says (and on its end mark), 0 on headers and on everyone else.  Participants
are the roles that speak, but for ``system``, whose messages stay system messages.

The result has one row per message and perspective, with its place, its rendered text
and its span in the rendered dialogue; joined in order of ``place`` the rows are the
dialogue.  So no row and no task holds a whole dialogue, however long one is: numbers
and offsets come from running sums within buckets of a dialogue (``TURNS`` consecutive
turn numbers) and across bucket totals.

Defined results: a message without role is spoken by ``unknown``; a null text is an empty
message; messages without a turn come first; equal turns are ordered by role and text, and
wholly equal messages stay as many as they are; messages without a conversation id are one
conversation; a dialogue in which nobody but the system speaks has no perspective and no
rows; an empty table gives an empty result.  Columns other than the four are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from testpulse.llm.columns import table
from testpulse.session import stage

START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"
UNKNOWN = "unknown"
#: Consecutive turns that are summed together.
TURNS = 256


def _header(role: Column, perspective: Column) -> Column:
    named = F.concat(F.lit("user name="), role)
    said_by = F.when(role == SYSTEM, role).when(role == perspective, F.lit("assistant")).otherwise(named)
    return F.concat(F.lit(START), said_by, F.lit("\n"))


def rotate(messages: DataFrame) -> DataFrame:
    """(conv_id, perspective, place, turn, role, rendered, start, length, mask_start,
    mask_length) from (conv_id, turn, role, text)."""
    said = messages.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(UNKNOWN)).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(2**62))).alias("_bucket"),
    )
    # Written, so that Spark can split the partition of a dialogue with very many messages.
    speakers = stage(
        said.filter(F.col("role") != SYSTEM)
        .select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective"))
        .distinct(),
        "speakers",
    )
    seen = said.join(speakers, said["conv_id"].eqNullSafe(speakers["_conv"])).drop("_conv")
    own = F.col("role") == F.col("perspective")
    header = _header(F.col("role"), F.col("perspective"))
    rendered = F.concat(header, F.col("text"), F.lit(END))
    rows = seen.select(
        "conv_id", "perspective", "_bucket", "turn", "role", "text", rendered.alias("rendered"),
        F.length(rendered).cast("long").alias("length"),
        F.length(header).cast("long").alias("_header"),
        own.alias("_own"),
    )
    key = ["conv_id", "perspective"]
    across = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*key, "_bucket").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("length").alias("_length")
    ).select(
        F.col("conv_id").alias("_conv"), F.col("perspective").alias("_as"), F.col("_bucket").alias("_of"),
        F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_length").over(across), F.lit(0)).alias("_before"),
    )
    order = [F.asc_nulls_first("turn"), "role", "text"]
    within = Window.partitionBy(*key, "_bucket").orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumns(
        {
            "_place": F.row_number().over(within) - 1,
            "_start": F.coalesce(F.sum("length").over(earlier), F.lit(0)),
        }
    )
    same = (
        numbered["conv_id"].eqNullSafe(totals["_conv"])
        & (numbered["perspective"] == totals["_as"])
        & (numbered["_bucket"] == totals["_of"])
    )
    start = F.col("_before") + F.col("_start")
    return numbered.join(totals, same).select(
        "conv_id",
        "perspective",
        (F.col("_rows_before") + F.col("_place")).cast("long").alias("place"),
        "turn",
        "role",
        "rendered",
        start.alias("start"),
        "length",
        F.when(F.col("_own"), start + F.col("_header")).alias("mask_start"),
        F.when(F.col("_own"), F.col("length") - F.col("_header")).otherwise(0).alias("mask_length"),
    )


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return rotate(table(spark, folder, "conversations"))


def sql() -> str:
    return f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '{UNKNOWN}') AS role, coalesce(text, '') AS text
  FROM conversations),
speakers AS (
  SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> '{SYSTEM}'),
worded AS (
  SELECT s.*, perspective, '{START}' || CASE WHEN role = '{SYSTEM}' THEN role
      WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS header
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
rendered AS (
  SELECT *, header || text || '{END.strip()}' || chr(10) AS rendered FROM worded),
placed AS (
  SELECT *, row_number() OVER w - 1 AS place,
    coalesce(sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM rendered
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, perspective, place, turn, role, rendered, start, length(rendered) AS length,
  CASE WHEN role = perspective THEN start + length(header) END AS mask_start,
  CASE WHEN role = perspective THEN length(rendered) - length(header) ELSE 0 END AS mask_length
FROM placed
"""
