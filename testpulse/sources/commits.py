"""Tables that survive repeated and half-done writes: rows first, a commit file last.

Two kinds are kept as plain Parquet folders:

* a *batch table* (:func:`write_batch`) holds one folder per try of a batch.  The commit
  file of a batch names the try that counts, so a batch that is written again replaces
  itself, and one that was cut short is never read;
* a *keyed table* (:func:`upsert`) holds one row per key.  Keys are dealt to buckets by
  hash, every bucket has one live version, and a batch rewrites the buckets of its keys
  only.  The newest commit lists the live version of every bucket: what a reader or a
  batch opens depends on the buckets, not on the number of earlier batches.

One writer at a time, like for any table that a stream writes.
"""

from __future__ import annotations

import json
import uuid
from hashlib import sha1
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from testpulse.session import names_in, read_small, remove, write_small

BUCKETS = 64
#: Commits of a keyed table that stay; the one before a batch is needed to repeat it.
KEPT_COMMITS = 8


def write_batch(
    rows: DataFrame, path: str, batch: str | None = None, partition_by: tuple[str, ...] = (), fmt: str = "parquet"
) -> None:
    """Add a batch to a table, or put it in the place of the batch of that name.

    Without a name it is a batch of its own."""
    spark, attempt = rows.sparkSession, uuid.uuid4().hex
    name = attempt if batch is None else str(batch)
    rows.write.format(fmt).partitionBy(*partition_by).save(f"{path}/rows/try={attempt}")
    mark = json.dumps({"batch": name, "try": attempt})
    write_small(spark, f"{path}/commits/{sha1(name.encode()).hexdigest()}.json", mark)


def read_batches(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """All committed batches of a table, with the batch's name in ``batch_name``.

    The commit files, one short row a batch, name the folders to read; others are not opened.
    """
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if not any(n.endswith(".json") for n in names_in(spark, f"{path}/commits")):
        return spark.createDataFrame([], kind).withColumn("batch_name", F.lit(None).cast("string"))
    marks = spark.read.schema("batch string, try string").json(f"{path}/commits/*.json")
    folders = [f"{path}/rows/try={r['try']}" for r in marks.collect()]
    rows = (
        spark.read.format(fmt)
        .schema(T.StructType([*kind.fields, T.StructField("try", T.StringType())]))
        .option("basePath", f"{path}/rows")
        .load(folders)
    )
    names = F.broadcast(marks.select(F.col("batch").alias("batch_name"), F.col("try").alias("_try")))
    return rows.join(names, F.col("try") == F.col("_try")).select(*kind.names, "batch_name")


class Live(NamedTuple):
    """What a commit says: number of buckets, live version of each that has one, columns."""

    buckets: int
    versions: dict[int, int]
    schema: T.StructType


def _commits(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in names_in(spark, f"{path}/commits") if n.isdigit())


def _said(spark: SparkSession, path: str, version: int) -> Live:
    said = json.loads(read_small(spark, f"{path}/commits/{version}"))
    versions = {int(b): v for b, v in said["versions"].items()}
    return Live(said["buckets"], versions, T.StructType.fromJson(said["schema"]))


def live(spark: SparkSession, path: str, before: int | None = None) -> Live | None:
    """The newest commit (of those before a version, if given)."""
    found = [v for v in _commits(spark, path) if before is None or v < before]
    return _said(spark, path, found[-1]) if found else None


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, at: Live, buckets: list[int] | None) -> DataFrame:
    wanted = [b for b in at.versions if buckets is None or b in set(buckets)]
    if not wanted:
        return spark.createDataFrame([], at.schema)
    folders = [f"{path}/rows/version={at.versions[b]}/bucket={b}" for b in wanted]
    return spark.read.schema(at.schema).parquet(*folders)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The live rows; only folders that hold them are opened."""
    at = live(spark, path)
    if at is None:
        raise ValueError(f"{path} has no committed version")
    return _read(spark, path, at, None)


def known_rows(wanted: DataFrame, path: str, keys: list[str], before: int | None = None) -> DataFrame | None:
    """The live rows in the buckets of the wanted keys, as of a commit before a version, if
    given; other buckets are not opened.  None for a table without a commit."""
    spark = wanted.sparkSession
    at = live(spark, path, before)
    if at is None:
        return None
    buckets = wanted.select(bucket_of(keys, at.buckets)).distinct().collect()  # bounded by their number
    return _read(spark, path, at, [b[0] for b in buckets])


def upsert(rows: DataFrame, path: str, keys: list[str], version: int, buckets: int = BUCKETS) -> None:
    """Put rows, one per key, into a keyed table as one version, in the place of earlier rows
    of their keys.

    A version that is written again starts from the commit before it, so the effect is that of
    writing it once.  The number of buckets is that of the first version.
    """
    spark, schema = rows.sparkSession, rows.schema
    at = live(spark, path, before=version) or Live(buckets, {}, schema)
    bucket = bucket_of(keys, at.buckets)
    fresh = f"{path}/changes/version={version}"
    rows.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(fresh)
    touched = [int(n.partition("=")[2]) for n in names_in(spark, fresh) if n.startswith("_bucket=")]
    versions = dict(at.versions)
    if touched:
        new = spark.read.schema(schema).parquet(*[f"{fresh}/_bucket={b}" for b in touched])
        old = _read(spark, path, at, touched)
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"new.{k}").eqNullSafe(F.col(f"old.{k}"))
        merged = new.unionByName(old.alias("old").join(new.alias("new"), same, "left_anti"))
        (
            merged.withColumn("bucket", bucket)
            .repartition("bucket")
            .write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(f"{path}/rows/version={version}")
        )
        versions |= dict.fromkeys(touched, version)
    said = {
        "buckets": at.buckets,
        "versions": {str(b): v for b, v in sorted(versions.items())},
        "schema": schema.jsonValue(),
    }
    write_small(spark, f"{path}/commits/{version}", json.dumps(said))
    for old_commit in _commits(spark, path)[:-KEPT_COMMITS]:
        remove(spark, f"{path}/commits/{old_commit}")


def vacuum(spark: SparkSession, path: str) -> None:
    """Remove rows that no kept commit of a keyed table names.  Run it between streams."""
    kept = {v for c in _commits(spark, path) for v in _said(spark, path, c).versions.values()}
    for kind in ("rows", "changes"):
        for name in names_in(spark, f"{path}/{kind}"):
            version = name.partition("=")[2]
            if version.isdigit() and int(version) not in kept:
                remove(spark, f"{path}/{kind}/{name}")
