"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("testpulse")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_dir()


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="testpulse-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, grouped by application."""
    application = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/testpulse/{application}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table that later steps read several times, and read it back.

    It is computed once, its lineage is cut, and losing an executor loses
    nothing: the rows are in the shared folder, not in executor memory.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str) -> tuple:
    """(path, its file system), of any file system Spark can reach."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Is there anything at a path of any file system Spark can reach?"""
    place, system = _place(spark, path)
    return bool(system.exists(place) and system.listStatus(place))


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds; none if it does not exist."""
    place, system = _place(spark, folder)
    return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []


def matching(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(path, is it a folder?) of what a path matches, which may hold ``*``."""
    place, system = _place(spark, path)
    return [(s.getPath().toString(), s.isDirectory()) for s in system.globStatus(place) or ()]


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    place, system = _place(spark, path)
    stream = system.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole or not at all, in place of an earlier one."""
    place, system = _place(spark, path)
    draft, _ = _place(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = system.create(draft)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not system.rename(draft, place):  # there is an earlier one
        system.delete(place, False)
        if not system.rename(draft, place):
            raise OSError(f"{path} cannot be written")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that this library has written."""
    place, system = _place(spark, path)
    system.delete(place, True)


def unstage(*tables: DataFrame) -> None:
    """Delete tables of :func:`stage` that nothing will read again."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            remove(table.sparkSession, file.rpartition("/")[0])


_STAGED: dict[tuple[str, str], str] = {}


def stage_once(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Like :func:`stage`, but written once per application and then read."""
    key = (spark.sparkContext.applicationId, name)
    path = _STAGED.get(key)
    if path is None or not exists(spark, path + "/_SUCCESS"):
        path = new_folder(spark, "table")
        build().write.parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(path)
