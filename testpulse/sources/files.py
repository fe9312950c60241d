"""Whole small files as rows, listed and read in tasks.

Spark's own readers hold the name and blocks of every file on the driver, which
does not last for millions of small files.  Here the driver knows the folders only; each
is listed by a task, and the names are dealt out by hash to the tasks that read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testpulse.session import matching, stage

FILES_PER_TASK = 20_000
NAMES_PER_BATCH = 10_000
#: Bytes and files that are handed on at once.
BATCH_BYTES, BATCH_FILES = 4 << 20, 1000


def reachable(path: str) -> bool:
    """Can Python open files there, or only Spark's readers?"""
    try:
        _system(path.partition("*")[0])
    except Exception:
        return False
    return True


def _system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def _names(folder: str) -> Iterable[str]:
    """Paths of the files in a folder, without those that Spark's readers pass over."""
    system, inside = _system(folder)
    base = folder.rstrip("/")
    if isinstance(system, pyarrow.fs.LocalFileSystem):
        with os.scandir(inside) as found:
            yield from (f"{base}/{f.name}" for f in found if f.name[0] not in "._" and f.is_file())
        return
    for info in system.get_file_info(pyarrow.fs.FileSelector(inside)):
        if info.is_file and info.base_name[0] not in "._":
            yield f"{base}/{info.base_name}"


def _text(path: str) -> str | None:
    system, inside = _system(path)
    with system.open_input_stream(inside, compression=None) as file:
        raw = file.read()
    try:
        return raw.decode(json.detect_encoding(raw))
    except UnicodeDecodeError:
        return None


def _encoded(path: str) -> str:
    """The path as Spark's readers name it in ``_metadata.file_path``."""
    return re.sub(r'[\x00-\x20"<>\\^`{|}%?#\[\]\x7f]', lambda c: f"%{ord(c[0]):02X}", path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of each file that a path matches, or that lies in a folder that it matches."""
    places = matching(spark, path)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, is_folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names: list[str] = []
                for name in _names(place) if is_folder else [place]:
                    names.append(name)
                    if len(names) == NAMES_PER_BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(names)], ["path"])
                        names = []
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["path"])

    rows = spark.createDataFrame(places, "path string, is_folder boolean")
    tasks = max(1, min(len(places), 4 * spark.sparkContext.defaultParallelism))
    return rows.repartition(tasks).mapInArrow(listed, "path string")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path as Spark names it, text) of each file of :func:`list_files`; the encoding is found out as for JSON, and
    text that is wrong in it is null."""
    names = stage(list_files(spark, path), "file-names")
    tasks = max(spark.sparkContext.defaultParallelism, -(-names.count() // FILES_PER_TASK))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts, size = [], [], 0
            for name in batch.column(0).to_pylist():
                text = _text(name)
                paths.append(_encoded(name))
                texts.append(text)
                size += len(text or "")
                if size >= BATCH_BYTES or len(paths) == BATCH_FILES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts, pa.string())], ["path", "text"])
                    paths, texts, size = [], [], 0
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts, pa.string())], ["path", "text"])

    return names.repartition(tasks, F.col("path")).mapInArrow(read, "path string, text string")
