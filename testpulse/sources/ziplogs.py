"""Data source ``ci_archives``: zipped job logs, read by seek.

The directory of an archive lies at its end.  It tells the archive's state and its files, so
states cost a few kilobytes an archive, whatever its size.  Files are unpacked where Spark
has dealt them out: small archives in groups, the files of a large one over several tasks.
No archive is ever one value.  Conditions on repo and run are pushed down to the listing:
archives of other runs are never opened.

Rows are of three kinds:

* an archive (``status`` ``ok``, ``empty`` or ``corrupt``, ``n_entries``; no ``filename``);
* a file in it (``status`` ``ok`` or ``error``, ``n_bytes``), ``error`` if it cannot be unpacked or has
  a wrong checksum;
* a piece of a good file (no ``status``): ``first_line`` is the number of the line that it begins with.
  Pieces are cut at line ends.  Text is UTF-8, bad bytes are replaced.  Of entries with one
  name the last one counts, at the place of the first.

A file is unpacked once, checked, and then handed on; only one of over ``HELD`` bytes is
unpacked once more for that, as it is not held in memory.

Paths are those of ``pyarrow.fs`` (local, S3, HDFS, GCS); archives in a store that only Spark's
readers reach come through :func:`testpulse.sources.archives.scan_archives`.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, LessThan, LessThanOrEqual,
)

FORMAT = "ci_archives"
ROWS = (
    "repo string, run_id bigint, archive string, filename string, entry_ord int, first_line bigint, "
    "piece string, status string, n_entries bigint, n_bytes bigint"
)
NAMES = [c.split()[0] for c in ROWS.split(", ")]
ARROW = pa.schema(
    [(n, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[c.split()[1]])
     for n, c in zip(NAMES, ROWS.split(", "), strict=True)]
)
#: Compressed bytes that a task reads, roughly, and archives, however small; archives for which
#: only the state is asked.  Text unpacks to many times its size, and its lines are sorted
#: where a table of them is written.
TASK_BYTES = 8 << 20
TASK_ARCHIVES = 5000
TASK_STATES = 1000
#: Unpacked bytes of a file that are held in memory, and characters of a piece.
HELD = 64 << 20
PIECE = 1 << 20


class Found(NamedTuple):
    path: str
    repo: str
    run_id: int
    size: int
    names: list[str] | None  # the files to read; None for all of them
    first: bool  # is this the part that tells the archive's state?


@dataclass
class Group(InputPartition):
    """What one task reads."""

    found: list[Found]


class _Seekable(io.RawIOBase):
    """A file of pyarrow with Python's errors, as ``zipfile`` expects them."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self.file.seek(offset, whence)
        except ValueError as wrong:
            raise OSError(str(wrong)) from wrong

    def tell(self) -> int:
        return self.file.tell()

    def close(self) -> None:
        self.file.close()
        super().close()

    def readinto(self, into) -> int:
        got = self.file.read(len(into))
        into[: len(got)] = got
        return len(got)


def _opened(system: pyarrow.fs.FileSystem, path: str) -> io.BufferedReader:
    return io.BufferedReader(_Seekable(system.open_input_file(path)), 1 << 16)


def cut_lines(text: Iterable[str], piece: int = PIECE) -> Iterator[tuple[int, str]]:
    """(number of its first line, whole lines) of a text that comes in parts."""
    waiting: list[str] = []
    number = size = 0
    for part in text:
        lines, end, rest = part.rpartition("\n")
        if not end:
            waiting.append(rest)
            size += len(rest)
            continue
        waiting.append(lines)
        size += len(lines)
        if size < piece:  # too short to hand on: goes on with the line end put back
            waiting.append("\n" + rest)
            size += len(rest) + 1
            continue
        whole = "".join(waiting)
        yield number, whole
        number += whole.count("\n") + 1
        waiting, size = [rest], len(rest)
    whole = "".join(waiting)
    if whole.endswith("\n"):
        whole = whole[:-1]
    elif not whole:
        return
    yield number, whole


def _read_parts(raw) -> Iterator[str]:
    text = io.TextIOWrapper(raw, encoding="utf-8", errors="replace")
    return iter(lambda: text.read(PIECE), "")


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.contents = options.get("contents", "true").lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        kinds = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for one in filters:
            if type(one) not in (IsNotNull, *kinds) or one.attribute not in (("repo",), ("run_id",)):
                yield one
            elif type(one) in kinds:  # both are never null
                self.tests.append((one.attribute[0], kinds[type(one)], one.value))

    def _wanted(self, repo: str, run_id: int) -> bool:
        for column, kind, value in self.tests:
            own = repo if column == "repo" else run_id
            holds = {
                "=": lambda a, b: a == b, "in": lambda a, b: a in b, ">": lambda a, b: a > b,
                ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
            }[kind](own, value)
            if not holds:
                return False
        return True

    def _system(self) -> tuple[pyarrow.fs.FileSystem, str]:
        path = re.sub(r"^file:/+", "/", self.path)
        if "://" not in path:
            return pyarrow.fs.LocalFileSystem(), path
        base, _, rest = path.partition("://")
        store, _, inside = rest.partition("/")
        system, root = pyarrow.fs.FileSystem.from_uri(f"{base}://{store}/")
        return system, f"{root.rstrip('/')}/{inside}"

    def _listed(self) -> tuple[pyarrow.fs.FileSystem, list[Found]]:
        """Archives ``<repo>/logs/<run id>.zip`` below the path, which may hold ``*``."""
        system, path = self._system()
        path = path.rstrip("/")
        fixed = re.split(r"/[^/]*\*", path)[0]
        shape = re.compile("".join("[^/]*" if c == "*" else re.escape(c) for c in path) + "/(.*/)?[^/]+")
        found = []
        for info in system.get_file_info(pyarrow.fs.FileSelector(fixed, recursive=True, allow_not_found=True)):
            named = re.search(r"(?:^|/)([^/]+)/logs/(\d+)\.zip$", info.path)
            if info.is_file and named and shape.fullmatch(info.path) and self._wanted(named[1], int(named[2])):
                found.append(Found(info.path, named[1], int(named[2]), info.size, None, True))
        return system, sorted(found)

    def _split(self, system: pyarrow.fs.FileSystem, one: Found) -> Iterator[Found]:
        """A large archive in parts of about TASK_BYTES, by the directory at its end."""
        try:
            with _opened(system, one.path) as file, zipfile.ZipFile(file) as archive:
                names = list(dict.fromkeys(archive.namelist()))
                sizes = [archive.getinfo(n).compress_size for n in names]
        except Exception:  # its state is found out where it is read
            yield one
            return
        part, size, first = [], 0, True
        for name, own in zip(names, sizes, strict=True):
            if part and size + own > TASK_BYTES:
                yield one._replace(names=part, size=size, first=first)
                part, size, first = [], 0, False
            part.append(name)
            size += own
        yield one._replace(names=part, size=size, first=first)

    def partitions(self) -> list[Group]:
        system, found = self._listed()
        groups: list[Group] = []
        group, size = [], 0
        for whole in found:
            parts = self._split(system, whole) if self.contents and whole.size > TASK_BYTES else [whole]
            for one in parts:
                full = len(group) >= (TASK_ARCHIVES if self.contents else TASK_STATES) or (
                    self.contents and size + one.size > TASK_BYTES
                )
                if group and full:
                    groups.append(Group(group))
                    group, size = [], 0
                group.append(one)
                size += one.size
        return [*groups, Group(group)] if group or not groups else groups

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        rows: list[tuple] = []
        held = 0
        for one in partition.found:
            for row in self._rows(system, one):
                rows.append(row)
                held += len(row[6] or "")
                if held >= 4 * PIECE or len(rows) >= 10_000:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, system: pyarrow.fs.FileSystem, one: Found) -> Iterator[tuple]:
        named = (one.repo, one.run_id, one.path.rpartition("/")[2])
        with _opened(system, one.path) as file:
            try:
                archive = zipfile.ZipFile(file)
                every = list(dict.fromkeys(archive.namelist()))
            except Exception:
                yield (*named, None, None, None, None, "corrupt", 0, None)
                return
            if one.first:
                state = "ok" if every else "empty"
                yield (*named, None, None, None, None, state, len(archive.namelist()), None)
            if not self.contents:
                return
            places = {n: i for i, n in enumerate(every)}
            for name in every if one.names is None else one.names:
                yield from _entry(archive, named, name, places[name])


def _entry(archive: zipfile.ZipFile, named: tuple, name: str, place: int) -> Iterator[tuple]:
    size = archive.getinfo(name).file_size
    try:
        if size <= HELD:
            raw = io.BytesIO(archive.read(name))
        else:
            with archive.open(name) as check:
                while check.read(PIECE):
                    pass
            raw = archive.open(name)
    except Exception:  # a file that cannot be unpacked or has a wrong checksum
        yield (*named, name, place, None, None, "error", None, size)
        return
    with raw:
        for number, piece in cut_lines(_read_parts(raw)):
            yield (*named, name, place, number, piece, None, None, None)
    yield (*named, name, place, None, None, "ok", None, size)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read_archives(spark: SparkSession, path: str, contents: bool = True) -> DataFrame:
    """The rows of all archives ``<repo>/logs/<run id>.zip`` below a path; without ``contents``
    their states only."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Archives)
    return spark.read.format(FORMAT).option("contents", str(contents).lower()).load(path)
