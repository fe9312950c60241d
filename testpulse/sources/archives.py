"""Zipped job logs: archive state and lines.

Archives are read by seek through :mod:`testpulse.sources.ziplogs`: states from the directory
at an archive's end, files unpacked once and cut into pieces that the JVM splits into
lines.  :func:`compact_logs` does that once, into a table of lines and one of files.

Archives in a store that only Spark's readers reach can be read as binary rows instead
(:func:`scan_archives`, up to 2 GB each).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testpulse.sources import commits
from testpulse.sources.ziplogs import PIECE, cut_lines, read_archives

STATE = "repo string, run_id bigint, archive string, status string, n_entries bigint"
PIECES = (
    "repo string, run_id bigint, filename string, entry_ord int, first_line bigint, piece string"
)
LINE = "repo string, run_id bigint, filename string, entry_ord int, line_no bigint, line string"
FILE = (
    "repo string, run_id bigint, archive string, filename string, entry_ord int, status string, "
    "n_entries bigint, n_bytes bigint"
)


def scan_archives(spark: SparkSession, path: str, runs: DataFrame | None = None) -> DataFrame:
    """Archives ``<repo>/logs/<run id>.zip`` as binary rows.

    With ``runs`` (repo, run_id) only theirs: the names are listed first, and the other
    files are never opened.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    at = F.col("path")
    named = files.select(
        F.regexp_extract(at, r"([^/]+)/logs/[^/]+$", 1).alias("repo"),
        F.regexp_extract(at, r"(\d+)\.zip$", 1).cast("bigint").alias("run_id"),
        F.regexp_extract(at, r"([^/]+)$", 1).alias("archive"),
        "path",
        "content",
    )
    if runs is None:
        return named.drop("path")
    wanted = named.drop("content").join(runs.select("repo", "run_id"), ["repo", "run_id"], "left_semi")
    return wanted.join(named.select("path", "content"), "path").drop("path")


def _opened(content: bytes | None):
    """(archive, state): ``ok``, ``empty``, ``corrupt`` (not an archive) or ``error`` (a
    file in it cannot be unpacked or has a wrong checksum)."""
    import io
    import zipfile

    try:
        archive = zipfile.ZipFile(io.BytesIO(content or b""))
    except Exception:
        return None, "corrupt"
    try:
        if archive.testzip() is not None:
            return archive, "error"
    except Exception:
        return archive, "error"
    return archive, "ok" if archive.namelist() else "empty"


def archive_states(archives: DataFrame) -> DataFrame:
    """State of each archive, see :func:`_opened`; ``n_entries`` is 0 if it is not readable."""

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for content in batch.column(3):
                archive, state = _opened(content.as_py())
                found.append((state, len(archive.namelist()) if state == "ok" else 0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([s for s, _ in found], pa.string()),
                 pa.array([n for _, n in found], pa.int64())],
                ["repo", "run_id", "archive", "status", "n_entries"],
            )

    return archives.select("repo", "run_id", "archive", "content").mapInArrow(states, STATE)


def archive_lines(archives: DataFrame) -> DataFrame:
    """One row per line of each file in each archive whose state is ``ok``; the others are
    counted by :func:`archive_states`.

    Text is UTF-8, bad bytes are replaced.  Of entries with one name the last
    one counts, at the place of the first.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for batch in batches:
            for i in range(batch.num_rows):
                archive, state = _opened(batch.column(2)[i].as_py())
                if state != "ok":
                    continue
                for place, name in enumerate(dict.fromkeys(archive.namelist())):
                    with archive.open(name) as raw:
                        text = io.TextIOWrapper(raw, encoding="utf-8", errors="replace")
                        for number, piece in cut_lines(iter(lambda: text.read(PIECE), "")):  # noqa: B023
                            yield _piece(batch, i, name, place, number, piece)

    return split_pieces(archives.select("repo", "run_id", "content").mapInArrow(pieces, PIECES))


def split_pieces(pieces: DataFrame) -> DataFrame:
    """One row per line of pieces of files."""
    split = F.posexplode(F.split("piece", "\n")).alias("_at", "line")
    return pieces.select("repo", "run_id", "filename", "entry_ord", "first_line", split).select(
        "repo", "run_id", "filename", "entry_ord",
        (F.col("first_line") + F.col("_at")).alias("line_no"), "line",
    )


def _piece(batch: pa.RecordBatch, i: int, name: str, place: int, number: int, text: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([name]),
         pa.array([place], pa.int32()), pa.array([number], pa.int64()), pa.array([text], pa.string())],
        ["repo", "run_id", "filename", "entry_ord", "first_line", "piece"],
    )


def zipped_lines(read: DataFrame) -> DataFrame:
    """One row per line of each good file, from the rows of the data source."""
    return split_pieces(read.filter(F.col("piece").isNotNull()))


def zip_states(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """State of each archive below a path, from the directories at their ends.

    With ``files``, the table of files that :func:`compact_logs` has written, an archive with a
    file that could not be read is in state ``error``, and ``n_entries`` is 0 for it.
    """
    states = read_archives(spark, path, contents=False).select(
        "repo", "run_id", "archive", "status", "n_entries"
    )
    if files is None:
        return states
    bad = files.filter("status = 'error' AND filename IS NOT NULL").select(
        "repo", "run_id", "archive", F.lit(True).alias("_bad")
    ).distinct()
    failed = F.coalesce("_bad", F.lit(False))
    return states.join(bad, ["repo", "run_id", "archive"], "left").select(
        "repo", "run_id", "archive",
        F.when(failed, "error").otherwise(F.col("status")).alias("status"),
        F.when(failed, 0).otherwise(F.col("n_entries")).alias("n_entries"),
    )


def compact_logs(
    spark: SparkSession, source: str, target: str, runs: DataFrame | None = None, batch: str | None = None
) -> None:
    """Unzip archives (of ``runs`` only, if given) once into a table; an analysis reads lines
    several times and should not unzip each time.

    One pass writes lines (:func:`compacted_lines`) and files with their state
    (:func:`compacted_files`).  It is one batch, named by the source if not given: writing it
    again replaces it.
    """
    read = read_archives(spark, source)
    if runs is not None:
        read = read.join(runs.select("repo", "run_id").distinct(), ["repo", "run_id"], "left_semi")
    line = F.when(F.col("piece").isNotNull(), F.split("piece", "\n")).otherwise(F.array(F.lit(None).cast("string")))
    split = F.posexplode(line).alias("_at", "line")
    rows = read.select(*[c for c in read.columns if c != "piece"], split).select(
        "*", (F.col("first_line") + F.col("_at")).alias("line_no"),
        F.when(F.col("status").isNull(), "line").otherwise("file").alias("kind"),
    )
    commits.write_batch(rows.drop("first_line", "_at"), target, source if batch is None else batch, ("kind", "repo"))


def compacted_lines(spark: SparkSession, table: str) -> DataFrame:
    """Lines that :func:`compact_logs` has written, of all batches."""
    kept = commits.read_batches(spark, table, f"{LINE}, kind string")
    return kept.filter("kind = 'line'").drop("kind", "batch_name")


def compacted_files(spark: SparkSession, table: str) -> DataFrame:
    """Archives (no ``filename``) and files with their state."""
    kept = commits.read_batches(spark, table, f"{FILE}, kind string")
    return kept.filter("kind = 'file'").drop("kind", "batch_name")


def run_archives(states: DataFrame) -> DataFrame:
    """Archive state per run, for the data-quality counters."""
    return states.select("repo", "run_id", "archive", "status")
