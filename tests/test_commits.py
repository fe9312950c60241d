"""Batch tables, keyed tables, and the archive data source on small files."""

import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from testpulse.operators import stats as S
from testpulse.session import names_in, new_folder
from testpulse.sources import archives as A
from testpulse.sources import commits, sinks, ziplogs
from testpulse.streaming import ingest as I


def rows(spark, *items):
    return spark.createDataFrame(list(items), "k string, v bigint")


def test_batches_replace_themselves(spark):
    path = new_folder(spark, "batches")
    commits.write_batch(rows(spark, ("a", 1)), path, "x/1", ("k",))
    commits.write_batch(rows(spark, ("b", 2)), path, "y", ("k",))
    commits.write_batch(rows(spark, ("c", 3), ("d", 4)), path, "x/1", ("k",))
    # a try that was cut short: rows without a commit file
    rows(spark, ("lost", 9)).write.partitionBy("k").parquet(f"{path}/rows/try=half")
    got = commits.read_batches(spark, path, "k string, v bigint")
    assert sorted(map(tuple, got.collect())) == [("b", 2, "y"), ("c", 3, "x/1"), ("d", 4, "x/1")]
    nothing = commits.read_batches(spark, new_folder(spark, "none"), "k string, v bigint")
    assert nothing.count() == 0


def test_sinks_count_once(spark):
    path = new_folder(spark, "ledger")
    entries = spark.createDataFrame([("r", 1), ("r", 2)], "repo string, run_id bigint")
    for _ in range(2):
        sinks.write_ledger(entries, path, "one")
    sinks.write_ledger(entries, path)  # a batch of its own
    assert sinks.read_ledger(spark, path).count() == 4


def test_fifty_versions_have_one_live_row_a_key(spark):
    draw, path, true = random.Random(2), new_folder(spark, "keyed"), {}
    for version in range(50):
        fresh = {f"k{draw.randrange(30)}": version * 100 + i for i in range(3)}
        true |= fresh
        commits.upsert(rows(spark, *fresh.items()), path, ["k"], version, buckets=8)
        if version % 20 == 7:  # the same batch again
            commits.upsert(rows(spark, *fresh.items()), path, ["k"], version, buckets=8)
    read = commits.read_keyed(spark, path)
    assert {r.k: r.v for r in read.collect()} == true and read.count() == len(true)
    assert len({f.rpartition("/")[0] for f in read.inputFiles()}) <= 8
    # A batch opens the buckets of its keys only, and no other version of them.
    wanted = rows(spark, ("k1", 0))
    known = commits.known_rows(wanted, path, ["k"])
    assert len({f.rpartition("/")[0] for f in known.inputFiles()}) == 1
    assert len(names_in(spark, f"{path}/commits")) <= commits.KEPT_COMMITS
    commits.vacuum(spark, path)
    assert {r.k: r.v for r in commits.read_keyed(spark, path).collect()} == true
    assert len(names_in(spark, f"{path}/rows")) <= 8 * commits.KEPT_COMMITS


def test_null_keys_and_empty_versions(spark):
    path = new_folder(spark, "keyed")
    commits.upsert(rows(spark).limit(0), path, ["k"], 0, buckets=4)
    assert commits.read_keyed(spark, path).count() == 0
    commits.upsert(rows(spark, (None, 1), ("a", 2)), path, ["k"], 1)
    commits.upsert(rows(spark, (None, 3)), path, ["k"], 2)
    assert sorted((r.k or "", r.v) for r in commits.read_keyed(spark, path).collect()) == [("", 3), ("a", 2)]


def test_repeated_stream_batch_changes_nothing(spark, make_results):
    """The totals of a batch whose commit is there already are the same after a repetition."""
    results = make_results([(f"t{i % 3}", "FAILED" if i % 2 else "PASSED", f"m{i % 4}", i) for i in range(40)])
    source, table, checkpoint = (new_folder(spark, n) for n in ("in", "out", "cp"))
    for part in range(4):
        results.filter(F.col("result_ord") % 4 == part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(results.schema).parquet(source)
        I.accumulate_stats(stream, table, checkpoint, 4).awaitTermination()
        if part == 2:  # Spark forgets that the last batch was done, and repeats it
            last = max(int(n) for n in names_in(spark, f"{checkpoint}/commits") if n.isdigit())
            for name in (f"{last}", f".{last}.crc"):
                os.remove(f"{checkpoint.removeprefix('file://')}/commits/{name}")
            stream = spark.readStream.schema(results.schema).parquet(source)
            I.accumulate_stats(stream, table, checkpoint, 4).awaitTermination()
    counts = {r.test_name: (r.total_executions, r.total_failures) for r in I.merged_counts(spark, table).collect()}
    true = S.execution_stats(results).collect()
    assert counts == {r.test_name: (r.total_executions, r.total_failures) for r in true}
    merged = {(r.test_name, r.signature_hash): r["count"] for r in I.merged_signatures(spark, table).collect()}
    assert merged == {(r.test_name, r.signature_hash): r["count"] for r in S.signatures(results).collect()}


def archive(folder, run, files, break_at=None):
    os.makedirs(folder, exist_ok=True)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as out:
        for name, text in files:
            out.writestr(name, text)
    raw = bytearray(buffer.getvalue())
    if break_at is not None:
        raw[break_at] ^= 1
    with open(f"{folder}/{run}.zip", "wb") as file:
        file.write(raw)


def test_large_archives_are_split(spark, tmp_path, monkeypatch):
    """Files of one archive go to several tasks, and a file larger than what is held is read."""
    draw = random.Random(1)
    files = [(f"{i}.txt", "".join(f"{draw.random()}\n" for _ in range(500))) for i in range(12)]
    archive(f"{tmp_path}/r/logs", 7, files)
    archive(f"{tmp_path}/r/logs", 8, [("a.txt", "x\ny")])
    monkeypatch.setattr(ziplogs, "TASK_BYTES", 20_000)
    monkeypatch.setattr(ziplogs, "HELD", 1000)
    reader = ziplogs.Reader({"path": f"{tmp_path}/*/logs"})
    groups = reader.partitions()
    parts = [f for g in groups for f in g.found if f.run_id == 7]
    assert len(groups) > 2 and len(parts) > 2 and [f.first for f in parts].count(True) == 1
    assert [n for f in parts for n in f.names] == [n for n, _ in files]
    read = [r for g in groups for batch in reader.read(g) for r in batch.to_pylist()]
    text = {}
    for r in read:
        if r["piece"] is not None:
            text[(r["run_id"], r["filename"])] = text.get((r["run_id"], r["filename"]), "") + r["piece"] + "\n"
    assert text == {(7, n): t for n, t in files} | {(8, "a.txt"): "x\ny\n"}
    states = [(r["run_id"], r["status"], r["n_entries"]) for r in read if r["filename"] is None]
    assert sorted(states) == [(7, "ok", 12), (8, "ok", 1)]


def test_tasks_hold_few_archives_however_small(tmp_path, monkeypatch):
    for run in range(10):
        archive(f"{tmp_path}/r/logs", run, [("a.txt", f"line {run}")])
    monkeypatch.setattr(ziplogs, "TASK_ARCHIVES", 4, raising=False)
    reader = ziplogs.Reader({"path": f"{tmp_path}/*/logs"})
    groups = reader.partitions()
    assert [len(g.found) for g in groups] == [4, 4, 2]
    read = [r for g in groups for batch in reader.read(g) for r in batch.to_pylist()]
    assert sorted(r["piece"] for r in read if r["piece"]) == [f"line {run}" for run in range(10)]
    assert ziplogs.TASK_BYTES <= 16 << 20  # text unpacks to many times that


def test_conditions_are_pushed_to_the_listing(spark, tmp_path):
    for repo in ("a", "b"):
        for run in (1, 2, 3):
            archive(f"{tmp_path}/{repo}/logs", run, [("x.txt", f"{repo}{run}")])
    (tmp_path / "b" / "logs" / "3.zip").write_bytes(b"never opened")
    read = ziplogs.read_archives(spark, f"{tmp_path}/*/logs")
    some = A.zipped_lines(read.filter("repo = 'b' AND run_id < 3"))
    assert sorted(r.line for r in some.collect()) == ["b1", "b2"]
    plan = read.filter("repo = 'b' AND run_id IN (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan  # all of it is left to the source
    states = {(r.repo, r.run_id): r.status for r in A.zip_states(spark, f"{tmp_path}/*/logs").collect()}
    assert states[("b", 3)] == "corrupt" and list(states.values()).count("ok") == 5


def test_states_read_the_directory_only(tmp_path, monkeypatch):
    """Bytes read for a state do not grow with the archive."""
    small, large = "x" * 1000, "".join(str(random.Random(3).random()) for _ in range(100_000))
    read = {}
    for run, text in ((1, small), (2, large)):
        archive(f"{tmp_path}/r/logs", run, [("a.txt", text)])
        with open(f"{tmp_path}/r/logs/{run}.zip", "rb") as raw:
            class Counted(io.RawIOBase):
                n = 0

                def readinto(self, into, raw=raw):
                    got = raw.readinto(into)
                    Counted.n += got
                    return got

                def seek(self, *a, raw=raw):
                    return raw.seek(*a)

                def tell(self, raw=raw):
                    return raw.tell()

                def seekable(self):
                    return True

                def readable(self):
                    return True

            zipfile.ZipFile(Counted())
            read[run] = Counted.n
    assert read[2] <= read[1] + 100 < 2000
    reader = ziplogs.Reader({"path": f"{tmp_path}/*/logs", "contents": "false"})
    (group,) = reader.partitions()
    assert [r["status"] for b in reader.read(group) for r in b.to_pylist()] == ["ok", "ok"]


@pytest.mark.parametrize("piece", [1, 7, 100, 10**6])
def test_pieces_hold_whole_lines(piece):
    draw = random.Random(piece)
    text = "".join(draw.choice(["a", "\n", "bc", "\n\n", "x" * 50]) for _ in range(300))
    for whole in (text, text + "\n", "", "\n", "no end", "\n\n"):
        parts = [whole[i : i + 9] for i in range(0, len(whole), 9)]
        lines = []
        for number, cut in ziplogs.cut_lines(parts, piece):
            assert number == len(lines)
            lines += cut.split("\n")
        assert lines == (whole[:-1] if whole.endswith("\n") else whole).split("\n") if whole else lines == []
