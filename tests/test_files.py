"""Small files listed and read in tasks, against Spark's own reader."""

import json

from testpulse.sources import files, tables

RUN = json.dumps({"run_id": 1, "workflow_name": "CI", "timestamp": "2024-01-01T00:00:00.5+00:00",
                  "jobs": [{"job_id": 1, "name": "a"}]}, indent=1)
DOCUMENTS = [
    RUN.encode(), RUN[:40].encode(), b"", b" \n ", b"null", b"123", b"[]", f"[{RUN},{RUN}]".encode(),
    f"[{RUN},{RUN[:30]}".encode(), f"{RUN} more".encode(), b'{"run_id":"x","workflow_name":"w"}',
    b'{"run_id":null}', b"\xef\xbb\xbf" + RUN.encode(), RUN.encode("utf-16"),
    RUN.replace("CI", "\xe9").encode("latin-1"), b'[{"run_id":5},{"run_id":"x"}]', b"{}", b"hello",
    b'[{"run_id":5},null]', RUN.replace("CI", "Caf\xe9").encode(),
]


def test_run_documents_are_listed_in_tasks_and_read_as_by_spark(spark, tmp_path, monkeypatch):
    for repo in ("o_a b", "o_c"):
        folder = tmp_path / repo / "runs"
        folder.mkdir(parents=True)
        for i, document in enumerate(DOCUMENTS):
            (folder / f"{i}.json").write_bytes(document)
        (folder / "_hidden.json").write_text(RUN)
    path = str(tmp_path / "*" / "runs")

    def read():
        good = tables.read_runs(spark, path)
        bad = tables.unreadable_runs(spark, path).select("repo", "file")
        columns = ["repo", "run_id", "workflow_name", "jobs"]
        return sorted(good.select(*columns).collect(), key=str), sorted(bad.collect(), key=str), good.inputFiles()

    good, bad, listed = read()
    assert not any(name.endswith(".json") for name in listed)  # the driver holds no list of them
    monkeypatch.setattr(tables, "reachable", lambda _: False)
    spark_good, spark_bad, _ = read()
    assert [str(g) for g in good] == [str(g) for g in spark_good]
    assert bad == spark_bad
    assert len(good) > 10 and len(bad) > 10


def test_a_document_with_a_bad_field_is_unreadable(spark, tmp_path):
    (tmp_path / "o_a" / "runs").mkdir(parents=True)
    (tmp_path / "o_a" / "runs" / "5.json").write_text('{"run_id":5,"timestamp":"bad"}')
    path = str(tmp_path / "*" / "runs")
    assert tables.read_runs(spark, path).select("run_id").count() == 0
    assert [tuple(r) for r in tables.unreadable_runs(spark, path).collect()] == [("o_a", "5.json", 1)]


def test_names_come_in_batches_from_folders_and_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "NAMES_PER_BATCH", 3)
    for i in range(10):
        (tmp_path / f"{i}.txt").write_text(str(i) * i)
    for path in (str(tmp_path), str(tmp_path / "*.txt")):
        texts = [r.text for r in files.read_texts(spark, path).collect()]
        assert sorted(texts) == sorted(str(i) * i for i in range(10))
    assert files.read_texts(spark, str(tmp_path / "none*")).count() == 0
