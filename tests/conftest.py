import datetime
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from testpulse.session import local_session  # noqa: E402

START = datetime.datetime(2024, 1, 1)
RESULT_COLUMNS = (
    "result_ord bigint, repo string, run_id bigint, test_name string, status string, "
    "error_message string, stack_trace string, workflow_name string, timestamp timestamp_ntz"
)
RUN_COLUMNS = (
    "repo string, run_id bigint, workflow_name string, status string, conclusion string, "
    "timestamp timestamp_ntz, html_url string, "
    "jobs array<struct<job_id:bigint,name:string,conclusion:string,logs_url:string>>"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_results(spark):
    """Results from (test_name, status, message[, run_id]) tuples, in order."""

    def make(rows, repo="org/app"):
        full = []
        for i, row in enumerate(rows):
            name, status, message, *rest = row
            run = rest[0] if rest else i
            workflow = rest[1] if len(rest) > 1 else "CI"
            full.append((i, repo, run, name, status, message, "", workflow,
                         START + datetime.timedelta(hours=run)))
        return spark.createDataFrame(full, RESULT_COLUMNS)

    return make


@pytest.fixture(scope="session")
def make_runs(spark):
    """Runs from (repo, run_id, conclusion[, workflow]) tuples."""

    def make(rows):
        full = []
        for repo, run_id, conclusion, *rest in rows:
            workflow = rest[0] if rest else "CI"
            jobs = rest[1] if len(rest) > 1 else [(run_id * 10, "test (3.11)", conclusion, "")]
            full.append((repo, run_id, workflow, "completed", conclusion,
                         START + datetime.timedelta(hours=run_id), "", jobs))
        return spark.createDataFrame(full, RUN_COLUMNS)

    return make


@pytest.fixture(scope="session")
def make_lines(spark):
    """Log lines from {(run_id, filename): text}."""

    def make(logs, repo="org/app"):
        rows = []
        for place, ((run_id, filename), text) in enumerate(logs.items()):
            for number, line in enumerate(text.split("\n")):
                rows.append((repo, run_id, filename, place, number, line))
        return spark.createDataFrame(
            rows, "repo string, run_id bigint, filename string, entry_ord int, "
                  "line_no bigint, line string")

    return make
