"""Every registered query against its SQL, and what the entry module promises."""

import pathlib

import compare
import pytest

import __spark_entry__ as entry
from testpulse.catalog import REGISTRY

FOLDER = f"{compare.DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return compare.connection(FOLDER)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_sql(spark, con, name):
    assert compare.check(spark, con, name, REGISTRY[name], FOLDER) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
