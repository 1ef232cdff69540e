"""Registered queries against their SQL on the smallest data, and the driver contract."""

import importlib
import os

import pytest

from workload import all_queries
from workload.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES = all_queries()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def oracle():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, oracle, name):
    outcome, detail = compare(spark, oracle, FOLDER, QUERIES[name])
    assert outcome in ("exact", "close", "rows-only"), detail


def test_driver_contract(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) < set(entry.queries())
