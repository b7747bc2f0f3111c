"""Every registered query with a SQL twin against DuckDB on the smallest data set."""

import os

import pytest

from fleetpulse.plans import QUERIES, SQL
from tests.compare import differences, oracle

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), oracle(FOLDER), SQL[name]) == []


def test_twins_have_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["dataset_comparison", "validation_report", "random_forest_scores"])
def test_rows_only_queries(spark, name):
    assert not QUERIES[name](spark, FOLDER).isEmpty()
