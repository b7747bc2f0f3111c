"""Every query with a SQL twin against DuckDB, and all of them over empty tables."""

import os

import pytest

from fleetpulse.llm import QUERIES, SQL
from tests.compare import differences, oracle

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), oracle(FOLDER), SQL[name]) == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, name, tmp_path):
    for table in ("documents", "pages", "conversations", "embeddings", "labels"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == (1 if name.startswith("op7") else 0)
