"""Corpus queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from passagedex.llm.queries import ORACLES, QUERIES
from tests.test_entry import ordered

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sql, name):
    df = QUERIES[name](spark, FOLDER)
    result = sql.sql(ORACLES[name])
    assert ordered(df.columns, df.collect()) == ordered(result.columns, result.fetchall())
