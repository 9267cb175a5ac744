"""Every named query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from passagedex.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "benchmark"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def ordered(columns, rows):
    places = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return ""
        return repr(float(value)) if isinstance(value, float) else str(value)

    return [columns[i] for i in places], sorted([plain(row[i]) for i in places] for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sql, name):
    df = contract.queries()[name](spark, FOLDER)
    result = sql.sql(contract.oracle_sql()[name])
    assert ordered(df.columns, df.collect()) == ordered(result.columns, result.fetchall())


def test_entry_has_rows(spark):
    assert contract.entry(spark).take(1)
