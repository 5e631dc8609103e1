"""The training-data queries that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest
from tessella.llm import queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DIR):
        path = f"{DIR}/{file}" + ("/*.parquet" if os.path.isdir(f"{DIR}/{file}") else "")
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{path}'")
    rel = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, DIR).select(*rel.columns)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(rel.fetchall(), key=str)


def test_all_are_registered():
    found = queries.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in found) == 1
