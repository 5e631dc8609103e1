"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import decimal
import os

import duckdb
import pytest
from tessella.plans import catalog

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        path = f"{DIR}/{name}" + ("/*.parquet" if os.path.isdir(f"{DIR}/{name}") else "")
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{path}'")
    return con


def _plain(v):
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    want = sorted((tuple(_plain(r[i]) for i in order) for r in rel.fetchall()), key=str)
    assert sorted((tuple(map(_plain, r)) for r in df.collect()), key=str) == want and want
