"""The SQL twins of the training-data queries, on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.llm import entries

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_query_equals_its_twin(spark, duck, name):
    own = entries.QUERIES[name](spark, SF)
    twin = duck.sql(entries.ORACLE_SQL[name])
    columns = sorted(own.columns)
    assert sorted(twin.columns) == columns
    at = [twin.columns.index(c) for c in columns]
    got = sorted(repr(tuple(r[c] for c in columns)) for r in own.collect())
    assert got and got == sorted(repr(tuple(r[i] for i in at)) for r in twin.fetchall())
