"""Every query that has a DuckDB twin, on the small tables."""

import os

import duckdb
import pytest

from tidemark.plans import queries

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_twin(spark, duck, name):
    own = queries.QUERIES[name](spark, SF)
    twin = duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(own.columns)
    assert sorted(twin.columns) == columns
    got = sorted(tuple(normal(r[c]) for c in columns) for r in own.collect())
    at = [twin.columns.index(c) for c in columns]
    assert got == sorted(tuple(normal(r[i]) for i in at) for r in twin.fetchall())


def test_every_symbol_is_evaluated(spark, duck):
    symbols = {x for (x,) in duck.sql("SELECT DISTINCT l_returnflag || l_linestatus FROM lineitem").fetchall()}
    assert set(queries.QUERIES["pivot_panel_all"](spark, SF).columns) - {"bar_idx"} == symbols
    for name in ("unpivot_panel_all", "ic_pearson_by_symbol", "ic_spearman_by_symbol"):
        assert {r.symbol for r in queries.QUERIES[name](spark, SF).select("symbol").distinct().collect()} == symbols


def test_entry_lags_of_the_reference(spark):
    assert {r.entry_lag for r in queries.QUERIES["entry_lag_all"](spark, SF).collect()} == {1, 2, 5, 10, 30}
