"""Every query with SQL gives DuckDB's rows, on the smallest tables."""

import os

import duckdb
import pytest

from pagefinder.plans import contract

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame, names):
    clean = frame[names].astype(object).where(frame[names].notna(), None)
    return sorted(map(str, clean.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", contract.QUERIES)
def test_query(spark, duck, name):
    got = contract.QUERIES[name](spark, SF).toPandas()
    if name in contract.ORACLE_SQL:
        want = duck.sql(contract.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
    else:
        assert len(got)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(contract.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
