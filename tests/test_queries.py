"""Every registered query with SQL, against DuckDB on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("CORPUSKIT_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _rows(df, cols):
    def plain(v):
        if isinstance(v, (bool, str)):
            return v
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return None
        try:
            return round(float(v), 6)
        except (TypeError, ValueError):
            return str(v)

    return sorted(str([plain(v) for v in row]) for row in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(name, spark, duck):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert _rows(got, cols) == _rows(want, cols)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
