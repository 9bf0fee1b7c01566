"""Each query with a statement gives the same rows in a second engine."""

import glob
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return ""
        if isinstance(v, float):
            return f"{v:.6f}".rstrip("0").rstrip(".")
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False))


@pytest.fixture(scope="module")
def second(data):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.core.SQL))
def test_same_rows(spark, data, second, name):
    a = entry.queries()[name](spark, data).toPandas()
    b = second.execute(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert normal(a) == normal(b)


@pytest.mark.parametrize("name", sorted(set(entry.core.QUERIES) - set(entry.core.SQL)))
def test_runs(spark, data, name):
    df = entry.core.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
