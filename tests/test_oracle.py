"""Every query that has SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from corpusloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(_plain(x) for x in r)) for r in df.itertuples(index=False))


def _plain(x):
    if x is None or x is pd.NA or x != x:
        return None
    if hasattr(x, "item"):
        x = x.item()
    return int(x) if isinstance(x, float) and x == int(x) else x


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, db, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), db.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
