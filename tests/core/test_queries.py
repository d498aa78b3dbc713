"""Every query with SQL gives what DuckDB gives for it."""

import datetime
import math

import duckdb
import pandas as pd
import pytest

from quillon.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def value(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    return pd.Timestamp(x) if isinstance(x, datetime.datetime) else x.item() if hasattr(x, "item") else x


def rows(df, columns):
    return sorted((tuple(map(value, r)) for r in df[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, con, sf, name):
    want = con.execute(catalog.ORACLES[name]).df()
    got = catalog.QUERIES[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)
