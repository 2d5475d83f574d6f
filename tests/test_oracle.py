"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from factorlake import queries as library

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = library.queries(), library.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


def cell(x):
    if pd.isna(x) is True or x is None:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf":
        return f"{float(x):.4e}" if math.isfinite(float(x)) else str(float(x))
    return str(x)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(cell(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(SQL[name]).df())


def test_registered_names():
    assert set(SQL) <= set(QUERIES)
