"""Registered queries against DuckDB on the smallest tables, and the driver's contract."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from dialspan import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (not isinstance(value, (list, dict)) and pd.isna(value)):
        return None
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    if isinstance(value, (bool, str)):
        return value
    value = round(float(value), 5) if isinstance(value, (int, float)) or hasattr(value, "item") else value
    return int(value) if isinstance(value, float) and value.is_integer() else value


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(str(tuple(plain(v) for v in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, tables, name):
    got, want = rows(catalog.QUERIES[name](spark, SF).toPandas()), rows(tables.execute(catalog.ORACLE_SQL[name]).fetchdf())
    assert got == want


def test_contract(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).count() > 0
