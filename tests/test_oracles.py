"""Every query with SQL against DuckDB, on one small folder."""

import math
import os
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from corvane.plans import registry

SF = os.environ.get("CORVANE_TEST_SF", "/root/testdata/sf0.001")
SQL, QUERIES = registry.oracle_sql(), registry.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in sorted(Path(SF).glob("*.parquet")):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, (float, Decimal)):
        return f"{float(x):.6g}"
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(value(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    other = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(other.columns)
    got, want = rows(df.columns, df.collect()), rows(other.columns, other.fetchall())
    assert len(got) == len(want)
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
