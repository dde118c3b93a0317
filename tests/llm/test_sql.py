"""The queries against their DuckDB SQL."""

import os

import duckdb
import pytest

from corvane.llm import queries, sql

SF = os.environ.get("CORVANE_TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, other = queries.queries()[name](spark, SF), con.sql(sql.oracle_sql()[name])
    assert sorted(df.columns) == sorted(other.columns)
    place = [other.columns.index(c) for c in df.columns]
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[k] for k in place) for r in other.fetchall())
