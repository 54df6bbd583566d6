"""Every registered check with an SQL text equals DuckDB on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from ledgerloom.checks import all_oracles, all_queries
from ledgerloom.checks.views import TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None:
        return ""
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return "" if v != v else str(round(float(v), 6))
    return str(v)[:10] if isinstance(v, (datetime.date, datetime.datetime)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_equals_duckdb(spark, duck, name):
    ours = all_queries()[name](spark, SF)
    theirs = duck.sql(all_oracles()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    left = sorted(tuple(plain(r[c]) for c in columns) for r in ours.collect())
    at = [theirs.columns.index(c) for c in columns]
    right = sorted(tuple(plain(r[i]) for i in at) for r in theirs.fetchall())
    assert left == right
