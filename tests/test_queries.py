"""Every query with SQL returns the rows that DuckDB returns for that SQL."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from tallyline.queries import QUERIES, SQL

from .conftest import SMALL


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.isoformat() if isinstance(value, datetime.date) else str(value) if isinstance(value, decimal.Decimal) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    found = QUERIES[name](spark, SMALL)
    wanted = duck.sql(SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    at = [wanted.columns.index(c) for c in columns]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in found.collect()) == sorted(repr([plain(r[k]) for k in at]) for r in wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
