"""Every registered query against its SQL."""

from __future__ import annotations

import decimal
import os

import duckdb
import pytest

import __spark_entry__
from purchaseflow.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    return value


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    got = registry.queries()[name](spark, sf_dir)
    columns, rows = got.columns, [tuple(map(plain, r)) for r in got.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = con.sql(sql)
    assert sorted(columns) == sorted(want.columns)
    at = [list(want.columns).index(c) for c in columns]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
