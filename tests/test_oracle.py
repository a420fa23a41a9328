"""Every relational query against DuckDB on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from millrace import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    return int(v) if isinstance(v, decimal.Decimal) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    want = duck.execute(plans.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in want.description], want.fetchall())
