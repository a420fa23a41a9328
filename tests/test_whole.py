"""Registered queries that return as many rows as their tables have."""

import pytest

from millrace import plans

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, table", [("comma_join_whole", "customer"), ("order_multi_whole", "customer"), ("order_expr_whole", "orders")])
def test_every_row_comes_back(spark, name, table):
    assert plans.queries()[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def test_whole_sorts_are_in_order(spark):
    rows = [(r.c_mktsegment, r.c_nationkey, r.c_custkey) for r in plans.queries()["order_multi_whole"](spark, DATA).collect()]
    want = sorted(rows, key=lambda r: (r[1], -r[2]))
    assert rows == sorted(want, key=lambda r: r[0], reverse=True)
    keys = [(r.o_custkey * 2 - r.o_orderkey, r.o_orderkey) for r in plans.queries()["order_expr_whole"](spark, DATA).collect()]
    assert keys == sorted(keys)
