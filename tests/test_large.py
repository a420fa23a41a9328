"""Registered queries on what only large tables hold, against DuckDB."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace import Engine, engine, plans
from millrace.frontend import _walk, multiplied
from millrace.operators import relational
from tests.test_oracle import rows_of


@pytest.mark.parametrize("name", ["fn_epochtodatetimestring", "fn_datetimestringtoepoch"])
def test_years_past_9999(spark, tmp_path, name):
    keys = (0, 2_930_827, 2_930_828, 8_999_999, 100_000_000)  # the year 10000 begins between the second and the third
    spark.createDataFrame([(k, "F") for k in keys], "o_orderkey bigint, o_orderstatus string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    df = plans.queries()[name](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = duck.execute(plans.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in want.description], want.fetchall())


def one_nation(spark, path, customers, suppliers):
    """All customers and suppliers in one nation of Asia but for three, some rows alike, some without a nation."""
    names = [(k, f"n{k}", k % 5) for k in range(25)]
    for name, df in (
        ("region", spark.createDataFrame([(k, "ASIA" if k == 2 else f"r{k}") for k in range(5)], "r_regionkey int, r_name string")),
        ("nation", spark.createDataFrame(names, "n_nationkey int, n_name string, n_regionkey int")),
        ("customer", spark.range(customers).selectExpr("id as c_custkey", "concat('c', id div 2) as c_name", "cast(case id when 0 then null when 1 then 3 when 2 then 12 else 7 end as int) as c_nationkey")),
        ("supplier", spark.range(suppliers).selectExpr("0L as s_suppkey", "concat('s', id div 2) as s_name", "cast(case id when 0 then null when 1 then 3 when 2 then 12 else 7 end as int) as s_nationkey")),
    ):
        df.coalesce(1).write.parquet(f"{path}/{name}.parquet")


def test_join_4way_is_dealt_by_the_rows_it_makes(spark, tmp_path):
    one_nation(spark, tmp_path, 4003, 4003)
    parts = plans.queries()["join_4way"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 4000 * 4000 + 1
    assert max(r["count"] for r in parts) < 10_000_000


def test_join_4way_in_blocks_gives_the_rows_of_its_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(relational, "SPREAD_ROWS", 1000)
    monkeypatch.setattr(relational, "SPREAD_BLOCK", 16)
    one_nation(spark, tmp_path, 203, 103)
    duck = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = plans.queries()["join_4way"](spark, str(tmp_path))
    want = duck.execute(plans.oracle_sql()["join_4way"])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in want.description], want.fetchall())


JOIN_COMMA = "select t.name, t.age from t join t2 on t.name = t2.name, t2 as t3 where t.age < 50 and t3.age = t.age order by t.age asc, t.name asc"


@pytest.fixture
def people(spark, tmp_path):
    def make(n, names=3, ages=4):
        c = Engine(spark, str(tmp_path / "db")).connect()
        for t in ("t", "t2"):
            c.sql(f"create table {t} (name string, age int)")
            c.insert(t, spark.range(n).selectExpr(f"if(id = 0, null, concat('n', id % {names})) as name", f"if(id = 1, null, id % {ages}) as age"))
        return c

    return make


def test_join_comma_is_dealt_by_the_rows_it_makes(people):
    parts = people(302, 1, 1).sql(JOIN_COMMA).df.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 300 * 301 * 301
    assert max(r["count"] for r in parts) < 20_000_000


COPIED = [
    JOIN_COMMA,
    JOIN_COMMA.replace("t.age asc", "t.age desc"),
    "select t.name, t.age from t join t2 on t.name = t2.name where t.age < 3",
    "select t.age as a, t2.name, t.age from t, t2, t2 as x where t.age = t2.age and x.name = t2.name and not t.name = 'n1' order by t2.name",
    "select a.name from t a inner join t2 b on a.name = b.name and a.age = b.age order by a.name desc -- end",
]


@pytest.mark.parametrize("sql", COPIED)
def test_copies_made_last_are_the_rows_of_the_join(people, monkeypatch, sql):
    con = people(40)
    plain = con.sql(sql).df
    monkeypatch.setattr(engine, "COPIED_ROWS", 50)
    monkeypatch.setattr(engine, "COPIED_RUN", 7)
    monkeypatch.setattr(engine, "COPIED_STEP", 3)
    monkeypatch.setattr(engine, "COPIED_TASKS", 5)
    got = con.sql(sql).df
    assert got.columns == plain.columns and "_n" in got._jdf.queryExecution().toString()
    a, b = [tuple(r) for r in got.collect()], [tuple(r) for r in plain.collect()]
    assert len(a) > 50 and Counter(a) == Counter(b)
    if "order by" in sql:
        by = [k for k, c in enumerate(plain.columns) if f"{c} asc" in sql or f"{c} desc" in sql or f"order by t2.{c}" in sql]
        assert [[r[k] for k in by] for r in a] == [[r[k] for k in by] for r in b]


@pytest.mark.parametrize("sql", [JOIN_COMMA, JOIN_COMMA[: JOIN_COMMA.index(" order by")]])
def test_a_task_holds_the_copies_of_one_step(people, monkeypatch, sql):
    con = people(40)
    monkeypatch.setattr(engine, "COPIED_ROWS", 50)
    plan = con.sql(sql).df._jdf.queryExecution().sparkPlan()
    line = [n.nodeName() for n in _walk(plan)]
    last, cut = [k for k, n in enumerate(line) if n == "Generate"][:2]
    assert "Sort" in line[last:cut]  # the last copies are made from rows that a sort gives one by one
    assert engine.COPIED_STEP <= 1 << 12  # these are held at once


@pytest.mark.parametrize(
    "sql",
    [
        "select t.name from t left join t2 on t.name = t2.name",
        "select t.name from t join t2 on t.name = t2.name limit 3",
        "select t.name from t join t2 on t.name = t2.name order by t.name limit 3",
        "select t.name from t join t2 on t.name = t2.name order by t.age",
        "select distinct t.name from t, t2 where t.age = t2.age",
        "select t.name, t2.name from t, t2 where t.age = t2.age",
        "select t.name from t, t2 where t.name = t2.name group by t.name",
        "select t.name from t, t2 where t.name = t2.name union all select t.name from t",
        "select t.name from t join t2",
        "select name from t join t2 on t.age = t2.age",
        "select t.name from t natural join t2",
        "select t.name from t",
    ],
)
def test_other_statements_are_left_as_they_are(sql):
    assert multiplied(sql, {"t": ["name", "age"], "t2": ["name", "age"]}) is None
