"""The registered queries of the relational engine, each with the SQL that must give the same rows.

Measures in the test tables are DOUBLE; they are floored to BIGINT here, the engine's integer type,
so that sums don't depend on the order of addition.
"""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import functions as fn
from millrace.engine import Engine
from millrace.operators import aggregate, derived, equi_join, filter_rows, limit, order_by, project, spread_join
from millrace.sources import read_delimited, read_table, values, write_delimited

Query = Callable[[SparkSession, str], DataFrame]
_REG: dict[str, tuple[Query, str | None]] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _REG[f.__name__.removeprefix("q_")] = (f, oracle)
        return f

    return add


def i(c: str | Column) -> Column:
    """A measure as the engine's integer."""
    return F.floor(F.col(c) if isinstance(c, str) else c).cast("bigint")


def lit(n: int) -> Column:
    return F.lit(n).cast("bigint")


# ---- scans

_KEY = {"region": "r_regionkey, r_name", "nation": "n_nationkey, n_name, n_regionkey", "customer": "c_custkey, c_name, c_nationkey, c_mktsegment", "supplier": "s_suppkey, s_name, s_nationkey", "part": "p_partkey, p_name, p_brand, p_type, p_size", "orders": "o_orderkey, o_custkey, o_orderstatus, o_orderpriority", "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus"}
for _t, _cols in _KEY.items():
    _REG[f"scan_{_t}"] = (lambda s, d, t=_t, c=_cols: read_table(s, d, t).select(*c.split(", ")), f"SELECT {_cols} FROM {_t}")

# ---- filters

_ORD = "o_orderkey, o_custkey, o_orderstatus"
for _name, _col, _op, _val, _sql in (
    ("gt", "o_custkey", ">", 700, "o_custkey > 700"),
    ("lt", "o_custkey", "<", 700, "o_custkey < 700"),
    ("ge", "o_custkey", ">=", 700, "o_custkey >= 700"),
    ("le", "o_custkey", "<=", 700, "o_custkey <= 700"),
    ("eq", "o_custkey", "=", 700, "o_custkey = 700"),
    ("ne", "o_custkey", "<>", 700, "o_custkey <> 700"),
    ("ne2", "o_custkey", "!=", 700, "o_custkey != 700"),
    ("str_eq", "o_orderstatus", "=", "F", "o_orderstatus = 'F'"),
    ("str_gt", "o_orderpriority", ">", "3", "o_orderpriority > '3'"),
    ("like", "o_orderpriority", "like", "%-%E%", "o_orderpriority LIKE '%-%E%'"),
):
    _REG[f"filter_{_name}" if _name != "like" else "like"] = (lambda s, d, c=_col, o=_op, v=_val: filter_rows(read_table(s, d, "orders"), F.col(c), o, F.lit(v) if o != "like" else v).select(*_ORD.split(", ")), f"SELECT {_ORD} FROM orders WHERE {_sql}")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND CAST(floor(l_quantity) AS BIGINT) > 25 AND l_partkey < l_orderkey")
def q_filter_and(s, d):
    df = filter_rows(read_table(s, d, "lineitem"), F.col("l_returnflag"), "=", F.lit("R"))
    df = filter_rows(filter_rows(df, i("l_quantity"), ">", lit(25)), F.col("l_partkey"), "<", F.col("l_orderkey"))
    return df.select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_size FROM part WHERE CAST(p_size AS BIGINT) * p_size % 7 = 2")
def q_filter_expr(s, d):
    p = read_table(s, d, "part")
    return filter_rows(p, fn.FUNCTIONS["mod"](fn.FUNCTIONS["sq"](F.col("p_size").cast("bigint")), lit(7)), "=", lit(2)).select("p_partkey", "p_size")


# ---- projection


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) + 10 AS plus10, l_orderkey * 2 - l_partkey AS diff FROM lineitem")
def q_project_expr(s, d):
    return project(read_table(s, d, "lineitem"), [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_linenumber").cast("bigint") + lit(10), F.col("l_orderkey") * lit(2) - F.col("l_partkey")], ["l_orderkey", "l_linenumber", "plus10", "diff"])


@query("SELECT CAST(1 AS BIGINT) AS one, n_name FROM nation")
def q_project_const(s, d):
    return project(read_table(s, d, "nation"), [lit(1), F.col("n_name")], ["one", "n_name"])


@query("SELECT * FROM nation")
def q_select_star(s, d):
    return read_table(s, d, "nation").select("*")


@query("SELECT n_regionkey AS region, n_name AS nation FROM nation")
def q_project_reorder(s, d):
    return project(read_table(s, d, "nation"), [F.col("n_regionkey"), F.col("n_name")], ["region", "nation"])


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def q_distinct(s, d):
    return project(read_table(s, d, "lineitem"), [F.col("l_returnflag"), F.col("l_linestatus")], ["l_returnflag", "l_linestatus"], distinct=True)


@query("SELECT DISTINCT * FROM (SELECT o_custkey, o_orderstatus FROM orders) t")
def q_distinct_star(s, d):
    return derived(read_table(s, d, "orders").select("o_custkey", "o_orderstatus"), "t").select("*").distinct()


# ---- joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def q_join_2way(s, d):
    return equi_join(read_table(s, d, "orders"), read_table(s, d, "customer"), [(F.col("o_custkey"), F.col("c_custkey"))]).select("o_orderkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, c_name, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R'")
def q_join_3way(s, d):
    li = filter_rows(read_table(s, d, "lineitem"), F.col("l_returnflag"), "=", F.lit("R"))
    lo = equi_join(li, read_table(s, d, "orders"), [(F.col("l_orderkey"), F.col("o_orderkey"))])
    return equi_join(lo, read_table(s, d, "customer"), [(F.col("o_custkey"), F.col("c_custkey"))]).select("l_orderkey", "l_linenumber", "c_name", "o_orderstatus")


@query("SELECT c_name, n_name, r_name, s_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE r_name = 'ASIA'")
def q_join_4way(s, d):
    n = equi_join(read_table(s, d, "nation"), read_table(s, d, "region").filter("r_name = 'ASIA'"), [(F.col("n_regionkey"), F.col("r_regionkey"))])
    c = equi_join(read_table(s, d, "customer"), n, [(F.col("c_nationkey"), F.col("n_nationkey"))])
    return spread_join(c, read_table(s, d, "supplier"), [(F.col("n_nationkey"), F.col("s_nationkey"))]).select("c_name", "n_name", "r_name", "s_name")


@query("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
def q_self_join(s, d):
    a, b = derived(read_table(s, d, "nation"), "a"), derived(read_table(s, d, "nation"), "b")
    j = equi_join(a, b, [(F.col("a.n_regionkey"), F.col("b.n_regionkey"))])
    return project(filter_rows(j, F.col("a.n_nationkey"), "<", F.col("b.n_nationkey")), [F.col("a.n_name"), F.col("b.n_name")], ["x", "y"])


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_partkey % 97 + 1 = s_suppkey * 2")
def q_join_expr_key(s, d):
    return equi_join(read_table(s, d, "part"), read_table(s, d, "supplier"), [(F.col("p_partkey") % lit(97) + lit(1), F.col("s_suppkey") * lit(2))]).select("p_partkey", "s_suppkey")


@query("SELECT a.l_orderkey, a.l_linenumber, b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_returnflag = 'A'")
def q_join_composite_key(s, d):
    a, b = derived(read_table(s, d, "lineitem"), "a"), derived(read_table(s, d, "lineitem"), "b")
    return equi_join(a.filter("a.l_returnflag = 'A'"), b, [(F.col("a.l_orderkey"), F.col("b.l_orderkey")), (F.col("a.l_linenumber"), F.col("b.l_linenumber"))]).select("a.l_orderkey", "a.l_linenumber", "b.l_partkey")


@query("SELECT c_name, n_name FROM customer, nation WHERE c_nationkey = n_nationkey AND c_custkey < 100")
def q_comma_join(s, d):
    c, n = read_table(s, d, "customer"), read_table(s, d, "nation")
    return s.sql("SELECT c_name, n_name FROM {c}, {n} WHERE c_nationkey = n_nationkey AND c_custkey < 100", c=c, n=n)


@query("SELECT c_name, n_name FROM customer, nation WHERE c_nationkey = n_nationkey")
def q_comma_join_whole(s, d):
    c, n = read_table(s, d, "customer"), read_table(s, d, "nation")
    return s.sql("SELECT c_name, n_name FROM {c}, {n} WHERE c_nationkey = n_nationkey", c=c, n=n)


# ---- aggregates

for _name, _args, _sql in (
    ("count", ("count", "*"), "count(*)"),
    ("sum", ("sum", "l_partkey"), "CAST(sum(l_partkey) AS BIGINT)"),
    ("min", ("min", "l_partkey"), "min(l_partkey)"),
    ("max", ("max", "l_partkey"), "max(l_partkey)"),
    ("min_str", ("min", "l_returnflag"), "min(l_returnflag)"),
    ("max_str", ("max", "l_linestatus"), "max(l_linestatus)"),
):
    _REG[f"agg_{_name}"] = (lambda s, d, a=_args: aggregate(read_table(s, d, "lineitem"), [(*a, "v")]), f"SELECT {_sql} AS v FROM lineitem")


@query("SELECT CAST(CAST(sum(CAST(floor(c_acctbal) AS BIGINT)) AS BIGINT) // count(*) AS BIGINT) AS v FROM customer")
def q_agg_avg_int(s, d):
    return aggregate(read_table(s, d, "customer"), [("avg", i("c_acctbal"), "v")])


@query("SELECT count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS s, min(l_suppkey) AS lo, max(l_suppkey) AS hi FROM lineitem")
def q_agg_multi(s, d):
    return aggregate(read_table(s, d, "lineitem"), [("count", "*", "n"), ("sum", "l_partkey", "s"), ("min", "l_suppkey", "lo"), ("max", "l_suppkey", "hi")])


@query("SELECT CAST(sum(l_partkey + 10) AS BIGINT) AS s, CAST(sum(l_partkey) AS BIGINT) AS t FROM lineitem")
def q_agg_expr_in(s, d):
    return aggregate(read_table(s, d, "lineitem"), [("sum", F.col("l_partkey") + lit(10), "s"), ("sum", "l_partkey", "t")])


@query("SELECT min(l_partkey) + max(l_partkey) AS v FROM lineitem")
def q_agg_expr_over(s, d):
    a = aggregate(read_table(s, d, "lineitem"), [("min", "l_partkey", "lo"), ("max", "l_partkey", "hi")])
    return project(a, [F.col("lo") + F.col("hi")], ["v"])


@query("SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders WHERE o_orderkey < 0")
def q_agg_empty(s, d):
    return aggregate(read_table(s, d, "orders").filter("o_orderkey < 0"), [("count", "*", "n"), ("sum", "o_custkey", "s")])


@query("SELECT c_nationkey, CAST(sum(CAST(floor(c_acctbal) AS BIGINT)) AS BIGINT) AS total FROM customer GROUP BY c_nationkey")
def q_group_1key(s, d):
    return aggregate(read_table(s, d, "customer"), [("sum", i("c_acctbal"), "total")], [F.col("c_nationkey")])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS qty, min(l_partkey) AS lo, CAST(CAST(sum(l_suppkey) AS BIGINT) // count(*) AS BIGINT) AS avg_supp FROM lineitem GROUP BY l_returnflag, l_linestatus")
def q_group_nkey(s, d):
    return aggregate(read_table(s, d, "lineitem"), [("count", "*", "n"), ("sum", i("l_quantity"), "qty"), ("min", "l_partkey", "lo"), ("avg", "l_suppkey", "avg_supp")], [F.col("l_returnflag"), F.col("l_linestatus")])


@query("SELECT o_custkey % 10 + 1 AS k, count(*) AS n FROM orders GROUP BY o_custkey % 10 + 1")
def q_group_expr(s, d):
    return aggregate(read_table(s, d, "orders"), [("count", "*", "n")], [(F.col("o_custkey") % lit(10) + lit(1)).alias("k")])


@query("SELECT DISTINCT o_orderstatus FROM orders")
def q_group_no_agg(s, d):
    return read_table(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*")).select("o_orderstatus")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def q_having(s, d):
    return aggregate(read_table(s, d, "orders"), [("count", "*", "n")], [F.col("o_custkey")]).filter("n > 12")


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus")
def q_count_distinct(s, d):
    return aggregate(read_table(s, d, "orders"), [("count_distinct", "o_custkey", "n")], [F.col("o_orderstatus")])


# ---- sort and limit


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, c_nationkey, c_custkey DESC LIMIT 200")
def q_order_multi(s, d):
    c = read_table(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return limit(order_by(c, [F.col("c_mktsegment"), F.col("c_nationkey"), F.col("c_custkey")], [False, True, False]), 200)


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, c_nationkey, c_custkey DESC")
def q_order_multi_whole(s, d):
    c = read_table(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return order_by(c, [F.col("c_mktsegment"), F.col("c_nationkey"), F.col("c_custkey")], [False, True, False])


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_name")
def q_order_all(s, d):
    return order_by(read_table(s, d, "nation").select("n_nationkey", "n_name"), [F.col("n_name")], [True])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey * 2 - o_orderkey, o_orderkey LIMIT 10")
def q_order_expr(s, d):
    o = read_table(s, d, "orders").select("o_orderkey", "o_custkey")
    return limit(order_by(o, [F.col("o_custkey") * lit(2) - F.col("o_orderkey"), F.col("o_orderkey")], [True, True]), 10)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey * 2 - o_orderkey, o_orderkey")
def q_order_expr_whole(s, d):
    o = read_table(s, d, "orders").select("o_orderkey", "o_custkey")
    return order_by(o, [F.col("o_custkey") * lit(2) - F.col("o_orderkey"), F.col("o_orderkey")], [True, True])


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
def q_limit_topk(s, d):
    a = aggregate(read_table(s, d, "orders"), [("count", "*", "n")], [F.col("o_custkey")])
    return limit(order_by(a, [F.col("n"), F.col("o_custkey")], [False, True]), 10)


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 3")
def q_limit_expr(s, d):
    return s.sql("SELECT n_nationkey, n_name FROM {n} ORDER BY n_nationkey LIMIT 1 + 2", n=read_table(s, d, "nation"))


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 7")
def q_offset(s, d):
    return limit(order_by(read_table(s, d, "nation").select("n_nationkey", "n_name"), [F.col("n_nationkey")], [True]), 5, offset=7)


# ---- derived tables


@query("SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE n > 10")
def q_derived_table(s, d):
    t = aggregate(read_table(s, d, "orders"), [("count", "*", "n")], [F.col("o_custkey").alias("k")])
    return derived(t, "t").filter("t.n > 10").select("k", "n")


@query("SELECT x.name FROM (SELECT y.name FROM (SELECT n_name AS name, n_regionkey FROM nation) y WHERE y.n_regionkey > 1) x ORDER BY x.name")
def q_derived_nested(s, d):
    return s.sql("SELECT x.name FROM (SELECT y.name FROM (SELECT n_name AS name, n_regionkey FROM {n}) y WHERE y.n_regionkey > 1) x ORDER BY x.name", n=read_table(s, d, "nation"))


# ---- scalar functions



def _p() -> Column:
    return F.col("p_partkey") - lit(1000)


def _q() -> Column:
    return F.col("p_size").cast("bigint")


for _name, _cols, _sql in (
    ("add", lambda f: f(_p(), _q()), "(p_partkey - 1000) + p_size"),
    ("sub", lambda f: f(_p(), _q()), "(p_partkey - 1000) - p_size"),
    ("mul", lambda f: f(_p(), _q()), "(p_partkey - 1000) * p_size"),
    ("intdiv", lambda f: f(_p(), _q()), "(p_partkey - 1000) // CAST(p_size AS BIGINT)"),
    ("mod", lambda f: f(_p(), _q()), "(p_partkey - 1000) % CAST(p_size AS BIGINT)"),
    ("sq", lambda f: f(f(_q())), "CAST(p_size AS BIGINT) * p_size * p_size * p_size"),
    ("imin", lambda f: f(_p(), _q()), "least(p_partkey - 1000, CAST(p_size AS BIGINT))"),
    ("imax", lambda f: f(_p(), _q()), "greatest(p_partkey - 1000, CAST(p_size AS BIGINT))"),
    ("getsubstr", lambda f: f(F.col("p_type"), _q() % lit(9) - lit(2), lit(4)), "CASE WHEN p_size % 9 - 2 < 0 OR p_size % 9 - 2 > length(p_type) THEN '' ELSE substr(p_type, p_size % 9 - 1, 4) END"),
):
    _REG[f"fn_{_name if _name != 'intdiv' else 'div'}"] = (lambda s, d, n=_name, c=_cols: read_table(s, d, "part").select("p_partkey", c(fn.FUNCTIONS[n]).alias("v")), f"SELECT p_partkey, {_sql} AS v FROM part")


@query("SELECT o_orderkey, CAST(epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS BIGINT) AS v, CAST(0 AS BIGINT) AS bad FROM orders")
def q_fn_datestringtoepoch(s, d):
    f = fn.FUNCTIONS["datestringtoepoch"]
    return read_table(s, d, "orders").select("o_orderkey", f(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("v"), f(F.col("o_orderpriority")).alias("bad"))


@query("SELECT o_orderkey, o_orderkey * 86461 AS v, strftime(make_timestamp(o_orderkey * 86461 * 1000000), '%a %b ') || lpad(CAST(day(make_timestamp(o_orderkey * 86461 * 1000000)) AS VARCHAR), 2, ' ') || strftime(make_timestamp(o_orderkey * 86461 * 1000000), ' %H:%M:%S UTC %Y') AS t FROM orders")
def q_fn_epochtodatetimestring(s, d):
    t = fn.FUNCTIONS["epochtodatetimestring"](F.col("o_orderkey") * lit(86461))
    o = read_table(s, d, "orders").select("o_orderkey", t.alias("t"))
    return o.select("o_orderkey", fn.FUNCTIONS["datetimestringtoepoch"](F.col("t")).alias("v"), "t")


@query("SELECT o_orderkey, o_orderkey * 86461 AS v, CAST(0 AS BIGINT) AS bad FROM orders")
def q_fn_datetimestringtoepoch(s, d):
    f, g = fn.FUNCTIONS["datetimestringtoepoch"], fn.FUNCTIONS["epochtodatetimestring"]
    return read_table(s, d, "orders").select("o_orderkey", f(g(F.col("o_orderkey") * lit(86461))).alias("v"), f(F.col("o_orderstatus")).alias("bad"))


@query("SELECT n_nationkey, true AS ok FROM nation")
def q_fn_rand(s, d):
    return read_table(s, d, "nation").select("n_nationkey", (fn.FUNCTIONS["irand"]() >= lit(0)).alias("ok"))


@query("SELECT n_nationkey, true AS ok FROM nation")
def q_fn_epoch(s, d):
    now = lit(int(time.time()))
    return read_table(s, d, "nation").select("n_nationkey", (F.abs(fn.FUNCTIONS["epoch"]() - now) < 600).alias("ok"))


@query("SELECT count(*) AS n_unlike, true AS halved FROM orders")
def q_fn_rand_spread(s, d):
    """No number comes twice, and half of them lie below the middle of the range, within five in a hundred."""
    r = read_table(s, d, "orders").select(fn.FUNCTIONS["irand"]().alias("r"))
    below = F.count_if(F.col("r") < lit(int(4.6e18))) / F.count("*")
    return r.agg(F.count_distinct("r").alias("n_unlike"), ((below > 0.45) & (below < 0.55)).alias("halved"))


# ---- sources, DML


@query("SELECT * FROM (VALUES (CAST(25 AS BIGINT), 'sam'), (CAST(999 AS BIGINT), 'george jones')) t(age, name)")
def q_values(s, d):
    return values(s, [(25, "sam"), (999, "george jones")], "age bigint, name string")


def _shared(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one, which goes with the application; below a temporary one where one machine runs all."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.gettempdir()
    name = f"{root.rstrip('/')}/millrace-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return name


def _engine(spark: SparkSession):
    con = Engine(spark, _shared(spark).removeprefix("file://")).connect()
    con.sql("create table n (k int, name string, region int)")
    return con


def _nation(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def q_insert_select(s, d):
    con = _engine(s)
    con.insert("n", _nation(s, d))
    con.sql("insert into n select k + 100, name, region from n where region = 2")
    return con.sql("select * from n").df


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', CAST(2 AS BIGINT)), (3, 'b', 4)) t(k, name, region)")
def q_insert_values(s, d):
    con = _engine(s)
    con.sql("insert into n values (1, 'a', 2), (3, 'b', 4)")
    return con.sql("select * from n").df


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation WHERE NOT (n_regionkey > 1 AND n_name < 'M')")
def q_delete_where(s, d):
    con = _engine(s)
    con.insert("n", _nation(s, d))
    con.sql("delete from n where region > 1 and name < 'M'")
    return con.sql("select * from n").df


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def q_rollback(s, d):
    con = _engine(s)
    con.insert("n", _nation(s, d))
    con.sql("begin")
    con.sql("delete from n")
    con.sql("rollback")
    return con.sql("select * from n").df


@query("SELECT c_custkey AS k, substr(c_name, 1, 32) AS name, CAST(trunc(c_acctbal) AS BIGINT) AS bal FROM customer")
def q_csv_load(s, d):
    path = _shared(s)
    write_delimited(read_table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path, sep="|")
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("name", T.StringType()), T.StructField("bal", T.LongType())])
    return read_delimited(s, path, schema, sep="|", header=True)


# ---- the SQL front end: statements as a user types them, over two small-column tables t and t2

_T = "WITH t AS (SELECT c_mktsegment || '-' || CAST(c_custkey % 40 AS VARCHAR) AS name, CAST(c_custkey * 7 % 90 AS BIGINT) AS age FROM customer), t2 AS (SELECT (['BUILDING', 'MACHINERY', 'FURNITURE'])[CAST(s_suppkey % 3 + 1 AS INT)] || '-' || CAST(s_suppkey % 40 AS VARCHAR) AS name, CAST(s_suppkey * 7 % 90 AS BIGINT) AS age FROM supplier) "


def _people(s: SparkSession, d: str):
    con = Engine(s, _shared(s).removeprefix("file://")).connect()
    for name in ("t", "t2"):
        con.sql(f"create table {name} (name string, age int)")
    con.insert("t", read_table(s, d, "customer").selectExpr("concat(c_mktsegment, '-', c_custkey % 40) as name", "c_custkey * 7 % 90 as age"))
    con.insert("t2", read_table(s, d, "supplier").selectExpr("concat(element_at(array('BUILDING', 'MACHINERY', 'FURNITURE'), cast(s_suppkey % 3 + 1 as int)), '-', s_suppkey % 40) as name", "s_suppkey * 7 % 90 as age"))
    return con


#: name -> (statement, SQL that gives the same rows, names for columns where the statement gives one name twice)
SQL = {
    "having_alias": ("select sum(age) as s from t group by t.name having s > 30", "SELECT CAST(sum(age) AS BIGINT) AS s FROM t GROUP BY name HAVING sum(age) > 30", None),
    "agg_of_expr": ("select sum(age + 10) , sum(age) from t", "SELECT CAST(sum(age + 10) AS BIGINT) AS a, CAST(sum(age) AS BIGINT) AS b FROM t", ("a", "b")),
    "expr_of_agg": ("select min(age) + max(age) from t", 'SELECT min(age) + max(age) AS "+" FROM t', None),
    "limit_expr": ("select * from t order by t.age, t.name limit 1+2", "SELECT * FROM t ORDER BY age, name LIMIT 3", None),
    "join_comma": ("select t.name, t.age from t join t2 on t.name = t2.name, t2 as t3 where t.age < 50 and t3.age = t.age order by t.age asc, t.name asc", "SELECT t.name, t.age FROM t JOIN t2 ON t.name = t2.name JOIN t2 AS t3 ON t3.age = t.age WHERE t.age < 50", None),
    "nested_call": ("select sq(sq(5)) from t", "SELECT CAST(625 AS BIGINT) AS sq FROM t", None),
    "constant": ("select 1, name from t", 'SELECT 1 AS "1", name FROM t', None),
    "reorder": ("select age, name from t", "SELECT age, name FROM t", None),
    "bare_alias": ("select t.name, sum(age) totage from t group by t.name", "SELECT name, CAST(sum(age) AS BIGINT) AS totage FROM t GROUP BY name", None),
    "join_on": ("select t.name, t.age from t join t2 on t.name = t2.name where t.age < 50", "SELECT t.name, t.age FROM t JOIN t2 ON t.name = t2.name WHERE t.age < 50", None),
    "derived": ("select name from (select x.name from (select t.name from t) x)y order by name asc", "SELECT name FROM t", None),
    "count_star": ("select age, count(*) from t group by age", 'SELECT age, count(*) AS "count(*)" FROM t GROUP BY age', None),
    "integer": ("select name, avg(age), max(age) / 7, -7 / 2 as h from t group by name", 'SELECT name, CAST(sum(age) // count(*) AS BIGINT) AS "avg(age)", max(age) // 7 AS "/", CAST(-3 AS BIGINT) AS h FROM t GROUP BY name', None),
    "avg_nested": ("select avg(age / 2 + 1) / 2 as v, rand() >= 0 as r from t where epoch() > 0", "SELECT CAST(sum(age // 2 + 1) // count(*) // 2 AS BIGINT) AS v, true AS r FROM t", None),
    "functions": ("select name, getsubstr(name, 1, 3) as a, imin(age, 5) as b, imax(age, 5) as c, mod(age, 7) as d, datestringtoepoch('2024-01-15') as e, epochtodatetimestring(0) as f, datetimestringtoepoch('Mon Jan  2 21:04:05 UTC 2006') as g from t where sq(age) > 100", "SELECT name, substr(name, 2, 3) AS a, least(age, 5) AS b, greatest(age, 5) AS c, age % 7 AS d, CAST(1705276800 AS BIGINT) AS e, 'Thu Jan  1 00:00:00 UTC 1970' AS f, CAST(1136235845 AS BIGINT) AS g FROM t WHERE age * age > 100", None),
    "on_conditions": ("select t.name, t2.age from t join t2 on t.name = t2.name and t.age = t2.age and t.age > 5", "SELECT t.name, t2.age FROM t JOIN t2 ON t.name = t2.name AND t.age = t2.age AND t.age > 5", None),
    "predicates": ("select name, age from t where (age between 10 and 20 or name in ('BUILDING-1', 'MACHINERY-2')) and not age = 14 and name is not null and age <> 15 and name like '%_-%'", "SELECT name, age FROM t WHERE (age BETWEEN 10 AND 20 OR name IN ('BUILDING-1', 'MACHINERY-2')) AND NOT age = 14 AND age <> 15", None),
    "subqueries": ("select name, age from t where age > (select avg(age) from t2) and name in (select name from t2 where age < 40)", "SELECT name, age FROM t WHERE age > (SELECT CAST(sum(age) // count(*) AS BIGINT) FROM t2) AND name IN (SELECT name FROM t2 WHERE age < 40)", None),
    "spelling": ("select /*+ broadcast(t2) */ t.name, age==5 as a, cast(t.age*.5 as decimal(10,1)) as b, cast(t.age as string) as c from t join (select name from t2) t2 on t.name = t2.name where t.age > 5L -- a / b", "SELECT t.name, age = 5 AS a, CAST(t.age * 0.5 AS DECIMAL(10,1)) AS b, CAST(t.age AS VARCHAR) AS c FROM t JOIN (SELECT name FROM t2) t2 ON t.name = t2.name WHERE t.age > 5", None),
    "distinct_offset": ("select distinct age from t order by age limit 5 offset 3", "SELECT DISTINCT age FROM t ORDER BY age LIMIT 5 OFFSET 3", None),
}


def _statement(sql: str, names: tuple[str, ...] | None) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        df = _people(s, d).sql(sql).df
        return df.toDF(*names) if names else df

    return run


for _name, (_sql, _oracle, _names) in SQL.items():
    _REG[f"sql_{_name}"] = (_statement(_sql, _names), _T + _oracle)


@query("SELECT n_name, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS revenue, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'P' GROUP BY n_name HAVING count(*) > 3 ORDER BY revenue DESC, n_name LIMIT 20")
def q_flagship(s, d):
    """Revenue by nation: filter, two joins, group, having, sort, limit."""
    o = filter_rows(read_table(s, d, "orders"), F.col("o_orderstatus"), "<>", F.lit("P"))
    oc = equi_join(o, read_table(s, d, "customer"), [(F.col("o_custkey"), F.col("c_custkey"))])
    ocn = equi_join(oc, read_table(s, d, "nation"), [(F.col("c_nationkey"), F.col("n_nationkey"))])
    g = aggregate(ocn, [("sum", i("o_totalprice"), "revenue"), ("count", "*", "orders")], [F.col("n_name")])
    return limit(order_by(g.filter("orders > 3"), [F.col("revenue"), F.col("n_name")], [False, True]), 20)


flagship = q_flagship


def _with_functions(f: Query) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        fn.register(s)
        return f(s, d)

    return run


def queries() -> dict[str, Query]:
    return {k: _with_functions(f) for k, (f, _) in _REG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: o for k, (_, o) in _REG.items() if o}
