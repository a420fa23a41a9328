"""Plan builders for hand-made plans. Each adds one logical node; Catalyst picks the physical form."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import int_avg

_OPS = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "!=": lambda a, b: a != b,
    "like": lambda a, b: a.like(b),
}


def filter_rows(df: DataFrame, left: Column, op: str, right) -> DataFrame:
    """Rows where ``left op right`` holds; LIKE takes a pattern."""
    return df.filter(_OPS[op.lower()](left, right))


def project(df: DataFrame, exprs: Sequence[Column], names: Sequence[str], distinct: bool = False) -> DataFrame:
    if len(exprs) != len(names):
        raise ValueError(f"{len(exprs)} expressions and {len(names)} names")
    out = df.select(*[e.alias(n) for e, n in zip(exprs, names, strict=True)])
    return out.distinct() if distinct else out


def equi_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[Column, Column]]) -> DataFrame:
    """Inner join on pairs of expressions; all pairs form one condition. Left fields come first."""
    if not keys:
        raise ValueError("a join needs a key")
    cond = keys[0][0] == keys[0][1]
    for a, b in keys[1:]:
        cond &= a == b
    return left.join(right, cond, "inner")


#: About how many rows a task of spread_join makes, and how many rows of a side with the same key stay together.
SPREAD_ROWS, SPREAD_BLOCK = 1 << 22, 1 << 10


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[Column, Column]]) -> DataFrame:
    """``equi_join`` for few keys with many rows on both sides, whose result is far larger than what it reads.

    Spark deals such a join by what it reads, so one task may make all rows. Here a key's rows are cut into blocks on either side, and each pair of
    blocks is a group of its own; tasks follow the rows that come out. The rows are counted by key first; up to SPREAD_ROWS, this is ``equi_join``.
    Rows alike in all columns share a block. No column name may stand on both sides.
    """
    on = [f"_key{k}" for k in range(len(keys))]
    a = left.select("*", *[x.alias(k) for k, (x, _) in zip(on, keys, strict=True)])
    b = right.select("*", *[y.alias(k) for k, (_, y) in zip(on, keys, strict=True)])
    sizes = a.groupBy(*on).agg(F.count("*").alias("_n")).join(b.groupBy(*on).agg(F.count("*").alias("_m")), on)
    made = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0
    if made <= SPREAD_ROWS:
        return equi_join(left, right, keys)
    sizes = sizes.select(*on, F.ceil(F.col("_n") / SPREAD_BLOCK).alias("_n"), F.ceil(F.col("_m") / SPREAD_BLOCK).alias("_m"))
    tasks = math.ceil(made / SPREAD_ROWS)

    def dealt(df: DataFrame, columns: list[str], own: str, blocks: str, other: str, others: str) -> DataFrame:
        """Each row in its own block, once for each block of the other side."""
        df = df.join(sizes, on).withColumn(own, F.pmod(F.xxhash64(*columns), F.col(blocks))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(others) - 1)))
        return df.repartition(tasks, *on, "_i", "_j")

    pairs = dealt(a, left.columns, "_i", "_n", "_j", "_m").drop("_n", "_m").join(dealt(b, right.columns, "_j", "_m", "_i", "_n").drop("_n", "_m"), [*on, "_i", "_j"])
    return pairs.select(*left.columns, *right.columns)


_AGGS = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": int_avg, "count_distinct": F.count_distinct}


def aggregate(df: DataFrame, aggs: Sequence[tuple[str, Column | str, str]], keys: Sequence[Column] = ()) -> DataFrame:
    """``aggs`` are (function, expression, name). Keys come first; without keys there is one row, also for no input."""
    cols = [_AGGS[f](F.lit(1) if isinstance(e, str) and e == "*" else e).alias(n) for f, e, n in aggs]
    return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)


def order_by(df: DataFrame, exprs: Sequence[Column], ascending: Sequence[bool]) -> DataFrame:
    return df.orderBy(*[e.asc() if up else e.desc() for e, up in zip(exprs, ascending, strict=True)])


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """The first n rows past the offset; over a sort this becomes a top-k."""
    return (df.offset(offset) if offset else df).limit(n)


def derived(df: DataFrame, alias: str) -> DataFrame:
    return df.alias(alias)
