"""The scalar function library: temporary SQL functions, and Column builders that call them.

Each is defined once, in built-in expressions that the analyzer puts in the place of the call, so filters on
them stay inside code generation.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: name -> (parameters, result type, expression); ``{x}`` stands for parameter x.
_SPEC: dict[str, tuple[str, str, str]] = {
    "sq": ("a BIGINT", "BIGINT", "{a} * {a}"),
    "imin": ("a BIGINT, b BIGINT", "BIGINT", "least({a}, {b})"),
    "imax": ("a BIGINT, b BIGINT", "BIGINT", "greatest({a}, {b})"),
    # The start counts from 0; a start outside the text gives '', the end is clipped.
    "getsubstr": (
        "s STRING, a BIGINT, n BIGINT",
        "STRING",
        "CASE WHEN {a} < 0 OR {a} > length({s}) THEN '' ELSE substring({s}, CAST({a} + 1 AS INT), CAST({n} AS INT)) END",
    ),
    "datestringtoepoch": (
        "s STRING",
        "BIGINT",
        "coalesce(unix_date(CAST(try_to_timestamp({s}, 'yyyy-MM-dd') AS DATE)) * 86400L, 0L)",
    ),
    # 'Mon Jan  2 15:04:05 UTC 2006': the weekday is dropped, runs of blanks are collapsed. Spark wants a sign before years of over four digits.
    "datetimestringtoepoch": (
        "s STRING",
        "BIGINT",
        "coalesce(unix_seconds(try_to_timestamp(regexp_replace(regexp_replace(regexp_replace(trim({s}), '^[A-Za-z]{{3}} +', ''), ' +', ' '), ' ([0-9]{{5,}})$', ' +$1'), 'MMM d HH:mm:ss z yyyy')), 0L)",
    ),
    "epochtodatetimestring": (
        "e BIGINT",
        "STRING",
        "concat(date_format(timestamp_seconds({e}), 'EEE MMM '), lpad(date_format(timestamp_seconds({e}), 'd'), 2, ' '), date_format(timestamp_seconds({e}), ' HH:mm:ss z '), trim(LEADING '+' FROM date_format(timestamp_seconds({e}), 'yyyy')))",
    ),
    "epoch": ("", "BIGINT", "unix_timestamp()"),
    "irand": ("", "BIGINT", "CAST(floor(rand() * 9.2e18D) AS BIGINT)"),
}

#: Registered under the same name; the dialect's rand() is rewritten to irand() by the front end.
SQL_FUNCTIONS = ("sq", "imin", "imax", "getsubstr", "datestringtoepoch", "datetimestringtoepoch", "epochtodatetimestring", "epoch", "irand")



def intdiv(a: Column, b: Column) -> Column:
    """Division that truncates toward zero; a zero divisor raises."""
    return F.call_function("div", a, b)


#: Column builders: operators, and calls of the SQL functions, which ``register`` must have made known to the session.
FUNCTIONS: dict[str, Callable[..., Column]] = {"add": operator.add, "sub": operator.sub, "mul": operator.mul, "intdiv": intdiv, "mod": operator.mod} | {n: partial(F.call_function, n) for n in SQL_FUNCTIONS}


def int_avg(x: Column) -> Column:
    """Average over integers, truncated toward zero; NULL on no rows."""
    n = F.count(x)
    return F.call_function("div", F.sum(x), F.when(n > 0, n))


def list_functions() -> list[str]:
    """Every function of the dialect with its parameters, sorted."""
    shown = [f"{n}({params.lower()}) -> {kind.lower()}" for n, (params, kind, _) in _SPEC.items() if n in SQL_FUNCTIONS and n != "irand"]
    return sorted([*shown, "mod(a bigint, b bigint) -> bigint", "rand() -> bigint", "+(a bigint, b bigint) -> bigint", "-(a bigint, b bigint) -> bigint", "*(a bigint, b bigint) -> bigint", "/(a bigint, b bigint) -> bigint"])


def register(spark: SparkSession) -> None:
    """Make SQL_FUNCTIONS callable from SQL text in this session."""
    for name in SQL_FUNCTIONS:
        params, kind, body = _SPEC[name]
        names = [p.split()[0] for p in params.split(",") if p.strip()]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body.format(**{n: n for n in names})}")
