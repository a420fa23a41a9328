"""Delimited text: fields are split on a literal separator, without quoting."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import MalformedData

#: Strings are cut to this many characters when they are loaded.
STRING_LENGTH = 32


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header: bool = False, skip_last: bool = False, string_length: int | None = STRING_LENGTH) -> DataFrame:
    """Rows of a delimited file in a declared schema of BIGINT and STRING fields.

    Integers are trimmed, read as a float and truncated (12.9 is 12). A line with a wrong number of
    fields, or text in an integer field, fails the query; a header with a wrong number of fields
    fails at once. ``skip_last`` drops the empty field that a trailing separator leaves. Blank lines
    are passed over.
    """
    n = len(schema.fields)
    # One column per line: U+0001 separates nothing, and the reader passes over the header of each file.
    lines = spark.read.schema("value string").option("header", header).option("sep", "\u0001").option("quote", "").csv(path)
    if header:
        first = spark.read.text(path).limit(1).collect()
        got = len(first[0][0].split(sep)) - skip_last if first else n
        if got != n:
            raise MalformedData(f"the header has {got} fields, not {n}")
    parts = F.split("value", re.escape(sep), -1)
    parts = F.slice(parts, 1, F.size(parts) - 1) if skip_last else parts
    wrong = F.raise_error(F.concat(F.lit(f"MALFORMED_DATA: expected {n} fields: "), F.col("value"))).cast("array<string>")
    df = lines.select("value", parts.alias("p")).select("value", F.when(F.size("p") == n, F.col("p")).otherwise(wrong).alias("p"))
    cols = []
    for k, f in enumerate(schema.fields):
        if isinstance(f.dataType, T.LongType):
            number = F.trim(F.col("p")[k]).try_cast("double")
            bad = F.raise_error(F.concat(F.lit(f"TYPE_MISMATCH: {f.name} needs a number: "), F.col("value"))).cast("double")
            cols.append(F.when(number.isNotNull(), number).otherwise(bad).cast("bigint").alias(f.name))
        else:
            cols.append((F.col("p")[k] if string_length is None else F.substring(F.col("p")[k], 1, string_length)).alias(f.name))
    return df.select(*cols)


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    """Write rows as delimited text without quoting; one file per partition."""
    df.write.mode("overwrite").option("header", header).option("sep", sep).option("quote", "").option("escapeQuotes", False).csv(path)
