"""Parquet tables, constant rows, and the sum of one column of a delimited file."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import EngineError, NoSuchTable, TypeMismatch
from millrace.sources.delimited import read_delimited


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data folder. Column pruning and filters reach the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def read_tables(spark: SparkSession, root: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Several tables, also as temporary views of the same names."""
    out = {}
    for name in names:
        out[name] = read_table(spark, root, name)
        out[name].createOrReplaceTempView(name)
    return out


def values(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """Constant rows."""
    return spark.createDataFrame(list(rows), schema)


def field_sum(spark: SparkSession, path: str, schema: T.StructType, field: str, sep: str = ",", header: bool = True) -> int:
    """The sum of an integer column of a delimited file."""
    kinds = {f.name.lower(): f.dataType for f in schema.fields}
    if field.lower() not in kinds:
        raise EngineError(f"no field {field}")
    if not isinstance(kinds[field.lower()], T.LongType):
        raise TypeMismatch(f"{field} is not an integer field")
    try:
        df = read_delimited(spark, path, schema, sep=sep, header=header)
        return df.agg(F.sum(field)).first()[0] or 0
    except EngineError:
        raise
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise NoSuchTable(path) from e
        raise
