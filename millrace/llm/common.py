"""What the operators of this subpackage share: table access, word patterns and durable cuts of lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The six white-space characters that part words.
SPACE = " \t\n\x0b\x0c\r"
#: A run of them, for Java's and DuckDB's patterns.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch that goes to Python.
ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A whole table, or the named columns of it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ship(spark: SparkSession) -> None:
    """Send this package's code along with the application, so that workers can import it wherever the
    driver was started. Spark's own file server carries it. Batches of rows for Python are kept small,
    since a row may hold a whole document, unless the session says otherwise."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":  # Spark's own default
        spark.conf.set(_BATCH, str(ROWS))
    if getattr(sc, "_millrace_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "millrace_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for where, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._millrace_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where one machine runs all of them."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/millrace-shared"
    return root.rstrip("/")


def _folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder, which goes when the application ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/millrace/{sc.applicationId}"
    if getattr(sc, "_millrace_folder", None) != path:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(there)
        fs.deleteOnExit(there)
        sc._millrace_folder = path
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read back: later steps don't compute them again,
    and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete what ``cut`` has written in this application. Results that haven't been stored elsewhere can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def returns(df: DataFrame, columns: list[str], rest: str) -> StructType:
    """The schema of some columns as they are, whatever the names in their types, and of more."""
    return StructType([*(df.schema[c] for c in columns), *StructType.fromDDL(rest).fields])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and wherever the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def unit(key: Column, seed: str = "") -> Column:
    """A number in (0, 1) that the key decides, the same on every engine: 52 bits of MD5."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
