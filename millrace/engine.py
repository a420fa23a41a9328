"""Engine and Connection: SQL text in, DataFrames and table versions out."""

from __future__ import annotations

import enum
import math
import os
import re
from dataclasses import dataclass, replace
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import frontend
from millrace.catalog import Catalog, Table, parse_fields
from millrace.errors import IllegalOperation, IllegalTransaction, ParseError, TypeMismatch
from millrace.functions import register
from millrace.sources import read_delimited
from millrace.txn import Store, Transaction


def _local(uri: str) -> str:
    """The path of a file's address on the store's file system."""
    return unquote(re.sub(r"^file:/+", "/", uri))


#: Results of more rows, where tables only multiply rows, are made from counts, about so many rows a task; in so many tasks at most, as Spark
#: samples 100 runs for each on the driver. A run is so many copies of a row at most, made in steps; a task holds the rows of one step.
COPIED_ROWS, COPIED_TASKS, COPIED_RUN, COPIED_STEP = 1 << 24, 1000, 1 << 22, 1 << 10


class QueryType(enum.Enum):
    ITERATOR = "iterator"
    BEGIN = "begin"
    COMMIT = "commit"
    ABORT = "abort"
    CREATE_TABLE = "create table"
    DROP_TABLE = "drop table"
    EXPLAIN = "explain"
    UNKNOWN = "unknown"


@dataclass
class Result:
    kind: QueryType
    df: DataFrame | None = None
    text: str = ""


class Engine:
    """A store of tables. Each connection has its own session, views and transaction."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(root, spark)

    def connect(self) -> Connection:
        return Connection(self)

    @property
    def catalog(self) -> Catalog:
        return self.store.load()

    def load_catalog(self, path: str) -> None:
        """Create the tables of a text catalog."""
        with open(path) as f:
            tables = Catalog.parse(f.read()).tables.values()
        txn = Transaction(self.store)
        for t in tables:
            txn.view.create(t.name, t.fields)
            txn.put(txn.view.get(t.name))
        txn.commit()

    def vacuum(self, older: float = 3600.0) -> list[str]:
        """Remove what no table names and what is older than so many seconds: dropped tables, superseded and rolled-back versions.
        Transactions that began before may still read these, so give them time."""
        return self.store.vacuum(older)

    def save_catalog(self, path: str) -> None:
        with open(path, "w") as f:
            f.write(str(self.catalog))

    def import_folder(self, folder: str, suffix: str = "tbl", sep: str = "|") -> dict[str, int]:
        """Load ``<folder>/<table>.<suffix>`` into every table of the catalog; the last, empty field of a line is dropped."""
        con = self.connect()
        return {name: con.load(name, os.path.join(folder, f"{name}.{suffix}"), sep=sep, header=False, skip_last=True) for name in sorted(self.catalog.tables)}


class Connection:
    def __init__(self, engine: Engine):
        self.engine, self.store = engine, engine.store
        self.spark = engine.spark.newSession()
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark.conf.set("spark.sql.ansi.enabled", "true")
        register(self.spark)
        self.txn: Transaction | None = None
        self._views: set[str] = set()

    # -- transactions

    def begin(self) -> None:
        if self.txn:
            raise IllegalTransaction("a transaction is open")
        self.txn = Transaction(self.store)

    def commit(self) -> None:
        if not self.txn:
            raise IllegalTransaction("no transaction is open")
        txn, self.txn = self.txn, None
        txn.commit()

    def rollback(self) -> None:
        if not self.txn:
            raise IllegalTransaction("no transaction is open")
        txn, self.txn = self.txn, None
        txn.rollback()

    def _in_txn(self, work):
        """Run work(txn) in the open transaction, or in one of its own."""
        txn = self.txn or Transaction(self.store)
        out = work(txn)
        if txn is not self.txn:
            txn.commit()
        return out

    # -- tables

    def frame(self, table: Table) -> DataFrame:
        """The rows of a table version; the declared schema is given, so nothing is inferred."""
        if not table.folders:
            return self.spark.createDataFrame([], table.schema)
        return self.spark.read.schema(table.schema).parquet(*table.folders)

    def table(self, name: str) -> DataFrame:
        return self._in_txn(lambda txn: self.frame(txn.read(name)))

    def _show(self, txn: Transaction, sql: str) -> None:
        """Register the views that a text needs, as this transaction sees them."""
        for name in self._views - set(txn.view.tables):
            self.spark.catalog.dropTempView(name)
        self._views = set(txn.view.tables)
        for name in frontend.tables_in(sql, set(txn.view.tables)):
            self.frame(txn.read(name)).createOrReplaceTempView(name)

    def select(self, sql: str, txn: Transaction | None = None) -> DataFrame:
        text = frontend.rewrite(sql)
        txn = txn or self.txn or Transaction(self.store)
        self._show(txn, text)
        df = self.spark.sql(text)
        frontend.refuse(df)
        how = frontend.multiplied(text, {name: [f for f, _ in t.fields] for name, t in txn.view.tables.items()})
        return frontend.named(self._copied(df, how) if how else df, sql)

    def _copied(self, df: DataFrame, how: frontend.Multiplied) -> DataFrame:
        """The rows of ``df``; where they are very many, unlike rows are joined and sorted with their number of copies, and the copies are made last."""
        groups = self.spark.sql(how.groups)
        made = groups.agg(F.sum(F.col("_n").cast("double"))).first()[0] or 0
        if made <= COPIED_ROWS:
            return df
        cols = [F.col(f"_c{k}") for k in range(len(df.columns))]
        order = [cols[k].asc() if up else cols[k].desc() for k, up in how.order]

        def cut(rows: DataFrame, size: int) -> DataFrame:
            """Rows of ``_n`` copies as rows of so many at most."""
            rows = rows.withColumn("_k", F.explode(F.expr(f"sequence(0L, (_n - 1) div {size})")))
            return rows.withColumn("_n", F.expr(f"least({size}, _n - _k * {size})"))

        runs = cut(groups, COPIED_RUN).repartitionByRange(min(COPIED_TASKS, math.ceil(made / COPIED_ROWS)), *order, *cols, "_k")
        # Generated code holds all rows that it makes from one row it reads. It ends at a sort, so steps are cut before the sort and not after it.
        steps = cut(runs, COPIED_STEP).sortWithinPartitions(*(order or cols))
        return steps.select(*cols, F.explode(F.expr("sequence(1L, _n)"))).select(*cols).toDF(*df.columns)

    def _append(self, txn: Transaction, name: str, df: DataFrame) -> int:
        table = txn.read(name)
        if len(df.columns) != len(table.fields):
            raise TypeMismatch(f"{name} has {len(table.fields)} fields, not {len(df.columns)}")
        number = ("tinyint", "smallint", "int", "bigint")
        for (field, kind), (_, got) in zip(table.fields, df.dtypes, strict=True):
            if (kind == "bigint") != (got in number) and got != "void":
                raise TypeMismatch(f"{name}.{field} is {kind}, not {got}")
        typed = df.toDF(*[n for n, _ in table.fields]).select(*[F.col(n).cast(k) for n, k in table.fields])
        folder = self.store.new_folder(table.name)
        typed.write.parquet(folder)
        txn.put(replace(table, folders=(*table.folders, folder)))
        return self.spark.read.schema(table.schema).parquet(folder).count()

    def insert(self, name: str, df: DataFrame) -> int:
        return self._in_txn(lambda txn: self._append(txn, name, df))

    def delete(self, name: str, condition: str | None = None) -> int:
        """Copy-on-write, file by file: only files that hold a row whose condition is true are written anew, without such rows."""

        def work(txn: Transaction) -> int:
            table = txn.read(name)
            df = self.frame(table)
            if condition is None:
                n = df.count()
                txn.put(replace(table, folders=()))
                return n
            cond = frontend.rewrite(condition)
            self._show(txn, cond)
            hit = F.coalesce(F.expr(cond), F.lit(False))
            frontend.refuse(df.filter(hit))
            if not table.folders:
                return 0
            touched = {r["file"]: r["n"] for r in df.select(F.col("_metadata.file_path").alias("file"), hit.alias("hit")).filter("hit").groupBy("file").agg(F.count("*").alias("n")).collect()}
            if touched:
                own = {_local(f) for f in touched}
                left = []
                for path in table.folders:
                    files = [_local(f) for f in self.spark.read.schema(table.schema).parquet(path).inputFiles()]
                    left += [path] if own.isdisjoint(files) else [f for f in files if f not in own]
                folder = self.store.new_folder(table.name)
                self.spark.read.schema(table.schema).parquet(*sorted(own)).filter(~hit).write.parquet(folder)
                txn.put(replace(table, folders=(*left, folder)))
            return sum(touched.values())

        return self._in_txn(work)

    def compact(self, name: str, rows_per_file: int = 1 << 24) -> int:
        """Write a table's rows anew into one folder; returns how many files it had. The old ones stay until ``Engine.vacuum``."""

        def work(txn: Transaction) -> int:
            table = txn.read(name)
            if not table.folders:
                return 0
            df = self.frame(table)
            folder = self.store.new_folder(table.name)
            # By its own files' bytes and no shuffle key: Spark deals the rows evenly over few tasks.
            df.hint("rebalance").write.option("maxRecordsPerFile", rows_per_file).parquet(folder)
            txn.put(replace(table, folders=(folder,)))
            return len(df.inputFiles())

        return self._in_txn(work)

    def stats(self, name: str) -> dict[str, int]:
        """Rows and files of a table."""
        df = self.table(name)
        return {"rows": df.count(), "files": len(df.inputFiles())}

    def load(self, name: str, path: str, sep: str = ",", header: bool = True, skip_last: bool = False) -> int:
        """Append a delimited file to a table in one batch."""
        return self._in_txn(lambda txn: self._append(txn, name, read_delimited(self.spark, path, txn.read(name).schema, sep, header, skip_last)))

    # -- statements

    def _count(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "count bigint")

    def sql(self, text: str) -> Result:
        """Run one statement. INSERT and DELETE return one row with the column ``count``."""
        text = text.strip().removesuffix(";").strip()
        ts = frontend.tokens(text)
        if not ts:
            raise ParseError("empty statement", 0)
        words = [t.word for t in ts[:3]]
        rest = text[ts[1].at :] if len(ts) > 1 else ""
        match words[0]:
            case "select" | "(" | "with" | "values":
                return Result(QueryType.ITERATOR, self.select(text))
            case "begin":
                self.begin()
                return Result(QueryType.BEGIN)
            case "start" if words[1:2] == ["transaction"]:
                self.begin()
                return Result(QueryType.BEGIN)
            case "commit":
                self.commit()
                return Result(QueryType.COMMIT)
            case "rollback" | "abort":
                self.rollback()
                return Result(QueryType.ABORT)
            case "explain":
                return Result(QueryType.EXPLAIN, text=self.explain(rest))
            case "insert":
                return self._insert(text, ts)
            case "delete":
                return self._delete(text, ts)
            case "create" | "drop" if words[1:2] == ["table"] and len(ts) > 2:
                return self._ddl(text, ts)
        raise ParseError(f"invalid query: {words[0]}", ts[0].at)

    def _insert(self, text: str, ts: list[frontend.Token]) -> Result:
        if len(ts) < 4 or ts[1].word != "into":
            raise ParseError("INSERT INTO table ... is expected", ts[min(1, len(ts) - 1)].at)
        if ts[3].text == "(" and not (len(ts) > 4 and ts[4].word == "select"):
            raise IllegalOperation("INSERT takes no column list")
        name, source = ts[2].word.strip("`"), text[ts[3].at :]

        def work(txn: Transaction) -> int:
            return self._append(txn, name, self.select(source, txn))

        return Result(QueryType.ITERATOR, self._count(self._in_txn(work)))

    def _delete(self, text: str, ts: list[frontend.Token]) -> Result:
        if len(ts) < 3 or ts[1].word != "from" or len(ts) > 3 and (ts[3].word != "where" or len(ts) < 5):
            raise ParseError("DELETE FROM table [WHERE ...] is expected", ts[min(3, len(ts) - 1)].at)
        n = self.delete(ts[2].word.strip("`"), text[ts[4].at :] if len(ts) > 3 else None)
        return Result(QueryType.ITERATOR, self._count(n))

    def _ddl(self, text: str, ts: list[frontend.Token]) -> Result:
        name = ts[2].word.strip("`")
        if ts[0].word == "drop":
            self._in_txn(lambda txn: txn.drop(name))
            return Result(QueryType.DROP_TABLE, text=name)
        if len(ts) < 5 or ts[3].text != "(" or ts[-1].text != ")":
            raise ParseError("CREATE TABLE name (field type, ...) is expected", ts[-1].at)
        fields = parse_fields(text[ts[4].at : ts[-1].at])

        def work(txn: Transaction) -> None:
            txn.put(txn.view.create(name, fields))

        self._in_txn(work)
        return Result(QueryType.CREATE_TABLE, text=name)

    def explain(self, text: str, mode: str = "formatted") -> str:
        """The plan of a SELECT, or of the rows that an INSERT or DELETE handles; EXPLAIN COST shows sizes and cardinalities."""
        ts = frontend.tokens(text)
        if ts and ts[0].word in ("cost", "formatted", "extended"):
            mode, text = ts[0].word, text[ts[1].at :] if len(ts) > 1 else ""
            ts = frontend.tokens(text)
        if ts and ts[0].word == "insert":
            text = text[ts[3].at :]
        elif ts and ts[0].word == "delete":
            text = "select * " + text[ts[1].at :]
        jvm = self.spark._jvm
        df = self.select(text)
        return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
