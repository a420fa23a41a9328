"""An interactive shell: ``python -m millrace.shell ROOT``. Statements end with ``;``."""

from __future__ import annotations

import os
import sys
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from millrace.engine import Connection, Engine, QueryType
from millrace.errors import EngineError, ParseError
from millrace.functions import list_functions
from millrace.session import get_session

HELP = r"""\h  \?              this text
\c path             change to the database of a catalog file (its tables are created the first time)
\d                  tables
\f                  functions
\a                  aligned or comma-separated results
\o                  cost-based join order on or off
\z                  statistics (kept by Spark; nothing to do)
\l table path [sep] [hasHeader]   load a delimited file
explain statement;  show the plan
\q                  leave
"""
WIDTH = 120
#: Marks the jobs of the shell's statements.
TAG = "millrace-shell"


def render(df: DataFrame, aligned: bool) -> Iterable[str]:
    """Header and rows, one line each; rows arrive partition by partition."""
    cell = max(8, WIDTH // max(1, len(df.columns)))
    line = (lambda xs: "|".join(str(x)[:cell].ljust(cell) for x in xs)) if aligned else (lambda xs: ",".join(map(str, xs)))
    yield line(df.columns)
    for row in df.toLocalIterator():
        yield line(row)


class Shell:
    def __init__(self, con: Connection, out: Callable[[str], None] = print):
        self.con, self.out, self.aligned, self.buffer = con, out, True, ""

    def feed(self, line: str) -> bool:
        """Take one line; False ends the shell."""
        if not self.buffer and line.strip().startswith("\\"):
            return self.command(line.strip())
        self.buffer += line + "\n"
        while ";" in self.buffer:
            text, self.buffer = self.buffer.split(";", 1)
            if text.strip():
                self.run(text.strip())
        if not self.buffer.strip():
            self.buffer = ""
        return True

    def command(self, line: str) -> bool:
        name, *args = line.split()
        try:
            if name in (r"\h", r"\?"):
                self.out(HELP)
            elif name == r"\c":
                self.use(args[0])
            elif name == r"\d":
                self.out(str(self.con.engine.catalog))
            elif name == r"\f":
                self.out("\n".join(list_functions()))
            elif name == r"\a":
                self.aligned = not self.aligned
            elif name == r"\o":
                on = self.con.spark.conf.get("spark.sql.cbo.enabled") != "true"
                for key in ("spark.sql.cbo.enabled", "spark.sql.cbo.joinReorder.enabled"):
                    self.con.spark.conf.set(key, str(on).lower())
                self.out(f"join optimization {'on' if on else 'off'}")
            elif name == r"\z":
                self.out("nothing to do")
            elif name == r"\l":
                n = self.con.load(args[0], args[1], *(args[2:3] or [","]), header=(args[3:4] or ["true"])[0].lower() == "true")
                self.out(f"{n} rows")
            elif name == r"\q":
                return False
            else:
                self.out(f"unknown command {name}; \\h lists them")
        except (EngineError, IndexError, OSError) as e:
            self.out(f"error: {e or 'an argument is missing'}")
        return True

    def use(self, path: str) -> None:
        """Each catalog file has a store of its own beside it."""
        engine = Engine(self.con.engine.spark, f"{os.path.splitext(os.path.abspath(path))[0]}.store")
        if not len(engine.catalog):
            engine.load_catalog(path)
        if self.con.txn:
            self.con.rollback()
        self.con = engine.connect()

    def run(self, text: str) -> None:
        began = time.time()
        self.con.spark.sparkContext.addJobTag(TAG)
        try:
            r = self.con.sql(text)
            if r.df is not None:
                n = -1
                for line in render(r.df, self.aligned):
                    self.out(line)
                    n += 1
                self.out(f"({n} results, {time.time() - began:.3f} s)")
            else:
                self.out(r.text or r.kind.value)
            if r.kind in (QueryType.CREATE_TABLE, QueryType.DROP_TABLE):
                self.out(str(self.con.engine.catalog))
        except KeyboardInterrupt:
            self.con.spark.sparkContext.cancelJobsWithTag(TAG)
            if self.con.txn:
                self.con.rollback()
            self.out("aborted")
        except ParseError as e:
            if e.position is not None:
                self.out(text + "\n" + " " * e.position + "^")
            self.out(f"error: {e}")
        except Exception as e:  # a shell goes on after any failed statement
            self.out(f"error: {str(e).splitlines()[0]}")


def main() -> None:
    root = sys.argv[1] if len(sys.argv) > 1 else "millrace-data"
    shell = Shell(Engine(get_session(), root).connect())
    prompt = "> "
    while True:
        try:
            if not shell.feed(input(prompt)):
                return
        except EOFError:
            return
        except KeyboardInterrupt:
            shell.buffer = ""
        prompt = ". " if shell.buffer else "> "


if __name__ == "__main__":
    main()
