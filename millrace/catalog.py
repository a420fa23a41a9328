"""The table catalog: a text form for people, and the manifest that transactions publish."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from millrace.errors import DuplicateTable, NoSuchTable, ParseError

_KINDS = {"int": "bigint", "integer": "bigint", "string": "string", "varchar": "string", "text": "string"}


@dataclass(frozen=True)
class Table:
    """A table: its fields, the folders that hold its rows, and the number of its last change."""

    name: str
    fields: tuple[tuple[str, str], ...]
    folders: tuple[str, ...] = ()
    version: int = 0

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.LongType() if k == "bigint" else T.StringType()) for n, k in self.fields])

    def __str__(self) -> str:
        return f"{self.name}({', '.join(f'{n} {"int" if k == "bigint" else "string"}' for n, k in self.fields)})"


def parse_fields(text: str) -> tuple[tuple[str, str], ...]:
    """``a int, b string``: words past the second of an entry (``primary key``) are passed over; so is a length."""
    out = []
    for entry in re.sub(r"\(\s*\d+\s*\)", "", text).split(","):
        words = entry.lower().split()
        if not 2 <= len(words) <= 4 or words[1] not in _KINDS:
            raise ParseError(f"not a field: {entry.strip()!r}")
        out.append((words[0], _KINDS[words[1]]))
    if len({n for n, _ in out}) != len(out):
        raise ParseError("a field name is used twice")
    return tuple(out)


@dataclass
class Catalog:
    """Tables by lower-case name. A snapshot is a copy; Table values never change."""

    tables: dict[str, Table] = field(default_factory=dict)

    def copy(self) -> Catalog:
        return Catalog(dict(self.tables))

    def get(self, name: str) -> Table:
        try:
            return self.tables[name.lower()]
        except KeyError:
            raise NoSuchTable(name) from None

    def create(self, name: str, fields: tuple[tuple[str, str], ...]) -> Table:
        if name.lower() in self.tables:
            raise DuplicateTable(name)
        self.tables[name.lower()] = t = Table(name.lower(), fields)
        return t

    def drop(self, name: str) -> Table:
        t = self.get(name)
        del self.tables[name.lower()]
        return t

    def number(self, name: str) -> int:
        """A table's place in the order of creation, from 0."""
        return list(self.tables).index(self.get(name).name)

    def of_file(self, path: str) -> Table:
        """The table that a folder or a file belongs to."""
        for t in self.tables.values():
            if any(path == f or path.startswith(f"{f}/") for f in t.folders):
                return t
        raise NoSuchTable(path)

    def with_column(self, column: str) -> list[str]:
        """Names of the tables that have a column."""
        return sorted(t.name for t in self.tables.values() if column.lower() in dict(t.fields))

    def __len__(self) -> int:
        return len(self.tables)

    def __str__(self) -> str:
        return "".join(f"{t}\n" for _, t in sorted(self.tables.items()))

    @classmethod
    def parse(cls, text: str) -> Catalog:
        """One ``name(field type, ...)`` a line."""
        out = cls()
        for line in filter(None, map(str.strip, text.splitlines())):
            m = re.fullmatch(r"(\w+)\s*\((.*)\)", line)
            if not m:
                raise ParseError(f"not a table: {line!r}")
            out.create(m[1], parse_fields(m[2]))
        return out

    def to_json(self) -> str:
        return json.dumps({n: [t.fields, t.folders, t.version] for n, t in self.tables.items()})

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        return cls({n: Table(n, tuple(map(tuple, f)), tuple(d), v) for n, (f, d, v) in json.loads(text).items()})
