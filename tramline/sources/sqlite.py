"""SQLite files as a Spark source: one partition a file, opened read-only on the executor that reads it.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").option("path", "/data/*.db").option("table", "od_matrix").option("columns", "a,b").load()

Files are on paths that executors can open (SQLite needs random access). The file's name comes as column `file`.
"""

from __future__ import annotations

import glob
import sqlite3
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_TYPES = (("INT", "bigint"), ("CHAR", "string"), ("TEXT", "string"), ("CLOB", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(declared: str) -> str:
    """The type for a declared type, by SQLite's rules of affinity."""
    upper = declared.upper()
    return next((t for part, t in _TYPES if part in upper), "string" if not upper else "double")


def tables_of(path: str) -> dict[str, list[tuple[str, str]]]:
    """The tables of a file with their columns and declared types."""
    with _connect(path) as db:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
        return {n: [(r[1], r[2]) for r in db.execute(f"PRAGMA table_info({_quoted(n)})")] for n in names}


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _files(self) -> list[str]:
        found = sorted(glob.glob(self.options["path"]))
        if not found:
            raise FileNotFoundError(self.options["path"])
        return found

    def schema(self) -> str:
        columns = dict(tables_of(self._files()[0])[self.options["table"]])
        wanted = [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else list(columns)
        return ", ".join([*(f"`{c}` {spark_type(columns[c])}" for c in wanted), "file string"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._files(), self.options["table"], schema)


class _Reader(DataSourceReader):
    def __init__(self, files: list[str], table: str, schema: StructType):
        self.files, self.table, self.fields = files, table, [(f.name, f.dataType.simpleString()) for f in schema]

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in self.files]

    def read(self, partition: _File) -> Iterator[tuple]:
        kinds = [{"bigint": int, "double": float, "string": str}.get(t, lambda v: v) for n, t in self.fields if n != "file"]
        names = ", ".join(_quoted(n) for n, _ in self.fields if n != "file")
        with _connect(partition.path) as db:
            for row in db.execute(f"SELECT {names} FROM {_quoted(self.table)}"):
                # SQLite types belong to values; they are made those of the columns.
                yield (*(None if v is None else k(v) for v, k in zip(row, kinds, strict=True)), partition.path)


def neighbourhood(file: Column, pattern: str = r"([^/]+?)\.[^./]*$") -> Column:
    """What a file's name says, by the pattern's first group."""
    return F.regexp_extract(file, pattern, 1)


