"""SQLite files as a Spark data source: parallel reads by row ids with filters, writes that commit at once.

    register(spark)
    spark.read.format("sqlite").option("path", p).option("table", t).option("numPartitions", 8).load()
    df.write.format("sqlite").mode("append").option("path", p).option("table", t).save()

The file has to lie where all executors see it. Comparisons with constants, IN,
IS NULL and beginnings of texts go into the statement that the store runs. A write
makes a file for each task, beside the store, and the driver moves all of them in
within one transaction, by the store's own statement; rows don't pass through
Python there. A failed write leaves the table as it was; a task that outlives its
failed job may leave its part beside the store.
"""

from __future__ import annotations

import glob
import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

#: Types by what SQLite's affinity rules look for in a declared type, and the declared types of Spark's.
TYPES = (("BOOL", T.BooleanType()), ("INT", T.LongType()), ("CHAR", T.StringType()), ("CLOB", T.StringType()), ("TEXT", T.StringType()), ("BLOB", T.BinaryType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()))
DECLARED = {"boolean": "BOOLEAN", "tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "float": "REAL", "double": "REAL", "string": "TEXT", "binary": "BLOB"}
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
FETCHED = 10_000


def prepare(path: str) -> None:
    """Makes the folder of a file that is to come."""
    os.makedirs(os.path.dirname(local_path({"path": path})), exist_ok=True)


def name_of(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def local_path(options: dict) -> str:
    path = options["path"].removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError("a SQLite file lies in a mounted folder")
    return path


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(path, timeout=60)


def condition(f: Filter) -> tuple[str, list] | None:
    """A filter as SQL and its values, or None if the store can't be asked."""
    if not hasattr(f, "attribute") or len(f.attribute) != 1:
        return None
    column = name_of(f.attribute[0])
    if isinstance(f, (IsNull, IsNotNull)):
        return f"{column} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []
    if isinstance(f, In):
        values = [v for v in f.value if v is not None]
        plain = all(isinstance(v, (bool, int, float, str)) for v in values) and len(values) < 500
        return (f"{column} IN ({', '.join('?' * len(values))})", values) if plain else None
    if not isinstance(getattr(f, "value", None), (bool, int, float, str)):
        return None
    if isinstance(f, StringStartsWith):
        return f"substr({column}, 1, ?) = ?", [len(f.value), f.value]
    return (f"{column} {COMPARED[type(f)]} ?", [f.value]) if type(f) in COMPARED else None


@dataclass
class Rows(InputPartition):
    """Row ids from low to high, both included."""

    low: int
    high: int


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.log = local_path(options), options["table"], options.get("log")
        self.parts, self.schema = int(options.get("numpartitions") or options.get("numPartitions") or 8), schema
        self.conditions: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            made = condition(f)
            if made is None:
                yield f
            else:
                self.conditions.append(made)

    def partitions(self) -> list[Rows]:
        with connect(self.path) as store:
            low, high = store.execute(f"SELECT min(rowid), max(rowid) FROM {name_of(self.table)}").fetchone()
        if low is None:
            return [Rows(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def statement(self, rows: Rows) -> tuple[str, list]:
        columns = ", ".join(name_of(f.name) for f in self.schema)
        where = ["rowid BETWEEN ? AND ?", *(sql for sql, _ in self.conditions)]
        return f"SELECT {columns} FROM {name_of(self.table)} WHERE {' AND '.join(where)}", [rows.low, rows.high, *(v for _, vs in self.conditions for v in vs)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        sql, values = self.statement(partition)
        if self.log:
            with open(self.log, "a") as out:
                out.write(f"{sql} {values}\n")
        flags = [i for i, f in enumerate(self.schema) if isinstance(f.dataType, T.BooleanType)]
        store = connect(self.path)
        try:
            found = store.execute(sql, values)
            while some := found.fetchmany(FETCHED):
                for row in some:
                    yield tuple(bool(v) if i in flags and v is not None else v for i, v in enumerate(row)) if flags else row
        finally:
            store.close()


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int


class SqliteWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.table, self.overwrite = local_path(options), options["table"], overwrite
        unknown = [f.name for f in schema if f.dataType.simpleString() not in DECLARED]
        if unknown:
            raise ValueError(f"SQLite has no type for {', '.join(unknown)}")
        self.columns = [(f.name, DECLARED[f.dataType.simpleString()]) for f in schema]
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def _create(self, store: sqlite3.Connection) -> None:
        store.execute(f"CREATE TABLE IF NOT EXISTS {name_of(self.table)} ({', '.join(f'{name_of(n)} {kind}' for n, kind in self.columns)})")

    def write(self, iterator: Iterator) -> Part:
        os.makedirs(self.parts, exist_ok=True)
        path, n = f"{self.parts}/{uuid.uuid4().hex}.db", 0
        with connect(path) as store:
            store.execute("PRAGMA synchronous = OFF")
            self._create(store)

            def rows():
                nonlocal n
                for row in iterator:
                    n += 1
                    yield tuple(bytes(v) if isinstance(v, bytearray) else v for v in row)

            store.executemany(f"INSERT INTO {name_of(self.table)} VALUES ({', '.join('?' * len(self.columns))})", rows())
        store.close()
        return Part(path, n)

    def commit(self, messages: list[Part | None]) -> None:
        table, columns = name_of(self.table), ", ".join(name_of(n) for n, _ in self.columns)
        store = sqlite3.connect(self.path, timeout=60, isolation_level=None)
        try:
            # a part at a time is attached outside the transaction, so its rows are first gathered in one temporary table
            store.execute(f"CREATE TEMP TABLE gathered ({', '.join(f'{name_of(n)} {kind}' for n, kind in self.columns)})")
            for m in messages:
                if m is not None and m.rows:
                    store.execute("ATTACH ? AS part", [m.path])
                    store.execute(f"INSERT INTO temp.gathered SELECT {columns} FROM part.{table}")
                    store.execute("DETACH part")
            store.execute("BEGIN IMMEDIATE")
            self._create(store)
            if self.overwrite:
                store.execute(f"DELETE FROM main.{table}")
            store.execute(f"INSERT INTO main.{table} ({columns}) SELECT {columns} FROM temp.gathered")
            store.execute("COMMIT")
        finally:
            store.close()
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        for f in glob.glob(f"{glob.escape(self.parts)}/*"):
            os.remove(f)
        if os.path.isdir(self.parts):
            os.rmdir(self.parts)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        with connect(local_path(self.options)) as store:
            found = store.execute(f"PRAGMA table_info({name_of(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"there is no table {self.options['table']}")
        of = lambda kind: next((t for part, t in TYPES if part in kind.upper()), T.DoubleType())
        return T.StructType([T.StructField(name, of(kind), not required) for _, name, kind, required, *_ in found])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format sqlite known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
