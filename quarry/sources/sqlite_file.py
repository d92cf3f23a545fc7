"""SQLite database files: a partitioned reader (format "sqlitefile") and a streaming writer.

    spark.dataSource.register(SqliteFile)
    spark.read.format("sqlitefile").option("table", "t").load("/shared/my.db")

Each task opens the file read-only and reads one range of rowids, so the path must be one that executors see. Columns get
the kind of their declared type; a value that can't take it is an error, since a Spark column has one type.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from quarry.errors import NotFound, TypeMismatch
from quarry.values import SPARK_TYPE, affinity, kind_of

#: Rows of an Arrow batch.
BATCH = 8_192
_DECLARED = {"int": "INTEGER", "real": "REAL", "text": "TEXT", "blob": "BLOB", "bool": "BOOLEAN", "time": "TEXT", "other": "TEXT"}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def quoted(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


def tables(path: str) -> list[str]:
    """The tables of a file; views, triggers and automatic indexes are passed over."""
    db = _open(path)
    try:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
    finally:
        db.close()


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlitefile"

    def schema(self) -> StructType:
        db = _open(self.options["path"])
        try:
            columns = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        finally:
            db.close()
        if not columns:
            raise NotFound(f"no such table: {self.options['table']}")
        return StructType([StructField(c[1], SPARK_TYPE[affinity(c[2])]) for c in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.fields = options["path"], options["table"], [(f.name, kind_of(f.dataType)) for f in schema]
        self.types = [to_arrow_type(f.dataType) for f in schema]
        self.count = int(options.get("numpartitions") or options.get("numPartitions") or 8)

    def partitions(self) -> list[_Range]:
        db = _open(self.path)
        try:
            low, high, rows = db.execute(f"SELECT min(rowid), max(rowid), count(*) FROM {quoted(self.table)}").fetchone()
            if rows and high - low + 1 > 2 * rows:  # rowids with gaps: ranges of equal rows, not of equal width
                at = f"SELECT rowid FROM {quoted(self.table)} ORDER BY rowid LIMIT 1 OFFSET ?"
                starts = sorted({db.execute(at, (k * rows // self.count,)).fetchone()[0] for k in range(self.count)})
                return [_Range(a, b) for a, b in zip(starts, [*starts[1:], high + 1], strict=True)]
        except sqlite3.OperationalError:  # WITHOUT ROWID
            return [_Range(None, None)]
        finally:
            db.close()
        if low is None:
            return [_Range(None, None)]
        width = -(-(high - low + 1) // self.count)
        return [_Range(a, min(a + width, high + 1)) for a in range(low, high + 1, width)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        db = _open(self.path)
        try:
            where = "" if part.low is None else f" WHERE rowid >= {part.low} AND rowid < {part.high}"
            names = ", ".join(quoted(n) for n, _ in self.fields)
            cursor = db.execute(f"SELECT {names} FROM {quoted(self.table)}{where}")
            while rows := cursor.fetchmany(BATCH):
                columns = ([_value(v, kind, n) for v in values] for values, (n, kind) in zip(zip(*rows, strict=True), self.fields, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types, strict=True)], names=[n for n, _ in self.fields])
        finally:
            db.close()


def _value(v, kind: str, column: str):
    if v is None:
        return None
    if kind == "int" and isinstance(v, float) and v == int(v):
        return int(v)
    if kind == "real" and isinstance(v, int):
        return float(v)
    if kind == "bool" and isinstance(v, (int, float)):
        return v != 0
    if kind == "text" and isinstance(v, (int, float)):
        return str(v)
    if kind == "blob" and isinstance(v, str):
        return v.encode()
    if isinstance(v, {"int": int, "real": float, "text": str, "blob": bytes, "bool": bool}[kind]):
        return v
    raise TypeMismatch(f"column {column} holds {v!r}, which is no {kind}")


def write_sqlite(df: DataFrame, path: str, table: str, primary: str | None = None, batch: int = 10_000) -> int:
    """Writes df as a table of a file on the driver's machine, a partition at a time; returns the rows written.

    One file has one writer, so this sink is for results that a SQLite file can hold.
    """
    columns = ", ".join(f"{quoted(f.name)} {_DECLARED[kind_of(f.dataType)]}{' PRIMARY KEY' * (f.name == primary)}" for f in df.schema)
    marks = ", ".join("?" * len(df.columns))
    db, n, rows = sqlite3.connect(path), 0, []
    plain = lambda v: bytes(v) if isinstance(v, bytearray) else int(v) if isinstance(v, bool) else v if v is None or isinstance(v, (int, float, str, bytes)) else str(v)
    try:
        with db:
            db.execute(f"CREATE TABLE {quoted(table)} ({columns})")
            for r in df.toLocalIterator(prefetchPartitions=True):
                rows.append(tuple(plain(v) for v in r))
                n += 1
                if len(rows) == batch:
                    db.executemany(f"INSERT INTO {quoted(table)} VALUES ({marks})", rows)
                    rows = []
            db.executemany(f"INSERT INTO {quoted(table)} VALUES ({marks})", rows)
    finally:
        db.close()
    return n


def attach(engine, path: str, partitions: int = 8) -> list[str]:
    """Makes every table of a file readable by name in an engine."""
    engine.spark.dataSource.register(SqliteFile)
    names = tables(path)
    for t in names:
        engine.register(t, engine.spark.read.format("sqlitefile").option("table", t).option("numPartitions", partitions).load(path))
    return names
