"""The engine: SQL text of the dialect in, DataFrames out; statements that write go to a versioned table store."""

from __future__ import annotations

import dataclasses
import json
import re
import tempfile
import types
import typing
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quarry.errors import NotFound, ParseError, StorageError, TypeMismatch, Unsupported
from quarry.functions import runtime
from quarry.sql.ast import Node
from quarry.sql.lexer import statements
from quarry.sql.lower import Lowering, Source
from quarry.sql.parser import parse
from quarry.store.store import Store, Transaction
from quarry.values import Expr, kind_of, literal, name

_views = 0


def _view(df: DataFrame) -> str:
    global _views
    _views += 1
    view = f"quarry_{id(df.sparkSession)}_{_views}"
    df.createOrReplaceTempView(view)
    return view


def widened(df: DataFrame) -> DataFrame:
    """Whole numbers as long and reals as double: the dialect has one type of each. Casts of columns don't hinder push-down."""
    wide = {f.name: "bigint" if kind_of(f.dataType) == "int" else "double" for f in df.schema if kind_of(f.dataType) in ("int", "real") and f.dataType.simpleString() not in ("bigint", "double")}
    return df.select(*[F.col(name(c)).cast(wide[c]).alias(c) if c in wide else F.col(name(c)) for c in df.columns]) if wide else df


class Query:
    """A statement with parameters: engine.query(sql).bind(1).fetch_all(tuple)."""

    def __init__(self, engine: Engine, sql: str):
        self._engine, self._sql, self._values = engine, sql, []

    def bind(self, *values: Any) -> Query:
        self._values += values
        return self

    def dataframe(self) -> DataFrame:
        return self._engine.sql(self._sql, self._values)

    def fetch_all(self, kind: type | None = None) -> list:
        return [convert(r, kind) for r in self.dataframe().collect()]

    def fetch_one(self, kind: type | None = None):
        found = self.fetch_optional(kind)
        if found is None:
            raise NotFound("the query returned no rows")
        return found

    def fetch_optional(self, kind: type | None = None):
        rows = self.dataframe().limit(1).collect()
        return convert(rows[0], kind) if rows else None

    def fetch_stream(self, kind: type | None = None) -> Iterator:
        """Rows one partition at a time, the next one prefetched."""
        return (convert(r, kind) for r in self.dataframe().toLocalIterator(prefetchPartitions=True))

    def execute(self) -> int:
        return self._engine.execute(self._sql, self._values)


def convert(row: Row, kind: type | None):
    """A row as kind: None and Row leave it, tuple and tuple[...] make a tuple, a dataclass is filled by field name
    (metadata: rename, skip), any other type takes the only column."""
    if kind is None or kind is Row:
        return row
    if kind is tuple:
        return tuple(row)
    if typing.get_origin(kind) is tuple:
        parts = typing.get_args(kind)
        if len(parts) != len(row):
            raise TypeMismatch(f"{len(row)} columns for a tuple of {len(parts)}")
        return tuple(coerce(v, t) for v, t in zip(row, parts, strict=True))
    if dataclasses.is_dataclass(kind):
        given, hints = {c.lower(): v for c, v in row.asDict().items()}, typing.get_type_hints(kind)
        out = {}
        for f in dataclasses.fields(kind):
            if f.metadata.get("skip"):
                continue
            column = f.metadata.get("rename", f.name).lower()
            if column not in given:
                raise NotFound(f"no column {column} for {kind.__name__}.{f.name}")
            out[f.name] = coerce(given[column], hints[f.name])
        return kind(**out)
    if len(row) != 1:
        raise TypeMismatch(f"{len(row)} columns for one {getattr(kind, '__name__', kind)}")
    return coerce(row[0], kind)


def coerce(value: Any, kind: Any) -> Any:
    if typing.get_origin(kind) in (typing.Union, types.UnionType):
        parts = typing.get_args(kind)
        if value is None and type(None) in parts:
            return None
        return coerce(value, next(p for p in parts if p is not type(None)))
    if value is None:
        raise TypeMismatch(f"NULL for {getattr(kind, '__name__', kind)}")
    if kind is Any or isinstance(value, typing.get_origin(kind) or kind) and not (kind is int and isinstance(value, bool)):
        return value
    if kind is bool and isinstance(value, (int, float)):
        return bool(value)
    if kind is int and isinstance(value, (bool, int)) or kind is float and isinstance(value, (int, float)):
        return kind(value)
    if kind is bytes and isinstance(value, bytearray):
        return bytes(value)
    if (typing.get_origin(kind) or kind) in (dict, list) and isinstance(value, str):  # JSON is text in a table
        try:
            found = json.loads(value)
        except ValueError:
            found = None
        if isinstance(found, typing.get_origin(kind) or kind):
            return found
    if kind is str and isinstance(value, (int, float)):
        return str(value)
    raise TypeMismatch(f"{type(value).__name__} for {getattr(kind, '__name__', kind)}")


class Engine:
    """One database: DataFrames registered by name, and the tables of a store (a folder; None for a private one).

    A DataFrame that sql() returns is bound to the table versions of its call, whatever is written later.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # Recursion ends where a query ends it, not at Spark's limits of levels and rows.
        spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
        shared = spark.conf.get("spark.checkpoint.dir", None)
        self._private = path is None
        self._local = tempfile.TemporaryDirectory(prefix="quarry-") if path is None and not shared else None
        self._path = path or (self._local.name if self._local else f"{shared.rstrip('/')}/quarry-private-{uuid.uuid4().hex}")
        self._store: Store | None = None
        self._views: dict[str, Source] = {}
        self._transaction: Transaction | None = None
        self._marks: list[tuple[str, tuple, bool]] = []
        self._runtime = False
        self._passing: list[str] = []  # views of one statement
        self._own: dict[str, Callable[..., Expr]] = {
            "changes": lambda: literal(self.changes),
            "total_changes": lambda: literal(self.total_changes),
            "last_insert_rowid": lambda: literal(self.last_insert_rowid),
            "likely": lambda x: x,
            "unlikely": lambda x: x,
            "likelihood": lambda x, p: x,
        }
        self.changes = 0
        self.total_changes = 0
        self.last_insert_rowid = 0

    # -- tables -------------------------------------------------------------------------------------------------------

    @property
    def store(self) -> Store:
        if self._store is None:
            if self._local is not None and not re.match(r"local(\[|$)", self.spark.sparkContext.master):
                raise StorageError("a private store needs spark.checkpoint.dir, a folder that all executors share")
            self._store = Store(self.spark, self._path)
        return self._store

    def register(self, table: str, df: DataFrame) -> Engine:
        """Makes a DataFrame a table that can be read by name."""
        df = widened(df)
        self._views[table.lower()] = Source(_view(df), [(f.name, kind_of(f.dataType)) for f in df.schema if f.name != "_rowid_"], "_rowid_" in df.columns)
        return self

    def register_parquet(self, folder: str, *tables: str) -> Engine:
        for t in tables:
            self.register(t, self.spark.read.parquet(f"{folder}/{t}.parquet"))
        return self

    def register_function(self, function_name: str, function: Callable, returns: str = "double") -> Engine:
        """A Python function for SQL text. It should be a pandas_udf; a plain function runs row by row."""
        known = f"quarry_fn_{id(self)}_{function_name}"
        self.spark.udf.register(known, function, *(() if hasattr(function, "returnType") else (returns,)))
        kind = kind_of(function.returnType if hasattr(function, "returnType") else self.spark.createDataFrame([], f"x {returns}").schema[0].dataType)
        self._own[function_name.lower()] = lambda *args: Expr(f"`{known}`({', '.join(a.sql for a in args)})", kind)
        return self

    def _source(self, table: str) -> Source:
        current = self._transaction or (self.store.snapshot() if self._store or not self._private else None)
        if table.lower() in ("sqlite_master", "sqlite_schema") and current is not None:
            df = current.master()
            return Source(self._passing_view(df), [(f.name, kind_of(f.dataType)) for f in df.schema])
        if current is not None and current.has(table):
            df = current.read(table)
            return Source(self._passing_view(df), [(c.name, c.kind) for c in current.table(table).columns], True)
        if table.lower() in self._views:
            return self._views[table.lower()]
        raise NotFound(f"no such table: {table}")

    def _passing_view(self, df: DataFrame) -> str:
        self._passing.append(_view(df))
        return self._passing[-1]

    @contextmanager
    def _statement(self) -> Iterator[None]:
        """Drops the views that lowering a statement made: a DataFrame's plan holds what they stand for."""
        begin = len(self._passing)
        try:
            yield
        finally:
            for view in self._passing[begin:]:
                self.spark.catalog.dropTempView(view)
            del self._passing[begin:]

    def table_names(self) -> list[str]:
        return (self._transaction or self.store.snapshot()).names()

    def schema(self) -> list[str]:
        """The CREATE statements of the store's tables and indexes."""
        return [r["sql"] for r in (self._transaction or self.store.snapshot()).master().collect()]

    # -- reading ------------------------------------------------------------------------------------------------------

    def to_spark_sql(self, sql: str, params: Sequence | dict | None = None) -> str:
        """The Spark SQL that a query becomes."""
        return self._lowered(parse(sql), params)

    def _lowered(self, q: Node, params) -> str:
        if q.kind == "explain":
            q = q.query
        if q.kind != "query":
            raise ParseError("not a query")
        return self._ready(self._lowering(params).query(q)[0])

    def _lowering(self, params) -> Lowering:
        return Lowering(self._source, params if isinstance(params, dict) else list(params or []), self._own, self._fixpoint)

    def _fixpoint(self, first: str, step: Callable[[Source], str], columns: list[tuple[str, str]]) -> Source:
        """All rows that a first query and steps over the rows just found give, each once. The steps run now; each one's new
        rows are written, so no plan grows with the number of steps."""
        folder, names = f"{self._path}/recursion-{uuid.uuid4().hex}", [n for n, _ in columns]
        found: list[DataFrame] = []
        new = self.spark.sql(self._ready(first)).toDF(*names).distinct()
        while True:
            path = f"{folder}/{len(found)}"
            new.write.parquet(path)
            new = self.spark.read.schema(new.schema).parquet(path)
            every = self.spark.read.schema(new.schema).parquet(*[f"{folder}/{i}" for i in range(len(found) + 1)])
            if new.isEmpty():
                return Source(self._passing_view(every), columns)
            found.append(new)
            more = self.spark.sql(self._ready(step(Source(self._passing_view(new), columns)))).toDF(*names)
            new = more.subtract(every)

    def _ready(self, sql: str) -> str:
        """Registers the run-time functions where a text uses them."""
        if not self._runtime and ("quarry_printf(" in sql or "quarry_shift(" in sql):
            runtime.register(self.spark)
            self._runtime = True
        return sql

    def sql(self, sql: str, params: Sequence | dict | None = None) -> DataFrame:
        """A query as a DataFrame (nothing runs yet). PRAGMA gives its rows."""
        q = parse(sql)
        if q.kind == "pragma":
            return self._pragma(q)
        with self._statement():
            df = self.spark.sql(self._lowered(q, params))
        if q.kind == "explain":
            return self.spark.createDataFrame([(line,) for line in df._jdf.queryExecution().toString().splitlines()], "detail string")
        return df

    def query(self, sql: str) -> Query:
        return Query(self, sql)

    def describe(self, sql: str) -> list[tuple[str, str]]:
        """(column, type) of a query, without running it."""
        return [(f.name, f.dataType.simpleString()) for f in self.sql(sql, {}).schema]

    def validate(self, sql: str) -> None:
        """Raises what is wrong with a statement's syntax or names; runs nothing."""
        node = parse(sql)
        if node.kind == "query":
            with self._statement():
                self.spark.sql(self._lowered(node, [None] * 99)).schema  # noqa: B018
        elif node.kind in ("insert", "update", "delete"):
            current = self._transaction or self.store.snapshot()
            table = current.table(node.table)
            for c in node.columns if node.kind == "insert" else [c for c, _ in node.sets] if node.kind == "update" else []:
                table.column(c)

    def fetch_raw(self, sql: str, params: Sequence | dict | None = None) -> tuple[list[str], list[tuple]]:
        df = self.sql(sql, params)
        return df.columns, [tuple(r) for r in df.collect()]

    def query_json(self, sql: str, params: Sequence | dict | None = None) -> list[dict]:
        df = self.sql(sql, params)
        packed = df.select(F.to_json(F.struct(*[F.col(name(c)) for c in df.columns]), {"ignoreNullFields": "false"}).alias("j"))
        return [json.loads(r["j"]) for r in packed.collect()]

    # -- writing ------------------------------------------------------------------------------------------------------

    def execute(self, sql: str, params: Sequence | dict | None = None) -> int:
        """Runs the statements of a text one after the other; returns the rows changed by the last."""
        changed = 0
        for s in statements(sql):
            changed = self._execute(parse(s), s, params)
        return changed

    def _execute(self, n: Node, sql: str, params) -> int:
        if n.kind in ("query", "explain"):
            self.sql(sql, params).collect()
            return 0
        if n.kind == "pragma":
            self._pragma(n)
            return 0
        if n.kind == "transaction":
            return self._transact(n.word, n.mark)
        if self._transaction is not None:
            return self._write(self._transaction, n, sql, params)
        with self.begin() as t:
            return self._write(t, n, sql, params)

    def _write(self, t: Transaction, n: Node, sql: str, params) -> int:
        previous, self._transaction = self._transaction, t  # subqueries of a statement see the transaction's tables
        try:
            with self._statement():
                changed, rowid = t.apply(n, sql, self._lowering(params))
        finally:
            self._transaction = previous
        if n.kind in ("insert", "update", "delete"):
            self.changes = changed
            self.total_changes += changed
            self.last_insert_rowid = rowid if rowid is not None else self.last_insert_rowid
        return changed

    def begin(self) -> Transaction:
        return self.store.begin(self)

    def _transact(self, word: str, mark: str | None = None) -> int:
        """BEGIN, COMMIT, ROLLBACK and savepoints. A savepoint outside a transaction begins one that ends with its release."""
        if word in ("begin", "savepoint"):
            fresh = self._transaction is None
            if fresh:
                self._transaction, self._marks = self.begin(), []
            if word == "savepoint":
                self._marks.append((mark.lower(), self._transaction.state(), fresh))
        elif word in ("release", "rollback to"):
            places = [i for i, (m, _, _) in enumerate(self._marks) if m == mark.lower()] if self._transaction is not None else []
            if not places:
                raise NotFound(f"no such savepoint: {mark}")
            _, state, first = self._marks[places[-1]]
            if word == "rollback to":
                self._transaction.restore(state)
                del self._marks[places[-1] + 1 :]
            else:
                del self._marks[places[-1] :]
                if first:
                    return self._transact("commit")
        elif self._transaction is not None:
            t, self._transaction, self._marks = self._transaction, None, []
            if word == "rollback":
                t.rollback()
            else:
                t.commit()
        return 0

    @property
    def in_transaction(self) -> bool:
        return self._transaction is not None

    def _pragma(self, n: Node) -> DataFrame:
        empty = self.spark.createDataFrame([], "value string")
        if n.name == "table_info":
            rows, kinds = [], "cid bigint, name string, type string, notnull bigint, dflt_value string, pk bigint"
            current = self._transaction or self.store.snapshot()
            if n.value and current.has(n.value):
                table = current.table(n.value)
                rows = [(i, c.name, c.declared, int(c.not_null), c.default_text, int(c.primary)) for i, c in enumerate(table.columns)]
            return self.spark.createDataFrame(rows, kinds)
        if n.name == "foreign_keys":
            return empty if n.value else self.spark.createDataFrame([(0,)], "foreign_keys bigint")
        if n.name == "journal_mode":
            return self.spark.createDataFrame([(n.value or "wal",)], "journal_mode string")
        if n.name == "user_version":
            if n.value is None:
                return self.spark.createDataFrame([((self._transaction or self.store.snapshot()).user_version,)], "user_version bigint")
            if self._transaction is not None:
                self._transaction.user_version = int(n.value)
            else:
                with self.begin() as t:
                    t.user_version = int(n.value)
        return empty

    # -- migrations, upkeep -------------------------------------------------------------------------------------------

    def migrate(self, migrations: Sequence[tuple[int, str, str]]) -> int:
        """Applies (version, description, sql) in order of version, each once; returns how many ran."""
        with self.begin() as t:
            if not t.has("_migrations"):
                self._write(t, parse("CREATE TABLE _migrations (version INTEGER PRIMARY KEY, description TEXT)"), "CREATE TABLE _migrations (version INTEGER PRIMARY KEY, description TEXT)", [])
        done = {r[0] for r in self.sql("SELECT version FROM _migrations").collect()}
        ran = 0
        for version, description, sql in sorted(migrations):
            if version in done:
                continue
            with self.begin() as t:
                for s in statements(sql):
                    self._write(t, parse(s), s, [])
                note = "INSERT INTO _migrations (version, description) VALUES (?, ?)"
                self._write(t, parse(note), note, [version, description])
            ran += 1
        return ran

    def checkpoint(self) -> None:
        """Rewrites each table of many parts as one and removes versions that the current one doesn't need."""
        self.store.checkpoint()

    def close(self) -> None:
        if self._transaction is not None:
            self._transact("rollback")
        if self._local is not None:
            self._local.cleanup()
        elif self._private and self._store is not None:
            self._store.files.delete("")

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def load_migrations(folder: str) -> list[tuple[int, str, str]]:
    """Files named NNN_description.sql."""
    out = []
    for p in sorted(Path(folder).glob("*.sql")):
        if not (m := re.fullmatch(r"(\d+)_(.+)\.sql", p.name)):
            raise Unsupported(f"a migration named {p.name}")
        out.append((int(m[1]), m[2].replace("_", " "), p.read_text()))
    return out
