"""Versioned tables: immutable Parquet parts and one manifest a commit.

manifest-N.json names every table, its columns and its parts. A commit writes new parts first and the manifest last, under a
name that only one writer can create, so readers see whole commits, a writer that lost the race fails, and parts of a
crashed writer are never seen. INSERT adds a part; UPDATE and DELETE write the table anew; ADD COLUMN changes the manifest
alone. A DataFrame read from a snapshot names fixed files and stays valid while the store moves on.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarry.errors import ConstraintError, NotFound, SchemaError, StorageError, Unsupported
from quarry.sql.ast import Node
from quarry.sql.lower import Lowering, Relation, Scope
from quarry.sql.parser import parse_expression
from quarry.store.files import Files
from quarry.values import SPARK_TYPE, SQL_TYPE, affinity, as_kind, literal, name, truth

ROWID = "_rowid_"


@dataclass
class Column:
    name: str
    declared: str
    kind: str
    not_null: bool = False
    primary: bool = False
    unique: bool = False
    default: object = None  # a value, or {"now": what}
    default_text: str | None = None


@dataclass
class Part:
    path: str
    columns: list[str]  # what its files hold; later columns have their defaults


@dataclass
class Table:
    name: str
    sql: str
    columns: list[Column]
    parts: list[Part] = field(default_factory=list)
    keys: list[list[str]] = field(default_factory=list)
    last_rowid: int = 0
    checks: list[str] = field(default_factory=list)  # texts of CHECK conditions

    def column(self, wanted: str) -> Column:
        for c in self.columns:
            if c.name.lower() == wanted.lower():
                return c
        raise NotFound(f"table {self.name} has no column named {wanted}")

    @property
    def alias(self) -> str | None:
        """The column that is the rowid: a single INTEGER PRIMARY KEY."""
        found = [c.name for c in self.columns if c.primary and c.kind == "int"]
        return found[0] if len(found) == 1 and not any(len(k) > 1 and k[0] == found[0] for k in self.keys) else None

    def copy(self) -> Table:
        return Table(self.name, self.sql, list(self.columns), list(self.parts), [list(k) for k in self.keys], self.last_rowid, list(self.checks))


class Snapshot:
    """The tables of one commit."""

    def __init__(self, store: Store, version: int, tables: dict[str, Table], indexes: dict[str, dict], user_version: int):
        self.store, self.version, self.tables, self.indexes, self.user_version = store, version, tables, indexes, user_version

    def has(self, table: str) -> bool:
        return table.lower() in self.tables

    def table(self, table: str) -> Table:
        if not self.has(table):
            raise NotFound(f"no such table: {table}")
        return self.tables[table.lower()]

    def names(self) -> list[str]:
        return sorted(t.name for t in self.tables.values())

    def master(self) -> DataFrame:
        rows = [("table", t.name, t.name, t.sql) for t in self.tables.values()] + [("index", i["name"], i["table"], i["sql"]) for i in self.indexes.values()]
        return self.store.spark.createDataFrame(rows, "type string, name string, tbl_name string, sql string")

    def read(self, table: str, parts: list[Part] | None = None, located: bool = False) -> DataFrame:
        """_rowid_ and the columns of a table or of some of its parts; with located, also _part, the folder a row lies in."""
        t, spark = self.table(table), self.store.spark
        schema = StructType([StructField(ROWID, LongType()), *(StructField(c.name, SPARK_TYPE[c.kind]) for c in t.columns)])
        by_columns: dict[tuple[str, ...], list[str]] = {}
        place = [F.regexp_extract(F.input_file_name(), "data/[0-9a-f]{32}", 0).alias("_part")] if located else []
        for p in t.parts if parts is None else parts:
            by_columns.setdefault(tuple(p.columns), []).append(self.store.files.full(p.path))
        frames = []
        for held, paths in by_columns.items():
            df = spark.read.schema(StructType([f for f in schema if f.name == ROWID or f.name in held])).parquet(*paths)
            frames.append(df.select(ROWID, *[F.col(name(c.name)) if c.name in held else F.lit(_constant(c)).cast(SPARK_TYPE[c.kind]).alias(c.name) for c in t.columns], *place))
        if not frames:
            return spark.createDataFrame([], StructType([*schema, *([StructField("_part", StringType())] if located else [])]))
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out


def _constant(c: Column):
    return None if isinstance(c.default, dict) else bytes.fromhex(c.default[4:]) if isinstance(c.default, str) and c.default.startswith("hex:") and c.kind == "blob" else c.default


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def _versions(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self.files.names() if n.startswith("manifest-") and n.endswith(".json"))

    def snapshot(self) -> Snapshot:
        versions = self._versions()
        if not versions:
            return Snapshot(self, 0, {}, {}, 0)
        raw = json.loads(self.files.read(f"manifest-{versions[-1]}.json"))
        tables = {}
        for k, t in raw["tables"].items():
            tables[k] = Table(t["name"], t["sql"], [Column(**c) for c in t["columns"]], [Part(**p) for p in t["parts"]], t["keys"], t["last_rowid"], t.get("checks", []))
        return Snapshot(self, versions[-1], tables, raw["indexes"], raw["user_version"])

    def begin(self, engine=None) -> Transaction:
        s = self.snapshot()
        return Transaction(self, s.version, {k: t.copy() for k, t in s.tables.items()}, dict(s.indexes), s.user_version)

    def checkpoint(self) -> None:
        with self.begin() as t:
            for table in t.tables.values():
                if len(table.parts) > 1:
                    t.rewrite(table, t.read(table.name))
        current = self.snapshot()
        needed = {p.path for t in current.tables.values() for p in t.parts}
        for v in self._versions()[:-1]:
            self.files.delete(f"manifest-{v}.json")
            self.files.delete(f"manifest-{v}.json.lock")
        for folder in self.files.names("data"):
            if f"data/{folder}" not in needed:
                self.files.delete(f"data/{folder}")


class Transaction(Snapshot):
    """Changes on top of a commit: reads see them, others don't until commit. Use as a context: an error rolls back."""

    def __init__(self, store: Store, version: int, tables: dict[str, Table], indexes: dict[str, dict], user_version: int):
        super().__init__(store, version, tables, indexes, user_version)
        self._open, self._written, self._drafts = True, [], []

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self._open:
            self.rollback() if kind else self.commit()

    def commit(self) -> int:
        self._close()
        raw = {"tables": {k: asdict(t) for k, t in self.tables.items()}, "indexes": self.indexes, "user_version": self.user_version}
        if not self.store.files.create(f"manifest-{self.version + 1}.json", json.dumps(raw)):
            self._discard()
            raise StorageError("another writer has committed since this transaction began")
        for p in self._drafts:
            self.store.files.delete(p)
        return self.version + 1

    def state(self) -> tuple:
        """What a savepoint keeps: data files are never changed, so the lists of them are enough."""
        return {k: t.copy() for k, t in self.tables.items()}, dict(self.indexes), self.user_version

    def restore(self, state: tuple) -> None:
        tables, indexes, self.user_version = state
        self.tables, self.indexes = {k: t.copy() for k, t in tables.items()}, dict(indexes)

    def rollback(self) -> None:
        self._close()
        self._discard()

    def _close(self) -> None:
        if not self._open:
            raise StorageError("the transaction is over")
        self._open = False

    def _discard(self) -> None:
        for p in [*self._written, *self._drafts]:
            self.store.files.delete(p)

    # -- statements ---------------------------------------------------------------------------------------------------

    def apply(self, n: Node, sql: str, low: Lowering) -> tuple[int, int | None]:
        """Runs a writing statement; returns rows changed and the last rowid inserted."""
        if not self._open:
            raise StorageError("the transaction is over")
        make = getattr(self, f"_{n.kind}", None)
        if make is None:
            raise Unsupported(f"{n.kind} in a transaction")
        return make(n, sql, low)

    def _create_table(self, n: Node, sql: str, low: Lowering):
        if self.has(n.name):
            if n.quiet:
                return 0, None
            raise SchemaError(f"table {n.name} already exists")
        columns = [self._column(c, low) for c in n.columns]
        if len({c.name.lower() for c in columns}) != len(columns):
            raise SchemaError("duplicate column name")
        keys = []
        for kind, names in n.keys:
            table = Table(n.name, sql, columns)
            found = [table.column(x) for x in names]
            if len(found) == 1:
                setattr(found[0], "primary" if kind == "primary" else "unique", True)
            else:
                keys.append([c.name for c in found])
        for text in n.checks:  # names must be known now, not at the first insert
            low.expr(parse_expression(text), _scope(Table(n.name, sql, columns)))
        self.tables[n.name.lower()] = Table(n.name, sql, columns, [], keys, 0, n.checks)
        return 0, None

    @staticmethod
    def _column(c: Node, low: Lowering) -> Column:
        default = None
        if c.default is not None:
            if c.default.kind == "now":
                default = {"now": c.default.what}
            else:
                e = low.expr(c.default, Scope([]))
                default = f"hex:{e.value.hex()}" if isinstance(e.value, bytes) else e.value if e.literal else None
        return Column(c.name, c.type, affinity(c.type), c.not_null, c.primary, c.unique, default, c.default_text)

    def _create_index(self, n: Node, sql: str, low: Lowering):
        if n.name.lower() in self.indexes:
            if n.quiet:
                return 0, None
            raise SchemaError(f"index {n.name} already exists")
        table = self.table(n.table)
        for c in n.columns:
            table.column(c)
        self.indexes[n.name.lower()] = {"name": n.name, "table": table.name, "columns": n.columns, "unique": n.unique, "sql": sql}
        return 0, None

    def _drop_table(self, n: Node, sql: str, low: Lowering):
        if not self.has(n.name):
            if n.quiet:
                return 0, None
            raise NotFound(f"no such table: {n.name}")
        del self.tables[n.name.lower()]
        self.indexes = {k: i for k, i in self.indexes.items() if i["table"].lower() != n.name.lower()}
        return 0, None

    def _add_column(self, n: Node, sql: str, low: Lowering):
        table = self.table(n.table)
        if any(c.name.lower() == n.column.name.lower() for c in table.columns):
            if n.quiet:
                return 0, None
            raise SchemaError(f"duplicate column name: {n.column.name}")
        c = self._column(n.column, low)
        if c.primary or c.unique:
            raise SchemaError(f"cannot add a {'PRIMARY KEY' if c.primary else 'UNIQUE'} column")
        if isinstance(c.default, dict):
            raise SchemaError("cannot add a column with a default that isn't constant")
        if c.not_null and c.default is None:
            raise SchemaError("cannot add a NOT NULL column with default value NULL")
        table.columns.append(c)
        table.checks += n.checks
        if n.checks and table.parts:
            self._check_rules(table, self.read(table.name), low)
        table.sql = f"{table.sql.rstrip().removesuffix(')')}, {c.name} {c.declared}{f' DEFAULT {c.default_text}' if c.default_text else ''})"
        return 0, None

    def _insert(self, n: Node, sql: str, low: Lowering):
        table = self.table(n.table)
        named = [table.column(c) for c in n.columns] if n.columns else [] if n.rows == [[]] else table.columns
        if n.query is not None:
            text, columns, _ = low.query(n.query)
            if len(columns) != len(named):
                raise SchemaError(f"table {table.name} has {len(named)} columns but {len(columns)} values were supplied")
            raw = self.store.spark.sql(text).toDF(*[f"c{i}" for i in range(len(columns))]).withColumn("_seq", F.monotonically_increasing_id())
            kinds = [k for _, k in columns]
            given = {c.name: F.expr(_converted(f"c{i}", kinds[i], c)) for i, c in enumerate(named)}
        else:
            if any(len(r) != len(named) for r in n.rows):
                raise SchemaError(f"{len(named)} values are needed for {table.name}")
            raw, given = self._rows(n.rows, named, low)
        new = raw.select("_seq", *[(given[c.name] if c.name in given else _default(c)).cast(SPARK_TYPE[c.kind]).alias(c.name) for c in table.columns])
        return self._append(table, new, n.conflict, low)

    def _rows(self, rows: list[list[Node]], named: list[Column], low: Lowering):
        """VALUES as one inline relation of the rows of literals in their columns' kinds, and a SELECT for each other row."""
        inline, other = [], []
        for i, r in enumerate(rows):
            cells = [low.expr(e, Scope([])) for e in r]
            converted = [f"{i}L", *(f"CAST({_converted(e.sql, e.kind, c)} AS {SQL_TYPE[c.kind]})" for e, c in zip(cells, named, strict=True))]
            plain = all(e.literal and (e.kind in (c.kind, "null") or (e.kind, c.kind) == ("int", "real")) for e, c in zip(cells, named, strict=True))
            (inline if plain else other).append(", ".join(converted))
        names = ", ".join(["_seq", *(name(f"c_{c.name}") for c in named)])
        parts = [f"SELECT * FROM VALUES {', '.join(f'({line})' for line in inline)} AS v({names})"] if inline else []
        parts += [f"SELECT * FROM (SELECT {line}) AS v({names})" for line in other]
        return self.store.spark.sql(" UNION ALL ".join(parts)), {c.name: F.col(name(f"c_{c.name}")) for c in named}

    def _append(self, table: Table, new: DataFrame, conflict: str, low: Lowering):
        """Numbers new rows, checks them, and adds them as one part.

        conflict says what becomes of a row whose key is taken: abort (all fails), replace (the old row goes; of new ones
        the last stays), ignore (the row is left out; of new ones the first stays, and rows with a NULL where there must
        be none are left out too).
        """
        spark, alias = self.store.spark, table.alias
        path = self._new_path()
        draft = f"{path}-draft"
        last = table.last_rowid
        self._drafts.append(draft)
        new.write.parquet(self.store.files.full(draft))
        written = spark.read.schema(new.schema).parquet(self.store.files.full(draft))
        # _seq is a partition's number and a row's place in it, so rows are numbered by their partition's offset: one count
        # for each partition of the load, and no sort.
        runs, before = [], last
        for r in written.groupBy(F.shiftright("_seq", 33).alias("p")).agg(F.count("*").alias("n"), F.min("_seq").alias("first")).orderBy("p").collect():
            runs.append((r["p"], r["first"], before))
            before += r["n"]
        offsets = F.broadcast(spark.createDataFrame(runs, "_p bigint, _first bigint, _before bigint"))
        numbered = written.join(offsets, F.shiftright("_seq", 33) == F.col("_p")).withColumn("_next", F.col("_before") + F.col("_seq") - F.col("_first") + 1)
        written = numbered.withColumn(ROWID, F.coalesce(F.col(name(alias)), F.col("_next")) if alias else F.col("_next")).drop("_p", "_first", "_before", "_next")
        if alias:
            written = written.withColumn(alias, F.col(ROWID))
        if conflict == "ignore":
            for c in table.columns:
                if c.not_null:
                    written = written.where(F.col(name(c.name)).isNotNull())
        self._check_nulls(table, written)
        self._check_rules(table, written.drop("_seq"), low)
        old, replace = self.read(table.name), conflict == "replace"
        if conflict == "ignore":
            for key in self._keys(table):
                columns = [name(k) for k in key]
                if table.parts:
                    written = written.join(old.select(*columns).dropna(), key, "left_anti").select(*written.columns)
            for key in self._keys(table):
                first = Window.partitionBy(*[name(k) for k in key]).orderBy("_seq")
                none = F.greatest(*[F.col(name(k)).isNull().cast("int") for k in key], F.lit(0)) == 1
                written = written.withColumn("_r", F.row_number().over(first)).where((F.col("_r") == 1) | none).drop("_r")
        if replace:
            for key in self._keys(table):
                # Of new rows with one key the last stays; old rows with a new row's key go.
                latest = Window.partitionBy(*[name(k) for k in key]).orderBy(F.desc("_seq"))
                none = F.greatest(*[F.col(name(k)).isNull().cast("int") for k in key], F.lit(0)) == 1
                written = written.withColumn("_r", F.row_number().over(latest)).where((F.col("_r") == 1) | none).drop("_r")
        keys = self._keys(table)
        body = written.drop("_seq")
        count = body.count() if not replace else written.count()
        if replace and keys and table.parts:
            for key in keys:
                old = old.join(body.select(*[name(k) for k in key]).dropna(), key, "left_anti").select(*old.columns)
            table.last_rowid = max(last, body.agg(F.max(ROWID)).first()[0] or 0)
            self.rewrite(table, old.unionByName(body))
        else:
            if keys and conflict == "abort":
                self._check_unique(table, old.unionByName(body) if table.parts else body, body)
            self._put(table, body, path)
            top = body.agg(F.max(ROWID)).first()[0]
            table.last_rowid = max(last, top or 0)
        final = written.orderBy(F.desc("_seq")).limit(1).select(ROWID).collect()
        return count, final[0][0] if final else None

    def _put(self, table: Table, body: DataFrame, path: str) -> None:
        body.write.parquet(self.store.files.full(path))
        self._written.append(path)
        table.parts.append(Part(path, [c.name for c in table.columns]))

    def rewrite(self, table: Table, df: DataFrame) -> None:
        path = self._new_path()
        df.write.parquet(self.store.files.full(path))
        self._written.append(path)
        table.parts = [Part(path, [c.name for c in table.columns])]

    @staticmethod
    def _new_path() -> str:
        return f"data/{uuid.uuid4().hex}"

    def _hits(self, table: Table, where: str) -> dict[str, int]:
        """Parts that hold rows of a condition, with their numbers: a pass over the columns it names, one row a part to the driver."""
        df = self.read(table.name, located=True)
        with _view(df) as view:
            rows = self.store.spark.sql(f"SELECT _part, count(*) AS n FROM {view} AS {name(table.name)} WHERE {where} GROUP BY _part").collect()
        return {r["_part"]: r["n"] for r in rows}

    def _update(self, n: Node, sql: str, low: Lowering):
        table = self.table(n.table)
        scope = _scope(table)
        where = truth(low.expr(n.where, scope)) if n.where is not None else "true"
        hits = self._hits(table, where)
        if not hits:
            return 0, None
        touched_parts, others = [p for p in table.parts if p.path in hits], [p for p in table.parts if p.path not in hits]
        sets = {table.column(c).name: (low.expr(e, scope), table.column(c)) for c, e in n.sets}
        # The condition is computed once as a column; assignments all see the row as it was.
        view = f"quarry_dml_{uuid.uuid4().hex}"
        self.read(table.name, touched_parts).createOrReplaceTempView(view)
        base = f"SELECT *, coalesce({where}, false) AS _hit FROM {view} AS {name(table.name)}"
        hit = f"{name(table.name)}._hit"
        items = [f"CASE WHEN {hit} THEN {_converted(sets[c.name][0].sql, sets[c.name][0].kind, c)} ELSE {name(table.name)}.{name(c.name)} END AS {name(c.name)}" if c.name in sets else f"{name(table.name)}.{name(c.name)}" for c in table.columns]
        rowid = f"{name(table.name)}.`{ROWID}`"
        if table.alias in sets:
            rowid = f"CASE WHEN {hit} THEN {_converted(sets[table.alias][0].sql, sets[table.alias][0].kind, table.column(table.alias))} ELSE {rowid} END"
        df = self.store.spark.sql(f"SELECT {rowid} AS `{ROWID}`, {', '.join(items)}, _hit FROM ({base}) AS {name(table.name)}")
        path = self._new_path()
        df.write.parquet(self.store.files.full(path))
        self.store.spark.catalog.dropTempView(view)
        self._written.append(path)
        new = self.store.spark.read.schema(df.schema).parquet(self.store.files.full(path))
        count = sum(hits.values())
        self._check_nulls(table, new.where("_hit"))
        self._check_rules(table, new.where("_hit").drop("_hit"), low)
        touched = [k for k in self._keys(table) if any(c in sets for c in k)]
        every = new.drop("_hit").unionByName(self.read(table.name, others)) if others else new
        for key in touched:
            self._check_key(table, every, key)
        table.parts = [*others, Part(path, [c.name for c in table.columns])]
        if table.alias in sets:
            table.last_rowid = max(table.last_rowid, new.agg(F.max(ROWID)).first()[0] or 0)
        return count, None

    def _delete(self, n: Node, sql: str, low: Lowering):
        table = self.table(n.table)
        where = truth(low.expr(n.where, _scope(table))) if n.where is not None else "true"
        hits = self._hits(table, where)
        if not hits:
            return 0, None
        others = [p for p in table.parts if p.path not in hits]
        if n.where is not None:
            with _view(self.read(table.name, [p for p in table.parts if p.path in hits])) as view:
                path = self._new_path()
                self.store.spark.sql(f"SELECT * FROM {view} AS {name(table.name)} WHERE NOT coalesce({where}, false)").write.parquet(self.store.files.full(path))
            self._written.append(path)
            others.append(Part(path, [c.name for c in table.columns]))
        table.parts = others
        top = self.read(table.name).agg(F.max(ROWID)).first()[0]
        table.last_rowid = top or 0
        return sum(hits.values()), None

    # -- constraints --------------------------------------------------------------------------------------------------

    @staticmethod
    def _keys(table: Table) -> list[list[str]]:
        return [[c.name] for c in table.columns if c.unique or c.primary] + table.keys

    @staticmethod
    def _check_nulls(table: Table, rows: DataFrame) -> None:
        needed = [c.name for c in table.columns if c.not_null]
        if needed:
            found = rows.agg(*[F.count_if(F.col(name(c)).isNull()).alias(c) for c in needed]).first()
            for c in needed:
                if found[c]:
                    raise ConstraintError(f"NOT NULL constraint failed: {table.name}.{c}")

    def _check_rules(self, table: Table, rows: DataFrame, low: Lowering) -> None:
        """CHECK conditions: a row for which one is false is refused; NULL passes."""
        if not table.checks:
            return
        scope = _scope(table)
        with _view(rows) as view:
            tests = ", ".join(f"count_if(NOT {truth(low.expr(parse_expression(text), scope))})" for text in table.checks)
            found = self.store.spark.sql(f"SELECT {tests} FROM {view} AS {name(table.name)}").first()
        for text, bad in zip(table.checks, found, strict=True):
            if bad:
                raise ConstraintError(f"CHECK constraint failed: {text}")

    def _check_unique(self, table: Table, rows: DataFrame, new: DataFrame) -> None:
        for key in self._keys(table):
            wanted = new.select(*[name(k) for k in key]).dropna().distinct()
            self._check_key(table, rows.join(wanted, key, "left_semi"), key)

    @staticmethod
    def _check_key(table: Table, rows: DataFrame, key: list[str]) -> None:
        if rows.dropna(subset=key).groupBy(*[name(k) for k in key]).count().where("count > 1").limit(1).count():
            raise ConstraintError(f"UNIQUE constraint failed: {', '.join(f'{table.name}.{k}' for k in key)}")


def _scope(table: Table) -> Scope:
    return Scope([Relation(table.name, [(c.name, c.kind) for c in table.columns], True)])


@contextmanager
def _view(df: DataFrame) -> Iterator[str]:
    """A temporary view that is dropped when the statement is over."""
    view = f"quarry_dml_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    try:
        yield view
    finally:
        df.sparkSession.catalog.dropTempView(view)


def _converted(sql: str, kind: str, c: Column) -> str:
    """A value on its way into a column: what can't become the column's kind is an error, not another kind."""
    from quarry.values import Expr

    if c.kind == "int" and kind == "real":
        return f"CASE WHEN {sql} = CAST({sql} AS BIGINT) THEN CAST({sql} AS BIGINT) ELSE raise_error('a fraction for column {c.name}') END"
    if kind == c.kind:
        return sql
    if kind == "null":
        return f"CAST(NULL AS {SQL_TYPE[c.kind]})"
    if c.kind == "bool":
        return truth(Expr(sql, kind))
    if c.kind == "blob":
        return f"encode({as_kind(Expr(sql, kind), 'text')}, 'UTF-8')"
    return as_kind(Expr(sql, kind), c.kind)


def _default(c: Column) -> SparkColumn:
    if isinstance(c.default, dict):
        form = {"current_date": "yyyy-MM-dd", "current_time": "HH:mm:ss", "current_timestamp": "yyyy-MM-dd HH:mm:ss"}[c.default["now"]]
        return F.date_format(F.current_timestamp(), form)
    value = _constant(c)
    return F.expr(literal(value).sql) if value is not None else F.lit(None)
