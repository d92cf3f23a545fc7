"""A DB-API 2.0 connection over an engine: prepare, bind, step through rows, read columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from quarry.errors import ConstraintError, QuarryError
from quarry.session import Engine
from quarry.sql.lexer import statements
from quarry.sql.parser import parse

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"


class Error(Exception):
    pass


class IntegrityError(Error):
    pass


class OperationalError(Error):
    pass


def _raised(e: QuarryError) -> Error:
    return (IntegrityError if isinstance(e, ConstraintError) else OperationalError)(str(e))


class Cursor:
    arraysize = 1

    def __init__(self, connection: Connection):
        self.connection, self.description, self.rowcount, self.lastrowid = connection, None, -1, None
        self._rows: Iterator = iter(())

    def execute(self, sql: str, params: Sequence | dict = ()) -> Cursor:
        engine = self.connection.engine
        try:
            node = parse(sql)
            if node.kind in ("query", "pragma", "explain"):
                df = engine.sql(sql, params)
                self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, None) for f in df.schema]
                self._rows, self.rowcount = df.toLocalIterator(), -1
            else:
                if not engine.in_transaction and self.connection.isolation and node.kind in ("insert", "update", "delete"):
                    engine.execute("BEGIN")
                self.rowcount = engine.execute(sql, params)
                self.description, self._rows, self.lastrowid = None, iter(()), engine.last_insert_rowid
        except QuarryError as e:
            raise _raised(e) from e
        return self

    def executemany(self, sql: str, many: Sequence[Sequence]) -> Cursor:
        total = 0
        for params in many:
            total += self.execute(sql, params).rowcount
        self.rowcount = total
        return self

    def executescript(self, script: str) -> Cursor:
        for s in statements(script):
            self.execute(s)
        return self

    def fetchone(self) -> tuple | None:
        row = next(self._rows, None)
        return None if row is None else tuple(row)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        out = []
        while len(out) < (size or self.arraysize) and (r := self.fetchone()) is not None:
            out.append(r)
        return out

    def fetchall(self) -> list[tuple]:
        return [tuple(r) for r in self._rows]

    def __iter__(self) -> Iterator[tuple]:
        return (tuple(r) for r in self._rows)

    def close(self) -> None:
        self._rows = iter(())


class Connection:
    """isolation: a writing statement opens a transaction that commit() or rollback() ends; without it each commits itself."""

    def __init__(self, engine: Engine, isolation: bool = True):
        self.engine, self.isolation = engine, isolation

    def cursor(self) -> Cursor:
        return Cursor(self)

    def execute(self, sql: str, params: Sequence | dict = ()) -> Cursor:
        return self.cursor().execute(sql, params)

    def commit(self) -> None:
        if self.engine.in_transaction:
            try:
                self.engine.execute("COMMIT")
            except QuarryError as e:
                raise _raised(e) from e

    def rollback(self) -> None:
        if self.engine.in_transaction:
            self.engine.execute("ROLLBACK")

    def exec(self, sql: str, callback: Callable[[list[str], list[str | None]], Any]) -> None:
        """Calls callback(names, texts) for each row of each query of sql; a true result stops."""
        from quarry.sources.render import cell

        for s in statements(sql):
            c = self.execute(s)
            names = [d[0] for d in c.description or []]
            for r in c:
                if callback(names, [None if v is None else cell(v) for v in r]):
                    raise OperationalError("callback requested query abort")

    def close(self) -> None:
        self.rollback()


def connect(engine: Engine, isolation: bool = True) -> Connection:
    return Connection(engine, isolation)
