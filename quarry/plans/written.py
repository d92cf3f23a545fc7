"""Queries that write first: statements on small tables of a private store, then the state they leave."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import ConstraintError
from quarry.session import Engine

_KEPT: list[Engine] = []  # private stores live as long as the DataFrames that read them may


def _with_nation(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark).register_parquet(sf_dir, "nation", "region")
    _KEPT.append(engine)
    engine.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, region INTEGER DEFAULT 7); INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation")
    return engine


def _state(statements: str, sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _with_nation(spark, sf_dir)
    engine.execute(statements)
    return engine.sql(sql)


_T = "SELECT id, name, region FROM t"
_N = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation"

_CASES: dict[str, tuple[str, str, str]] = {
    "dml_insert": ("INSERT INTO t (id, name, region) VALUES (100, 'X', 1), (101, 'Y', 2)", _T, f"{_N} UNION ALL SELECT * FROM (VALUES (100, 'X', 1), (101, 'Y', 2))"),
    "dml_insert_default": ("INSERT INTO t (name) VALUES ('next')", _T, f"{_N} UNION ALL SELECT 25, 'next', 7"),
    "dml_insert_select": ("INSERT INTO t SELECT id + 1000, lower(name), NULL FROM t WHERE region = 1", _T, f"{_N} UNION ALL SELECT n_nationkey + 1000, lower(n_name), NULL FROM nation WHERE n_regionkey = 1"),
    "dml_replace": ("INSERT OR REPLACE INTO t VALUES (3, 'three', 33), (200, 'new', 0)", _T, f"{_N} WHERE n_nationkey <> 3 UNION ALL SELECT * FROM (VALUES (3, 'three', 33), (200, 'new', 0))"),
    "dml_update": ("UPDATE t SET region = region * 10, name = name || '!' WHERE region >= 3", _T, "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_regionkey >= 3 THEN n_name || '!' ELSE n_name END AS name, CAST(CASE WHEN n_regionkey >= 3 THEN n_regionkey * 10 ELSE n_regionkey END AS BIGINT) AS region FROM nation"),
    "dml_delete": ("DELETE FROM t WHERE region IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'a%')", _T, f"{_N} WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name ILIKE 'a%')"),
    "ddl_add_column": ("ALTER TABLE t ADD COLUMN note TEXT DEFAULT 'none'; INSERT INTO t VALUES (500, 'Z', 1, 'set')", "SELECT id, note FROM t", "SELECT CAST(n_nationkey AS BIGINT) AS id, 'none' AS note FROM nation UNION ALL SELECT 500, 'set'"),
    "ddl_index": ("CREATE INDEX by_region ON t (region)", "SELECT type, name, tbl_name FROM sqlite_master WHERE type = 'index'", "SELECT 'index' AS type, 'by_region' AS name, 't' AS tbl_name"),
    "tx_rollback": ("BEGIN; DELETE FROM t; ROLLBACK", _T, _N),
    "tx_commit": ("BEGIN; DELETE FROM t WHERE id > 2; INSERT INTO t VALUES (9, 'nine', 9); COMMIT", _T, f"{_N} WHERE n_nationkey <= 2 UNION ALL SELECT 9, 'nine', 9"),
    "tx_savepoint": ("BEGIN; DELETE FROM t WHERE id > 10; SAVEPOINT a; DELETE FROM t; ROLLBACK TO a; INSERT INTO t VALUES (90, 'kept', 0); RELEASE a; COMMIT", _T, f"{_N} WHERE n_nationkey <= 10 UNION ALL SELECT 90, 'kept', 0"),
    "dml_ignore": ("INSERT OR IGNORE INTO t VALUES (3, 'taken', 0), (300, 'new', 1), (300, 'second', 2), (301, NULL, 3)", _T, f"{_N} UNION ALL SELECT 300, 'new', 1"),
    "dml_no_hits": ("UPDATE t SET region = 0 WHERE id > 1000; DELETE FROM t WHERE id > 1000", _T, _N),
    "dml_parts": ("INSERT INTO t VALUES (600, 'a', 1); INSERT INTO t VALUES (700, 'b', 2); UPDATE t SET region = 9 WHERE id = 600; DELETE FROM t WHERE id = 700", _T, f"{_N} UNION ALL SELECT 600, 'a', 9"),
    "dml_changes": ("UPDATE t SET region = 0 WHERE region > 2; INSERT INTO t VALUES (77, 'x', 1)", "SELECT changes() AS c, total_changes() AS total, last_insert_rowid() AS r", "SELECT CAST(1 AS BIGINT) AS c, (SELECT count(*) FROM nation) + (SELECT count(*) FROM nation WHERE n_regionkey > 2) + 1 AS total, CAST(77 AS BIGINT) AS r"),
    "ddl_drop": ("DROP TABLE t; DROP TABLE IF EXISTS t", "SELECT count(*) AS n FROM sqlite_master", "SELECT CAST(0 AS BIGINT) AS n"),
    "pragma_user_version": ("PRAGMA user_version = 7", "PRAGMA user_version", "SELECT CAST(7 AS BIGINT) AS user_version"),
    "pragma_foreign_keys": ("PRAGMA foreign_keys = ON", "PRAGMA foreign_keys", "SELECT CAST(0 AS BIGINT) AS foreign_keys"),
    "pragma_journal_mode": ("PRAGMA journal_mode", "PRAGMA journal_mode", "SELECT 'wal' AS journal_mode"),
    "rowid": ("DELETE FROM t WHERE id < 20", "SELECT rowid AS r, name FROM t WHERE rowid > 21", "SELECT CAST(n_nationkey AS BIGINT) AS r, n_name AS name FROM nation WHERE n_nationkey > 21"),
}


def _table_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_nation(spark, sf_dir).sql("PRAGMA table_info(t)")


#: Statements that a constraint refuses after others that it doesn't: the state they leave, and what was raised.
_REFUSED: dict[str, tuple[str, str, str]] = {
    "refused_not_null": ("", "INSERT INTO t VALUES (300, 'x', 1), (301, NULL, 1)", "NOT NULL constraint failed: t.name"),
    "refused_key": ("", "INSERT INTO t VALUES (300, 'x', 1), (3, 'taken', 1)", "UNIQUE constraint failed: t.id"),
    "refused_key_update": ("", "UPDATE t SET id = 5 WHERE id = 4", "UNIQUE constraint failed: t.id"),
    "refused_unique": ("CREATE TABLE u (e TEXT UNIQUE); INSERT INTO u SELECT name FROM t", "UPDATE u SET e = 'same'", "UNIQUE constraint failed: u.e"),
    "refused_check": ("CREATE TABLE c (x INTEGER CHECK (x >= 0), y TEXT); INSERT INTO c SELECT id, name FROM t", "UPDATE c SET x = x - 1", "CHECK constraint failed: x >= 0"),
}


def _refused(before: str, statement: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _with_nation(spark, sf_dir)
    engine.execute(before)
    try:
        engine.execute(statement)
        raised = "nothing"
    except ConstraintError as e:
        raised = str(e)
    return engine.sql(_T).withColumn("raised", F.lit(raised))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DataFrame keeps the versions of its call."""
    engine = _with_nation(spark, sf_dir)
    before = engine.sql(_T)
    engine.execute("DELETE FROM t WHERE id > 3; UPDATE t SET name = 'gone'")
    return before


def _reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of several parts after a checkpoint, read by another engine over the same folder."""
    engine = _with_nation(spark, sf_dir)
    engine.execute("INSERT INTO t VALUES (800, 'part', 1); DELETE FROM t WHERE id = 1")
    engine.checkpoint()
    return Engine(spark, engine._path).sql(_T)


def _migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _with_nation(spark, sf_dir)
    steps = [(2, "fill", "INSERT INTO m SELECT id, name FROM t"), (1, "make", "CREATE TABLE m (k INTEGER, v TEXT)")]
    engine.migrate(steps)
    engine.migrate(steps)  # each runs once
    return engine.sql("SELECT k, v, (SELECT count(*) FROM _migrations) AS ran FROM m")


_MADE = {"pragma_table_info": _table_info, "tx_snapshot": _snapshot, "store_reopened": _reopened, "migrations": _migrated}
_MADE_SQL = {
    "tx_snapshot": _N,
    "store_reopened": f"{_N} WHERE n_nationkey <> 1 UNION ALL SELECT 800, 'part', 1",
    "migrations": "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS v, CAST(2 AS BIGINT) AS ran FROM nation",
}
WRITTEN: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: partial(_state, s, q) for k, (s, q, _) in _CASES.items()} | {k: partial(_refused, b, s) for k, (b, s, _) in _REFUSED.items()} | _MADE
WRITTEN_SQL: dict[str, str] = {k: o for k, (_, _, o) in _CASES.items()} | {k: f"{_N.replace(' FROM nation', '')}, '{raised}' AS raised FROM nation" for k, (_, _, raised) in _REFUSED.items()} | _MADE_SQL | {
    "pragma_table_info": "SELECT CAST(cid AS BIGINT) AS cid, name, type, CAST(nn AS BIGINT) AS notnull, dflt_value, CAST(pk AS BIGINT) AS pk FROM (VALUES (0, 'id', 'INTEGER', 0, NULL, 1), (1, 'name', 'TEXT', 1, NULL, 0), (2, 'region', 'INTEGER', 0, '7', 0)) AS v(cid, name, type, nn, dflt_value, pk)"
}
