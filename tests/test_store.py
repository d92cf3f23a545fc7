"""Tables that are written: statements, constraints, transactions, versions."""

from dataclasses import dataclass, field

import pytest

from quarry.cursor import IntegrityError, connect
from quarry.errors import ConstraintError, NotFound, SchemaError, StorageError, TypeMismatch
from quarry.session import Engine, load_migrations


def rows(engine, sql, *params):
    return [tuple(r) for r in engine.sql(sql, params).collect()]


def test_crud(engine):
    engine.execute("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT, age INTEGER)")
    assert engine.execute("INSERT INTO users (name, age) VALUES ('Ann', 30), ('Bob', 25)") == 2
    assert engine.last_insert_rowid == 2
    assert rows(engine, "SELECT id, name, age FROM users ORDER BY id") == [(1, "Ann", 30), (2, "Bob", 25)]
    assert engine.execute("UPDATE users SET age = age + 1, name = name || age WHERE age < 30") == 1
    assert rows(engine, "SELECT name, age FROM users WHERE id = 2") == [("Bob25", 26)]
    assert engine.execute("DELETE FROM users WHERE age > ?", [29]) == 1
    assert rows(engine, "SELECT count(*), rowid FROM users GROUP BY rowid") == [(1, 2)]
    engine.execute("INSERT INTO users VALUES (10, 'Cy', 1); INSERT INTO users (name) VALUES ('Di')")
    assert rows(engine, "SELECT id FROM users ORDER BY id") == [(2,), (10,), (11,)]
    assert engine.execute("DELETE FROM users") == 3 and rows(engine, "SELECT count(*) FROM users") == [(0,)]


def test_constraints(engine):
    engine.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, e TEXT UNIQUE, n INTEGER NOT NULL DEFAULT 5, UNIQUE (e, n))")
    engine.execute("INSERT INTO t (e) VALUES ('a'), ('b'), (NULL), (NULL)")
    for sql in ("INSERT INTO t VALUES (1, 'z', 1)", "INSERT INTO t (e) VALUES ('a')", "INSERT INTO t (e, n) VALUES ('q', NULL)", "UPDATE t SET e = 'a' WHERE id = 2", "UPDATE t SET id = 1 WHERE id = 2", "INSERT INTO t (e) VALUES ('x'), ('x')"):
        with pytest.raises(ConstraintError):
            engine.execute(sql)
    assert rows(engine, "SELECT id, e, n FROM t ORDER BY id") == [(1, "a", 5), (2, "b", 5), (3, None, 5), (4, None, 5)]
    assert engine.execute("INSERT OR REPLACE INTO t VALUES (1, 'b', 9)") == 1  # replaces rows 1 (id) and 2 (e)
    assert rows(engine, "SELECT id, e, n FROM t ORDER BY id") == [(1, "b", 9), (3, None, 5), (4, None, 5)]


def test_types_and_defaults(engine):
    engine.execute("CREATE TABLE t (a INTEGER, b TEXT DEFAULT 'x', c REAL DEFAULT 1.5, d BLOB, f BOOLEAN, w TEXT DEFAULT CURRENT_DATE)")
    engine.execute("INSERT INTO t (a, d, f) VALUES (2.0, x'00ff', 1)")
    got = engine.sql("SELECT a, b, c, d, f, length(w) FROM t").first()
    assert (got[0], got[1], got[2], bytes(got[3]), got[4], got[5]) == (2, "x", 1.5, b"\x00\xff", True, 10)
    with pytest.raises(Exception, match="fraction"):
        engine.execute("INSERT INTO t (a) VALUES (2.5)")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        engine.execute("INSERT INTO t (a) VALUES ('abc')")
    assert rows(engine, "SELECT count(*) FROM t") == [(1,)]


def test_add_column(engine):
    engine.execute("CREATE TABLE t (a INTEGER); INSERT INTO t VALUES (1), (2); ALTER TABLE t ADD COLUMN b TEXT; ALTER TABLE t ADD COLUMN c INTEGER DEFAULT 7")
    engine.execute("INSERT INTO t VALUES (3, 'x', NULL)")
    assert rows(engine, "SELECT * FROM t ORDER BY a") == [(1, None, 7), (2, None, 7), (3, "x", None)]
    engine.execute("UPDATE t SET b = 'old' WHERE c = 7")
    assert rows(engine, "SELECT b FROM t ORDER BY a") == [("old",), ("old",), ("x",)]
    for sql in ("ALTER TABLE t ADD COLUMN d TEXT UNIQUE", "ALTER TABLE t ADD COLUMN a TEXT", "ALTER TABLE t ADD COLUMN d TEXT NOT NULL"):
        with pytest.raises(SchemaError):
            engine.execute(sql)


def test_snapshots_transactions_versions(spark, tmp_path):
    path = str(tmp_path / "db")
    a, b = Engine(spark, path), Engine(spark, path)
    a.execute("CREATE TABLE t (v TEXT); INSERT INTO t VALUES ('one')")
    before = b.sql("SELECT * FROM t")
    a.execute("BEGIN; INSERT INTO t VALUES ('two')")
    assert rows(a, "SELECT count(*) FROM t") == [(2,)] and rows(b, "SELECT count(*) FROM t") == [(1,)]
    a.execute("ROLLBACK")
    with a.begin() as tx:
        a._write(tx, *_parsed("INSERT INTO t VALUES ('three')"), [])
    assert [r.v for r in before.collect()] == ["one"] and rows(b, "SELECT count(*) FROM t") == [(2,)]
    first, second = a.begin(), b.begin()
    first.user_version, second.user_version = 4, 5
    first.commit()
    with pytest.raises(StorageError):
        second.commit()
    assert b.sql("PRAGMA user_version").first()[0] == 4
    a.execute("DELETE FROM t WHERE v = 'one'; INSERT INTO t VALUES ('four')")
    a.checkpoint()
    assert sorted(r.v for r in Engine(spark, path).sql("SELECT v FROM t").collect()) == ["four", "three"]
    assert len(a.store.files.names("data")) == 1 and len(a.store._versions()) == 1
    (tmp_path / "db" / "data" / "orphan").mkdir()  # of a writer that crashed: never seen, removed by the next checkpoint
    a.checkpoint()
    assert a.store.files.names("data") == [p for p in a.store.files.names("data") if p != "orphan"]


def _parsed(sql):
    from quarry.sql.parser import parse

    return parse(sql), sql


def test_insert_select_subqueries_and_ddl(engine):
    engine.execute("CREATE TABLE a (x INTEGER, y TEXT); INSERT INTO a VALUES (1, 'p'), (2, 'q'), (3, 'r')")
    engine.execute("CREATE TABLE b (x INTEGER); INSERT INTO b SELECT x FROM a WHERE x > (SELECT min(x) FROM a)")
    assert rows(engine, "SELECT x FROM b ORDER BY x") == [(2,), (3,)]
    assert engine.execute("DELETE FROM a WHERE x IN (SELECT x FROM b)") == 2
    assert engine.execute("UPDATE a SET y = (SELECT max(x) FROM b)") == 1 and rows(engine, "SELECT y FROM a") == [("3",)]
    engine.execute("CREATE TABLE IF NOT EXISTS a (z TEXT); CREATE UNIQUE INDEX i ON a (x); DROP TABLE IF EXISTS nope")
    assert engine.table_names() == ["a", "b"] and engine.schema()[-1].startswith("CREATE UNIQUE INDEX")
    for sql, kind in (("CREATE TABLE a (z TEXT)", SchemaError), ("DROP TABLE nope", NotFound), ("INSERT INTO a (zz) VALUES (1)", NotFound), ("INSERT INTO a VALUES (1)", SchemaError)):
        with pytest.raises(kind):
            engine.execute(sql)
    engine.execute("DROP TABLE a")
    assert engine.table_names() == ["b"]
    assert rows(engine, "PRAGMA table_info(b)") == [(0, "x", "INTEGER", 0, None, 0)]
    assert engine.sql("PRAGMA foreign_keys").first()[0] == 0 and engine.sql("PRAGMA journal_mode").first()[0] == "wal"
    assert engine.sql("PRAGMA whatever").collect() == []


def test_bare_columns_and_group_concat_follow_rowid(engine):
    engine.execute("CREATE TABLE t (g INTEGER, x TEXT); INSERT INTO t VALUES (1, 'c'), (2, 'z'), (1, 'a'), (1, NULL), (1, 'c')")
    assert rows(engine, "SELECT g, x, group_concat(x, '+') FROM t GROUP BY g ORDER BY g") == [(1, "c", "c+a+c"), (2, "z", "z")]
    assert rows(engine, "SELECT group_concat(DISTINCT x) FROM t") == [("a,c,z",)]


@dataclass
class User:
    id: int
    label: str = field(metadata={"rename": "name"})
    email: str | None = None
    note: str = field(default="kept", metadata={"skip": True})


def test_typed_rows(engine):
    engine.execute("CREATE TABLE u (id INTEGER PRIMARY KEY, name TEXT, email TEXT); INSERT INTO u VALUES (1, 'a', NULL), (2, 'b', 'b@x')")
    q = "SELECT * FROM u WHERE id >= ? ORDER BY id"
    assert engine.query(q).bind(1).fetch_all(User) == [User(1, "a"), User(2, "b", "b@x")]
    assert engine.query("SELECT id, name FROM u WHERE id = ?").bind(2).fetch_one(tuple[int, str]) == (2, "b")
    assert engine.query(q).bind(9).fetch_optional(User) is None
    assert list(engine.query("SELECT id FROM u ORDER BY id").fetch_stream(int)) == [1, 2]
    with pytest.raises(NotFound):
        engine.query(q).bind(9).fetch_one()
    with pytest.raises(TypeMismatch):
        engine.query("SELECT email FROM u WHERE id = 1").fetch_one(str)
    assert engine.fetch_raw("SELECT id, name FROM u ORDER BY id") == (["id", "name"], [(1, "a"), (2, "b")])
    assert engine.query_json("SELECT id, email FROM u WHERE id = 1") == [{"id": 1, "email": None}]
    assert engine.describe("SELECT id, name || 'x' AS n FROM u") == [("id", "bigint"), ("n", "string")]
    engine.validate("SELECT name FROM u WHERE id = ?")
    with pytest.raises(NotFound):
        engine.validate("UPDATE u SET nope = 1")


def test_migrations(engine, tmp_path):
    (tmp_path / "001_make_posts.sql").write_text("CREATE TABLE posts (id INTEGER PRIMARY KEY, title TEXT)")
    (tmp_path / "002_add_body.sql").write_text("ALTER TABLE posts ADD COLUMN body TEXT; INSERT INTO posts (title, body) VALUES ('t', 'b')")
    steps = load_migrations(str(tmp_path))
    assert engine.migrate(steps) == 2 and engine.migrate(steps) == 0
    assert rows(engine, "SELECT title, body FROM posts") == [("t", "b")]


def test_cursor(engine):
    db = connect(engine)
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, score INTEGER)")
    c = db.cursor()
    c.executemany("INSERT INTO t (name, score) VALUES (?, ?)", [("a", 1), ("b", 2), ("c", 3)])
    assert c.rowcount == 3
    db.commit()
    db.execute("DELETE FROM t WHERE id = 1")
    db.rollback()
    c.execute("SELECT id, name FROM t ORDER BY id")
    assert [d[0] for d in c.description] == ["id", "name"] and c.fetchone() == (1, "a") and c.fetchmany(5) == [(2, "b"), (3, "c")] and c.fetchone() is None
    with pytest.raises(IntegrityError):
        db.execute("INSERT INTO t VALUES (1, 'x', 0)")
    db.rollback()
    seen = []
    db.exec("SELECT name, score * 1.0 AS s FROM t ORDER BY id", lambda names, values: seen.append((names, values)))
    assert seen[0] == (["name", "s"], ["a", "1.0"])


def test_pool(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from quarry.pool import Pool

    engine = Engine(spark, str(tmp_path / "pool"))
    engine.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, who INTEGER)")
    pool = Pool(engine, 3)
    with ThreadPoolExecutor(4) as threads:
        assert list(threads.map(lambda i: pool.execute("INSERT INTO t (who) VALUES (?)", [i]), range(6))) == [1] * 6
    with pool.acquire() as own:
        assert own.sql("SELECT count(*), count(DISTINCT id), sum(who) FROM t").first()[:] == (6, 6, 15)


def test_a_writer_that_dies_before_its_commit(spark, tmp_path, monkeypatch):
    """Data files without a manifest change nothing: the store opens at the last commit, and the next writer goes on."""
    path = f"file://{tmp_path}/store"
    first = Engine(spark, path)
    first.execute("CREATE TABLE big (k INTEGER PRIMARY KEY, v TEXT)")
    first.register("numbers", spark.range(2000).withColumnRenamed("id", "n"))
    first.execute("INSERT INTO big SELECT n, 'row-' || n FROM numbers")

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(type(first.store.files), "create", die)
        m.setattr("quarry.store.store.Transaction._discard", lambda self: None)
        with pytest.raises(KeyboardInterrupt):
            first.execute("DELETE FROM big WHERE k < 1500")
    second = Engine(spark, path)
    assert rows(second, "SELECT count(*), min(k), max(k) FROM big") == [(2000, 0, 1999)]
    left = len(second.store.files.names("data"))
    second.execute("UPDATE big SET v = 'new' WHERE k = 7; INSERT INTO big VALUES (5000, 'more')")
    second.checkpoint()
    assert rows(Engine(spark, path), "SELECT count(*), max(k) FROM big WHERE v IN ('new', 'more')") == [(2, 5000)]
    assert len(second.store.files.names("data")) == 1 < left


def test_only_parts_with_hits_are_rewritten(engine):
    engine.execute("CREATE TABLE p (k INTEGER PRIMARY KEY, v INTEGER UNIQUE)")
    for i in range(4):
        engine.execute("INSERT INTO p VALUES (?, ?)", [i, 10 * i])
    before = {p.path for p in engine.store.snapshot().table("p").parts}
    assert engine.execute("UPDATE p SET v = 5 WHERE k = 99") == 0 and engine.execute("DELETE FROM p WHERE v = 7") == 0
    assert {p.path for p in engine.store.snapshot().table("p").parts} == before == {f"data/{n}" for n in engine.store.files.names("data")}
    assert engine.execute("UPDATE p SET v = v + 1 WHERE k = 2") == 1 and engine.execute("DELETE FROM p WHERE k = 0") == 1
    assert len(before & {p.path for p in engine.store.snapshot().table("p").parts}) == 2
    with pytest.raises(ConstraintError):
        engine.execute("UPDATE p SET v = 30 WHERE k = 1")  # the other part holds it
    assert rows(engine, "SELECT k, v FROM p ORDER BY k") == [(1, 10), (2, 21), (3, 30)]


def test_many_values(engine):
    engine.execute("CREATE TABLE m (a INTEGER, b TEXT, c REAL)")
    many = ", ".join(f"({i}, {'NULL' if i % 7 == 0 else repr(str(i))}, {i}.5)" for i in range(3000))
    assert engine.execute(f"INSERT INTO m VALUES {many}, (1 + 2, upper('x'), (SELECT max(1.25)))") == 3001
    assert rows(engine, "SELECT count(*), count(b), sum(a) FROM m") == [(3001, 3001 - 429, 3000 * 2999 // 2 + 3)]


def test_statements_leave_no_views(engine, spark):
    engine.register("n", spark.range(5))
    engine.execute("CREATE TABLE v (a INTEGER); INSERT INTO v SELECT id FROM n; UPDATE v SET a = a + 1 WHERE a IN (SELECT max(a) FROM v)")
    before = {t.name for t in spark.catalog.listTables()}
    df = engine.sql("WITH RECURSIVE r(x) AS (SELECT 1 UNION SELECT a FROM r JOIN v ON a = x + 1) SELECT x FROM r JOIN v ON a = x")
    engine.execute("DELETE FROM v WHERE a = (SELECT min(a) FROM v)")
    engine.validate("SELECT a FROM v")
    assert {t.name for t in spark.catalog.listTables()} == before
    assert sorted(r.x for r in df.collect()) == [1, 2, 3]


def test_json_targets(engine):
    assert engine.query("""SELECT '{"a": [1, 2]}', '[1, null]'""").fetch_one(tuple[dict, list[int]]) == ({"a": [1, 2]}, [1, None])
    for text in ("[1]", "{", "x"):
        with pytest.raises(TypeMismatch):
            engine.query("SELECT ?").bind(text).fetch_one(dict)
