"""Files, output modes, the shell, streams, composed operators, user functions."""

import io
import sqlite3

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.errors import TypeMismatch
from quarry.operators import relational as R
from quarry.shell import Shell
from quarry.sources.csv_files import import_csv, write_csv
from quarry.sources.render import MODES
from quarry.sources.sqlite_file import attach, tables, write_sqlite
from quarry.streaming import windows


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "x.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE products (id INTEGER PRIMARY KEY, name TEXT, price REAL, data BLOB, n INTEGER)")
    db.executemany("INSERT INTO products VALUES (?, ?, ?, ?, ?)", [(i * 3, f"p{i}", i / 2, bytes([i]), None if i % 5 else i) for i in range(1, 101)])
    db.execute("CREATE VIEW v AS SELECT 1")
    db.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID")
    db.execute("INSERT INTO keyed VALUES ('a', 1), ('b', 2)")
    db.execute("CREATE TABLE empty (a INTEGER)")
    db.execute("CREATE TABLE mixed (a INTEGER)")
    db.execute("INSERT INTO mixed VALUES (1), ('text')")
    db.commit()
    db.close()
    return path


def test_sqlite_reader(engine, database):
    assert attach(engine, database, partitions=7) == ["empty", "keyed", "mixed", "products"] == tables(database)
    got = engine.sql("SELECT count(*), sum(id), min(name), max(price), sum(n) FROM products").first()
    assert tuple(got) == (100, sum(i * 3 for i in range(1, 101)), "p1", 50.0, sum(range(5, 101, 5)))
    assert bytes(engine.sql("SELECT data FROM products WHERE id = 3").first()[0]) == b"\x01"
    assert engine.sql("SELECT * FROM products").rdd.getNumPartitions() == 7
    assert engine.sql("SELECT count(*) FROM keyed").first()[0] == 2 and engine.sql("SELECT * FROM empty").collect() == []
    with pytest.raises(Exception, match="TypeMismatch|no int"):
        engine.sql("SELECT sum(a) FROM mixed").collect()
    assert issubclass(TypeMismatch, Exception)


def test_sqlite_writer(engine, spark, tmp_path):
    path = str(tmp_path / "out.db")
    df = spark.createDataFrame([(1, "ann", 2.5, None), (2, "böb", None, True)], "id long, name string, score double, ok boolean")
    assert write_sqlite(df, path, "users", primary="id") == 2
    db = sqlite3.connect(path)
    assert db.execute("SELECT * FROM users ORDER BY id").fetchall() == [(1, "ann", 2.5, None), (2, "böb", None, 1)]
    assert db.execute("PRAGMA integrity_check").fetchone() == ("ok",)


def test_csv(engine, spark, tmp_path):
    (tmp_path / "in.csv").write_text('id,name\n1,"a, b"\n2,"say ""hi"""\n3,\n')
    assert import_csv(engine, str(tmp_path / "in.csv"), "fresh") == 3
    assert engine.sql("SELECT typeof(id) FROM fresh").first()[0] == "text"
    engine.execute("CREATE TABLE typed (id INTEGER, name TEXT, extra INTEGER DEFAULT 4)")
    import_csv(engine, str(tmp_path / "in.csv"), "typed")
    assert [tuple(r) for r in engine.sql("SELECT * FROM typed ORDER BY id").collect()] == [(1, "a, b", 4), (2, 'say "hi"', 4), (3, None, 4)]
    write_csv(engine.sql("SELECT id, name FROM typed ORDER BY id").coalesce(1), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("*.csv")).read_text().splitlines()[0] == "id,name"


def test_modes():
    rows = [(1, "x", None, 1e20, True, b"ab")]
    names = ["i", "s", "n", "r", "b", "d"]
    assert list(MODES["csv"](names, rows)) == ["i,s,n,r,b,d", "1,x,,1.0e+20,1,ab"]
    assert "r = 1.0e+20" in next(iter(MODES["line"](names, rows)))
    assert '"n": null' in "\n".join(MODES["json"](names, rows)) and '"b": true' in "\n".join(MODES["json"](names, rows))
    assert len(list(MODES["table"](names, rows))) == 5


def test_shell(engine, tmp_path):
    (tmp_path / "f.csv").write_text("a,b\n1,2\n")
    out = io.StringIO()
    Shell(engine, out).feed(
        ["CREATE TABLE t (x INTEGER,\n", "y TEXT);\n", "INSERT INTO t VALUES (1, 'a;b'), (2, NULL);\n", ".mode csv\n", "SELECT *\n", "FROM t ORDER BY x;\n", ".tables\n", ".schema\n", f".import {tmp_path / 'f.csv'} g\n", "SELECT nope;\n", ".exit\n", "SELECT 5;\n"]
    )
    said = out.getvalue().splitlines()
    assert said[:3] == ["x,y", "1,a;b", "2,"] and "t" in said and said[-2] == "1 rows" and said[-1].startswith("Error: no such column")


def test_user_functions(engine):
    @F.pandas_udf("double")
    def half(x: pd.Series) -> pd.Series:
        return x / 2.0

    engine.register_function("half", half)
    assert engine.sql("SELECT half(5) AS h").first()[0] == 2.5


def test_windows_batch_and_stream(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "event_type", "user_id")
    events.coalesce(2).write.parquet(str(tmp_path / "in"))
    count = [F.count("*").alias("n")]
    batch = windows.tumbling(events, "ts", "1 day", ["event_type"], count)
    stream = windows.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "1 day", ["event_type"], count)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbling").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, batch.collect()))
    assert windows.sliding(events, "ts", "1 day", "12 hours", ["event_type"], count).agg(F.sum("n")).first()[0] == 2 * events.count()
    assert windows.sessions(events, "ts", "1 hour", ["user_id"], count).agg(F.sum("n")).first()[0] == events.count()
    assert windows.first_of(events, "ts", ["user_id"]).count() == events.select("user_id").distinct().count()


def test_operators(spark):
    df = spark.createDataFrame([(1, 7, "a"), (2, 0, "B"), (3, None, "b")], "k long, d long, s string")
    got = df.select(R.divide(F.lit(15).cast("long"), F.col("d"), True), R.smallest(F.col("k"), F.col("d")), R.largest(F.col("k"), F.col("d")), R.like(F.col("s"), "B%")).collect()
    assert [tuple(r) for r in got] == [(2, 1, 7, False), (None, 0, 2, True), (None, None, None, True)]
    assert df.agg(R.total(F.col("d")), R.group_concat(F.col("s"), "-", F.col("k"))).first()[:] == (7.0, "a-B-b")
    assert [r.s for r in R.distinct_sorted(df, ["s"], F.col("k"), down=True).collect()] == ["b", "B", "a"]
    points = spark.createDataFrame([(float(i),) for i in range(50)], "v double")
    spans = spark.createDataFrame([(0.0, 10.0), (9.5, 30.0), (49.0, 49.0)], "lo double, hi double")
    assert sorted(map(tuple, R.range_join(points, spans, "v", "lo", "hi", 4.0).collect())) == sorted((v.v, s.lo, s.hi) for v in points.collect() for s in spans.collect() if s.lo <= v.v < s.hi)
    assert R.salted_join(df, df.select("k", F.col("s").alias("t")), "k", 3).count() == 3


def test_sqlite_file_with_gaps_between_rowids(engine, tmp_path):
    """Ranges of rowids hold about as many rows each, however far apart the rowids are."""
    import sqlite3

    from quarry.sources.sqlite_file import _Reader, attach

    path = str(tmp_path / "gaps.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE g (k INTEGER PRIMARY KEY, v TEXT, b BLOB)")
        db.executemany("INSERT INTO g VALUES (?, ?, ?)", [(i if i < 900 else 10**12 + i * 10**6, None if i % 5 == 0 else f"v{i}", bytes([i % 256])) for i in range(1000)])
    assert attach(engine, path, partitions=4) == ["g"]
    df = engine.sql("SELECT k, v, b FROM g")
    assert df.rdd.getNumPartitions() == 4
    reader = _Reader({"path": path, "table": "g", "numPartitions": "4"}, df.schema)
    assert [sum(b.num_rows for b in reader.read(p)) for p in reader.partitions()] == [250] * 4
    assert df.count() == 1000 and {r.k for r in df.collect()} == {i if i < 900 else 10**12 + i * 10**6 for i in range(1000)}
    assert df.where("v IS NULL").count() == 200 and bytes(df.where("k = 7").first().b) == bytes([7])
