"""Queries over sources, sinks, streams and user functions."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.cursor import Connection
from quarry.pool import Pool
from quarry.session import Engine
from quarry.sources.csv_files import import_csv, write_csv
from quarry.sources.render import MODES
from quarry.sources.sqlite_file import attach, write_sqlite
from quarry.streaming import windows

_KEPT: list = []


def _folder() -> Path:
    _KEPT.append(tempfile.TemporaryDirectory(prefix="quarry-files-"))
    return Path(_KEPT[-1].name)


def _shared(spark: SparkSession) -> str:
    """A folder that the executors see: the shared one, or a temporary one where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return f"{base.rstrip('/')}/quarry-files-{uuid.uuid4().hex}" if base else f"file://{_folder()}"


def source_sqlite_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to a SQLite file, read back in ranges of rowids."""
    folder = _shared(spark)
    if folder.startswith("file:"):  # a SQLite file needs a folder that is mounted everywhere
        Path(folder[5:]).mkdir(parents=True, exist_ok=True)
    path = str(Path(folder[5:] if folder.startswith("file:") else _folder()) / "nation.db")
    write_sqlite(Engine(spark).register_parquet(sf_dir, "nation").sql("SELECT n_nationkey, n_name FROM nation"), path, "nation", primary="n_nationkey")
    engine = Engine(spark)
    attach(engine, path, partitions=3)
    return engine.sql("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 4")


def source_csv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as part files with headers, read back into a table of the store with a column more."""
    engine = Engine(spark).register_parquet(sf_dir, "customer")
    _KEPT.append(engine)
    path = f"{_shared(spark)}/customer"
    write_csv(engine.sql("SELECT c_custkey, c_name, c_acctbal FROM customer"), path)
    engine.execute("CREATE TABLE imported (c_custkey INTEGER, c_name TEXT, c_acctbal REAL, note TEXT DEFAULT 'new')")
    import_csv(engine, path, "imported")
    return engine.sql("SELECT * FROM imported")


_NATIONS = "SELECT n_nationkey, n_name, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS r FROM nation ORDER BY n_nationkey"


def sink(mode: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shell prints in a mode, line by line."""
    df = Engine(spark).register_parquet(sf_dir, "nation").sql(_NATIONS)
    printed = "\n".join(MODES[mode](df.columns, df.toLocalIterator()))
    return spark.createDataFrame(list(enumerate(printed.split("\n"))), "place bigint, line string")


def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Engine(spark).register_parquet(sf_dir, "nation").query_json(_NATIONS)
    return spark.createDataFrame([(json.dumps(r, separators=(",", ":")),) for r in rows], "json string")


@dataclass
class _Nation:
    n_nationkey: int
    n_name: str
    r: int | None


def client(how: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a small query as each way of fetching hands them to a program."""
    engine = Engine(spark).register_parquet(sf_dir, "nation")
    query = engine.query(_NATIONS.replace("> 1", "> ?")).bind(1)
    if how == "typed":
        rows = query.fetch_all(tuple[int, str, int | None])
    elif how == "record":
        rows = [(n.n_nationkey, n.n_name, n.r) for n in query.fetch_all(_Nation)]
    elif how == "stream":
        rows = list(query.fetch_stream(tuple))
    elif how == "raw":
        rows = engine.fetch_raw(_NATIONS)[1]
    elif how == "cursor":
        rows = Connection(engine).cursor().execute(_NATIONS).fetchall()
    else:
        with Pool(engine, 2).acquire() as other:
            rows = other.query(_NATIONS).fetch_all(tuple)
    return spark.createDataFrame([tuple(r) for r in rows], "n_nationkey bigint, n_name string, r bigint")


def user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("bigint")
    def vowels(s: pd.Series) -> pd.Series:
        return s.str.count("[AEIOU]")

    return Engine(spark).register_parquet(sf_dir, "nation").register_function("vowels", vowels).sql("SELECT n_name, vowels(n_name) AS v FROM nation")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.tumbling(_events(spark, sf_dir), "ts", "1 day", ["event_type"], [F.count("*").alias("n")])
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream that ends when its input does."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.tumbling(events, "ts", "1 day", ["event_type"], [F.count("*").alias("n")])
    path = _shared(spark)
    # Each batch's complete state replaces the file table of the one before: no task or driver holds it.
    query = out.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/state")).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/state").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def window_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.sessions(_events(spark, sf_dir), "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")])
    return out.select("user_id", F.unix_micros("session_start").alias("started"), "n")


_WAYS = ("typed", "record", "stream", "raw", "cursor", "pool")
EXTRA: dict[str, Callable[[SparkSession, str], DataFrame]] = (
    {f.__name__: f for f in (source_sqlite_file, source_csv_import, sink_json, user_function, window_tumbling, stream_tumbling, window_sessions)}
    | {f"sink_{m}": partial(sink, m) for m in ("table", "csv", "line")}
    | {f"client_{w}": partial(client, w) for w in _WAYS}
)
_ROWS = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(CASE WHEN n_regionkey > 1 THEN n_regionkey END AS BIGINT) AS r FROM nation"
_CELLS = f"SELECT n_nationkey AS p, CAST(n_nationkey AS VARCHAR) AS a, n_name AS b, CAST(r AS VARCHAR) AS c FROM ({_ROWS})"
_WIDE = "CAST(greatest(11, max(length(a))) AS INTEGER) AS wa, CAST(greatest(6, max(length(b))) AS INTEGER) AS wb, CAST(greatest(1, max(length(coalesce(c, 'NULL')))) AS INTEGER) AS wc"


def _framed(left: str, middle: str, right: str) -> str:
    return f"'{left}' || repeat('─', wa + 2) || '{middle}' || repeat('─', wb + 2) || '{middle}' || repeat('─', wc + 2) || '{right}'"


_DAILY = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"
EXTRA_SQL: dict[str, str] = {
    "source_sqlite_file": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_nationkey > 4",
    "source_csv_import": "SELECT c_custkey, c_name, c_acctbal, 'new' AS note FROM customer",
    "sink_json": f"""SELECT '{{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","r":' || coalesce(CAST(r AS VARCHAR), 'null') || '}}' AS json FROM ({_ROWS})""",
    "sink_csv": f"SELECT CAST(0 AS BIGINT) AS place, 'n_nationkey,n_name,r' AS line UNION ALL SELECT p + 1, a || ',' || b || ',' || coalesce(c, '') FROM ({_CELLS})",
    "sink_line": f"SELECT CAST(4 * p + i AS BIGINT) AS place, CASE i WHEN 0 THEN 'n_nationkey = ' || a WHEN 1 THEN 'n_name = ' || b WHEN 2 THEN 'r = ' || coalesce(c, '') ELSE '' END AS line FROM ({_CELLS}), (VALUES (0), (1), (2), (3)) AS v(i)",
    "sink_table": f"WITH w AS (SELECT {_WIDE}, max(p) AS z FROM ({_CELLS})), lines AS (SELECT 0 AS place, {_framed('┌', '┬', '┐')} AS line FROM w UNION ALL SELECT 2, {_framed('├', '┼', '┤')} FROM w UNION ALL SELECT z + 4, {_framed('└', '┴', '┘')} FROM w"
    f" UNION ALL SELECT 1, '│ ' || rpad('n_nationkey', wa, ' ') || ' │ ' || rpad('n_name', wb, ' ') || ' │ ' || rpad('r', wc, ' ') || ' │' FROM w"
    f" UNION ALL SELECT p + 3, '│ ' || rpad(a, wa, ' ') || ' │ ' || rpad(b, wb, ' ') || ' │ ' || rpad(coalesce(c, 'NULL'), wc, ' ') || ' │' FROM w, ({_CELLS})) SELECT CAST(place AS BIGINT) AS place, line FROM lines",
    "user_function": "SELECT n_name, CAST(length(regexp_replace(n_name, '[^AEIOU]', '', 'g')) AS BIGINT) AS v FROM nation",
    "window_tumbling": _DAILY,
    "stream_tumbling": _DAILY,
    "window_sessions": "SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS started, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s",
} | {f"client_{w}": _ROWS for w in _WAYS}
