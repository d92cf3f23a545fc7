"""Shared plumbing: written tables in the cluster's shared folder, size-checked joins, global ranks."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A set of ids is broadcast only after it was counted and found to hold at most this many longs (16 MB).
BROADCAST_IDS = 2_000_000
#: Rows of one key that one task gets where keys are salted.
GROUP = 2_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset and tasks run in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return base.rstrip("/") if base else f"file://{tempfile.gettempdir()}/quarry-shared"


_collected = 0.0

#: Folders and tables that operators have written.
_WRITTEN: list[tuple[str, str]] = []


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, tag: str) -> str:
    """A folder for one written step. Whatever is left of it goes when the application ends."""
    path = f"{shared_dir(spark)}/quarry-{tag}-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    _WRITTEN.append(("folder", path))
    return path


def unstage(*steps: DataFrame) -> None:
    """Deletes written steps that nothing will read again."""
    for df in steps:
        fs, at = _file_system(df.sparkSession, df._quarry_path)
        fs.delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes on leaving what operators wrote inside, but for the written steps handed to the function it gives.

    An operator's result reads its last steps, so inside it must be written (stage) and handed over.
    """
    begin, kept = len(_WRITTEN), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._quarry_path)
        return df

    yield keep
    for kind, what in _WRITTEN[begin:]:
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {what}")
        elif what not in kept:
            fs, at = _file_system(spark, what)
            fs.delete(at, True)
    del _WRITTEN[begin:]


def drop_at_end(spark: SparkSession, name: str) -> None:
    """Drops a table from the catalog when the program ends, if the session still lives then."""
    _WRITTEN.append(("table", name))

    def drop() -> None:
        context = spark.sparkContext
        if context._jsc is not None and not context._jsc.sc().isStopped():
            spark.sql(f"DROP TABLE IF EXISTS {name}")

    atexit.register(drop)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, lost executors lose nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    # Spark deletes the shuffle files of plans nothing refers to any more when the driver collects garbage, which it may
    # not do for hours; a job of many stages would keep them all.
    global _collected
    if time.monotonic() - _collected > 1:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_ids(df: DataFrame, key: str, ids: DataFrame, how: str) -> DataFrame:
    """left_semi or left_anti join of wide rows with a one-column table of ids (column `key`).

    The ids are counted first. Up to BROADCAST_IDS they are broadcast, so the wide side isn't moved; beyond it
    both sides are shuffled by id.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, how)


def with_rows(df: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """Inner join of wide rows with a narrow written table, which is counted first and broadcast as in by_ids."""
    few = rows.limit(BROADCAST_IDS // 4 + 1).count() <= BROADCAST_IDS // 4
    return df.join(F.broadcast(rows) if few else rows, key)


def hot(rows: DataFrame, key: str) -> DataFrame:
    """(key, salts) of the keys with more than GROUP rows, written; there is at most one for GROUP rows."""
    return stage(rows.groupBy(key).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts")).where("salts > 1"), "hot")


def with_salts(rows: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """rows with `salts`, 1 unless key is one of the heavy ones, which are broadcast after counting them."""
    few = heavy.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(heavy) if few else heavy, key, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))


def salted(column: str) -> Column:
    """The salt of a row of with_salts, by a column that differs from row to row."""
    return F.pmod(F.xxhash64(column), F.col("salts")).cast("int")


def salts() -> Column:
    """A row for each salt."""
    return F.explode(F.sequence(F.lit(0), F.col("salts") - 1))


def global_rank(df: DataFrame, key: str, order: Column, tag: str) -> DataFrame:
    """Adds `rank` (from 0, gapless within each value of key) without a window over a key.

    Rows are range-partitioned by (key, order), so a hot key spreads over many partitions; each written row carries its
    place in its partition, and the offset of a (partition, key) run is the sum of the counts of the runs before it. There
    is at most one run per partition and key boundary.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    laid = stage(
        df.withColumn("_o", order).repartitionByRange(n, key, "_o").sortWithinPartitions(key, "_o").withColumn("_at", F.monotonically_increasing_id()).drop("_o"),
        tag,
    )
    runs = laid.groupBy(F.col(key).alias("_k"), F.shiftright("_at", 33).alias("_p")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a key has a run a partition at most
    offsets = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    laid = laid.withColumn("_p", F.shiftright("_at", 33))
    joined = laid.join(offsets.withColumnRenamed("_p", "_q"), laid[key].eqNullSafe(F.col("_k")) & (F.col("_p") == F.col("_q")))
    return joined.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_p", "_q", "_k", "_first", "_before")
