"""The query table of the driver contract: catalog texts through the engine, written tables, operators, streams."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.catalog import PARAMETERS, Q
from quarry.plans.extra import EXTRA, EXTRA_SQL
from quarry.plans.written import WRITTEN, WRITTEN_SQL
from quarry.session import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def engine_over(spark: SparkSession, sf_dir: str, sql: str = "") -> Engine:
    """An engine that reads the test tables which sql names."""
    engine = Engine(spark)
    return engine.register_parquet(sf_dir, *[t for t in TABLES if not sql or t in sql])


def run_text(key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = Q[key][0]
    return engine_over(spark, sf_dir, sql).sql(sql, PARAMETERS.get(key))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: partial(run_text, k) for k in Q} | WRITTEN | EXTRA


def oracle_sql() -> dict[str, str]:
    return {k: duck or sql for k, (sql, duck) in Q.items()} | WRITTEN_SQL | EXTRA_SQL
