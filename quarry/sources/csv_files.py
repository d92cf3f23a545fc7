"""CSV in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.values import SPARK_TYPE, name


def import_csv(engine, path: str, table: str) -> int:
    """Appends a CSV file with a header to a table of the store; makes the table, all TEXT, where there is none.

    Header names are matched to columns without regard to case; fields take the columns' types, and one that can't is an
    error. Columns the file doesn't have get their defaults.
    """
    raw = engine.spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    with engine.begin() as t:
        if not t.has(table):
            engine._write(t, *_create(table, raw.columns), [])
        target = t.table(table)
        given = {c.lower(): c for c in raw.columns}
        unknown = set(given) - {c.name.lower() for c in target.columns}
        for c in unknown:
            target.column(c)
        from quarry.store.store import _default

        rows = raw.withColumn("_seq", F.monotonically_increasing_id()).select(
            "_seq", *[(F.col(name(given[c.name.lower()])) if c.name.lower() in given else _default(c)).cast(SPARK_TYPE[c.kind]).alias(c.name) for c in target.columns]
        )
        count, _ = t._append(target, rows, "abort", engine._lowering([]))
    return count


def _create(table: str, columns: list[str]):
    from quarry.sql.parser import parse

    quoted = lambda s: '"' + s.replace('"', '""') + '"'
    sql = f"CREATE TABLE {quoted(table)} ({', '.join(f'{quoted(c)} TEXT' for c in columns)})"
    return parse(sql), sql


def write_csv(df: DataFrame, path: str) -> None:
    """Part files with a header each; NULL is an empty field."""
    df.write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
