"""The relational operators as functions on DataFrames, for callers who compose plans without SQL text.

Each follows the dialect where it differs from Spark: whole-number division, NULL for division by zero, truth of numbers,
LIKE without case, scalar min and max that NULL wins, sorting with NULLs first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truthy(c: Column, kind: str = "int") -> Column:
    """A value as a condition; kind as in quarry.values."""
    if kind == "bool":
        return c
    if kind in ("int", "real"):
        return c != 0
    return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(c.try_cast("double") != 0, F.lit(False)))


def divide(a: Column, b: Column, whole: bool) -> Column:
    """a / b: whole numbers are cut toward zero; NULL where b is zero."""
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint"))) if whole else a / F.nullif(b, F.lit(0.0))


def like(c: Column, pattern: str) -> Column:
    return c.ilike(pattern.replace("\\", "\\\\"))


def smallest(*cs: Column) -> Column:
    return F.when(reduce(lambda x, y: x | y, [c.isNull() for c in cs]), None).otherwise(F.least(*cs))


def largest(*cs: Column) -> Column:
    return F.when(reduce(lambda x, y: x | y, [c.isNull() for c in cs]), None).otherwise(F.greatest(*cs))


def total(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("double")), F.lit(0.0))


def group_concat(c: Column, separator: str = ",", order: Column | None = None) -> Column:
    """Values as text joined in the given order (else as they come). The list of a group is built in one task."""
    if order is None:
        return F.array_join(F.collect_list(c.cast("string")), separator)
    pairs = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(order.alias("o"), c.cast("string").alias("v")))))
    return F.when(F.size(pairs) > 0, F.array_join(F.transform(pairs, lambda p: p["v"]), separator))


def distinct_sorted(df: DataFrame, columns: list[str], by: Column, down: bool = False) -> DataFrame:
    """SELECT DISTINCT columns ORDER BY something they don't hold: each row's first value in that order counts."""
    key = (F.max if down else F.min)(by).alias("_by")
    out = df.groupBy(*columns).agg(key).orderBy(F.desc("_by") if down else F.asc("_by"))
    return out.drop("_by")


def range_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with low <= value < high, as an equi-join on buckets of the given width: no nested loop at any size."""
    lows, highs = F.floor(F.col(low) / width), F.floor((F.col(high) - F.lit(1e-12)) / width)
    spread = right.withColumn("_bucket", F.explode(F.sequence(lows, F.greatest(lows, highs))))
    joined = left.withColumn("_bucket", F.floor(F.col(value) / width)).join(spread, "_bucket")
    return joined.where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_bucket")


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """An equi-join whose left side has hot keys: its rows are dealt over salts, the right side's rows repeated for each."""
    l = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [key, "_salt"], how).drop("_salt")
