"""Event streams (beyond the dialect, which has none): windows with watermarks, sessions, duplicates, as batch or stream.

Each function takes a DataFrame and works alike on a batch and on a stream; only a stream's watermark drops late rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, time: str, delay: str) -> DataFrame:
    return df.withWatermark(time, delay) if df.isStreaming else df


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], aggregates: list[Column], delay: str = "10 minutes") -> DataFrame:
    """Aggregates by window of equal width and keys: window_start, the keys, the aggregates."""
    out = _late(df, time, delay).groupBy(F.window(time, width), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), *keys, *[c for c in out.columns if c not in ("window", *keys)])


def sliding(df: DataFrame, time: str, width: str, step: str, keys: list[str], aggregates: list[Column], delay: str = "10 minutes") -> DataFrame:
    out = _late(df, time, delay).groupBy(F.window(time, width, step), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), *keys, *[c for c in out.columns if c not in ("window", *keys)])


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggregates: list[Column], delay: str = "10 minutes") -> DataFrame:
    """Aggregates by session: rows of a key that lie less than gap apart."""
    out = _late(df, time, delay).groupBy(F.session_window(time, gap), *keys).agg(*aggregates)
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, *[c for c in out.columns if c not in ("session_window", *keys)])


def first_of(df: DataFrame, time: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """One row of each key; a stream forgets a key once the watermark has passed it."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
