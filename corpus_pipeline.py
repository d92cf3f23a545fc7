"""From raw documents to packed sequences: each stage is written to the shared folder and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from quarry.llm.common import scratch, stage, table, unstage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a quality rule rejects."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Orders the documents so that every prefix has its sources in their target weights."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' ids into sequences that follow the order of the rows."""
    return packing.packed_digests(docs, in_order=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("packing", pack),
]

#: Near-duplicates, tokens and the schedule can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(function(spark, docs, sf_dir), f"pipeline-{name}"))
        if before is not None:
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
