"""Mixing sources to target weights by a Pfair schedule.

Rows of a source are dealt into blocks of equal size (the last may be shorter). Block j of a source with weight w is
released at slot floor(j / w) and due at slot ceil((j + 1) / w); the released block that is due first takes the slot. On one
lane with weights that sum to one this misses no deadline, so after any number of slots a source has had its share to less
than one block. When a source is used up, the weights of the others are scaled up and a new phase with the same property
begins; every row is kept.

Weights are whole numbers: shares of the total to a resolution of one in PARTS, one part at least. So the schedule of a
phase repeats after as many slots as the weights' sum, and only one period of each phase is worked out: what the driver
computes and broadcasts depends on the number of sources (a configured list) and not on their rows, and blocks have the
same size at any scale. The driver sees one count for each source.

Ranks within a source come from range partitions and run offsets over narrow rows (place in the file, source, hash of the
id), so a source with most rows is spread over all tasks. Wide rows then move twice, to their position and into its
partition: positions have no gaps, so partitions are even ranges of them and nothing is sampled.

Defined cases: sources are of any type that can be ordered; a null source is a source of its own; sources to which no
positive weight is given follow after all others, in proportion to their rows; repeated rows are rows; an empty table gives
an empty result; texts aren't looked at; other columns pass through.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heappop, heappush
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.llm.common import global_rank, shuffle_partitions, stage

#: Rows of a block, the unit to which any prefix of the mix holds the target weights.
BLOCK = 16
#: Resolution of weights; coarser where many sources would make the table of periods longer than TABLE entries.
PARTS, TABLE = 10_000, 400_000
#: Without given weights a source weighs its number of rows to this power: small sources come sooner than they would by chance.
TEMPERATURE = 0.7


def default_weights(counts: dict) -> dict:
    return {s: n**TEMPERATURE for s, n in counts.items()}


def whole_weights(shares: dict) -> dict:
    """Positive whole numbers in the proportions of the shares, which are positive."""
    total, parts = sum(shares.values()), max(len(shares), min(PARTS, TABLE // max(1, len(shares))))
    return {s: max(1, round(x / total * parts)) for s, x in shares.items()}


def period(weights: dict) -> dict:
    """Source -> its slots of the first sum(weights) ones. Subtasks wait in a heap by release time and move to a heap by deadline."""
    total = sum(weights.values())
    order = sorted(weights, key=lambda s: (-weights[s], s is None, 0 if s is None else s))
    waiting: list[tuple[int, int, int, int]] = []
    ready: list[tuple[int, int, int]] = []

    def add(i: int, j: int) -> None:
        w = weights[order[i]]
        heappush(waiting, (j * total // w, -(-(j + 1) * total // w), i, j))

    for i in range(len(order)):
        add(i, 0)
    out: dict = {s: [] for s in order}
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, due, i, j = heappop(waiting)
            heappush(ready, (due, i, j))
        _, i, j = heappop(ready)
        out[order[i]].append(t)
        add(i, j + 1)
    return out


class Phase(NamedTuple):
    """Slots `first` to first + slots - 1; the sources' slots in each period; each one's first block and number of blocks."""

    first: int
    slots: int
    length: int
    pattern: dict
    start: dict
    blocks: dict


def schedule(blocks: dict, weights: dict) -> list[Phase]:
    """The phases that give out all blocks. A phase ends with the slot in which a source's last block is given out."""
    left = {s: n for s, n in blocks.items() if n > 0}
    early = {s: weights.get(s) or 0 for s in left if (weights.get(s) or 0) > 0}
    late = {s: n for s, n in left.items() if s not in early}
    out, done, at = [], dict.fromkeys(left, 0), 0
    for group in (early, late):
        whole = whole_weights(group) if group else {}
        while live := {s: w for s, w in whole.items() if done[s] < left[s]}:
            pattern, length = period(live), sum(live.values())
            ends = (((left[s] - done[s] - 1) // w) * length + pattern[s][(left[s] - done[s] - 1) % w] for s, w in live.items())
            slots = min(ends) + 1
            given = {s: slots // length * w + bisect_left(pattern[s], slots % length) for s, w in live.items()}
            out.append(Phase(at, slots, length, pattern, {s: done[s] for s in live}, given))
            at += slots
            for s in live:
                done[s] += given[s]
    return out


def _tables(spark: SparkSession, phases: list[Phase], counts: dict, block: int, kind) -> tuple[DataFrame, DataFrame]:
    """(source, from, to, phase, weight, length, first slot, first position) of each source's stay in a phase; (phase, source, i, at) of each period."""
    stays, places, position = [], [], 0
    for k, p in enumerate(phases):
        for s, slots in p.pattern.items():
            stays.append((s, p.start[s], p.start[s] + p.blocks[s], k, len(slots), p.length, p.first, position))
            places += [(k, s, i, t) for i, t in enumerate(slots[: p.blocks[s]])]
        # Of a phase's blocks only the last one, its source's last too, may be short.
        rows = {s: min(counts[s], (p.start[s] + p.blocks[s]) * block) - p.start[s] * block for s in p.blocks}
        position += sum(rows.values())
    long = lambda *names: [StructField(n, LongType()) for n in names]
    first = StructType([StructField("_s2", kind), *long("_from", "_to", "_k", "_w", "_length", "_slot", "_start")])
    second = StructType([*long("_k3"), StructField("_s3", kind), *long("_i3", "_at")])
    return spark.createDataFrame(stays, first), spark.createDataFrame(places, second)


def _scheduled(rows: DataFrame, order: list[str], weights: dict | None, block: int, tag: str) -> tuple[DataFrame, int]:
    """rows(key columns, `_s` source) beside block, slot and position; and the number of rows."""
    counts = {r["_s"]: r["count"] for r in rows.groupBy("_s").count().collect()}  # one row for each source
    phases = schedule({s: -(-n // block) for s, n in counts.items()}, weights or default_weights(counts))
    stays, places = _tables(rows.sparkSession, phases, counts, block, rows.schema["_s"].dataType)
    ranked = global_rank(rows, "_s", F.struct(*order), tag).withColumn("block", F.floor(F.col("rank") / block))
    # Both tables are as long as the list of sources and the resolution make them: TABLE entries or a little more.
    of_phase = ranked.join(F.broadcast(stays), F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("block") >= F.col("_from")) & (F.col("block") < F.col("_to")))
    of_phase = of_phase.withColumn("_j", F.col("block") - F.col("_from"))
    place = F.broadcast(places)
    met = (F.col("_k") == F.col("_k3")) & F.col("_s").eqNullSafe(F.col("_s3")) & (F.col("_j") % F.col("_w") == F.col("_i3"))
    placed = of_phase.join(place, met).withColumn("_t", F.floor(F.col("_j") / F.col("_w")) * F.col("_length") + F.col("_at"))
    slot, position = F.col("_slot") + F.col("_t"), F.col("_start") + F.col("_t") * block + F.col("rank") % block
    return placed.select(*rows.columns, "block", slot.alias("slot"), position.alias("position")), sum(counts.values())


def mix(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, source, block (of its source), slot (of the block), position (gapless from 0)."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("_s"))
    placed, _ = _scheduled(narrow.withColumn("_h", F.xxhash64("doc_id")), ["_h"], weights, block, "mix")
    return placed.select("doc_id", F.col("_s").alias("source"), "block", "slot", "position")


#: What names a row of a Parquet table, the same on every reading.
_KEYS = ["_f", "_g", "_i"]


def _located(docs: DataFrame) -> DataFrame:
    """docs as one column `_row`, beside _KEYS. What isn't a plain Parquet table is written first."""
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    keys = [c.alias(k) for c, k in zip((F.xxhash64(path), F.hash(path), row), _KEYS, strict=True)]
    one = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in docs.columns:
        try:
            return docs.select(*keys, one)
        except AnalysisException:  # a format whose rows have no numbers
            pass
    return stage(docs.select(one), "rows").select(*keys, "_row")


def mixed(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """The rows of docs in mixed order: partitions and the rows in them follow the schedule."""
    n, wide = shuffle_partitions(docs.sparkSession), _located(docs)
    narrow = wide.select(*_KEYS, F.col("_row").getField(source_col).alias("_s"), F.xxhash64(F.col("_row").getField(id_col)).alias("_h"))
    placed, total = _scheduled(narrow, ["_h", *_KEYS], weights, block, "mixed")
    placed = wide.join(placed.select(*_KEYS, "position"), _KEYS)
    part = F.floor(F.col("position") * n / max(1, total)).cast("int")
    return placed.repartitionById(n, part).sortWithinPartitions("position").select("_row.*")
