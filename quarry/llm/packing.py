"""Best-two-fit packing of token pieces into sequences of a fixed size.

Texts are tokenised where they lie; pieces are written once to the shared folder. Packing looks at the histogram of piece
lengths alone, which has at most `size` entries whatever the corpus: a plan is a list of bin shapes with the number of
bins of each shape. A bin is filled greedily with the longest lengths that fit; then its smallest piece is taken out and
the two lengths that fit the widened gap best replace it, if they fill it better. One shape is used for as many bins as
the histogram allows, so planning takes time by the number of lengths, not of pieces.

Pieces then find their places: the r-th piece of a length goes to the r-th slot of that length. Ranks within a length come
from range partitions and run offsets, so a length that a third of all pieces has isn't one task's work; slots are
intervals of ranks.

An added token of the vocabulary that stands in a text is one id, as the tokenizers library has it.

Defined cases: null and empty texts are one piece of the end id alone; a text whose ids exceed a sequence is cut into
pieces of the full size, the first of which may be shorter; repeated rows are packed each; an empty table gives an empty
result; a null id is carried along.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import global_rank, shuffle_partitions, stage
from quarry.llm.tokens import byte_bpe, vocabulary_path

SIZE = 2048
#: The id that ends each document.
END = 0
_SLOTS = "length bigint, low bigint, ranks bigint, sequence bigint, each bigint, base bigint"


def piece_bounds(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all but the first have the full size."""
    if n <= size:
        return [(0, n)]
    head = n % size or size
    return [(0, head), *((s, size) for s in range(head, n, size))]


def _pieces(path: str, size: int, digest: bool):
    last, kind = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = byte_bpe(path), np.uint32(END).tobytes()
        names = ["doc_id", "_file", "_block", "_row", "piece", "start", "length", last]
        for batch in batches:
            rows, docs = [], batch.column("doc_id")
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = bpe.encode_bytes(text or "") + end
                held = ((k, s, n, ids[4 * s : 4 * (s + n)]) for k, (s, n) in enumerate(piece_bounds(len(ids) // 4, size)))
                rows += [(i, k, s, n, crc32(part) if digest else part) for k, s, n, part in held]
            at, *rest = zip(*rows, strict=True) if rows else ([],) * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), kind)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int32())) for c in (docs, *map(batch.column, names[1:4]))), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))], names=names)

    return run


class _Lengths:
    """Piece lengths that are left, with their counts; asks for the longest one that fits."""

    def __init__(self, counts: dict[int, int]):
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.keys = sorted(self.left)

    def fit(self, room: int, used: dict[int, int]) -> int | None:
        """The longest length of at most `room` of which more are left than `used` has."""
        i = bisect_right(self.keys, room)
        while i:
            i -= 1
            if self.left[self.keys[i]] > used.get(self.keys[i], 0):
                return self.keys[i]
        return None

    def take(self, shape: dict[int, int], bins: int) -> None:
        for n, k in shape.items():
            self.left[n] -= k * bins
            if not self.left[n]:
                del self.left[n]
                self.keys.remove(n)


def best_two(lengths: _Lengths, room: int, used: dict[int, int]) -> tuple[int, int] | None:
    """The two lengths left whose sum is largest within room; of equal sums the pair with the longer first."""
    best, i = None, bisect_right(lengths.keys, room - 1)
    while i:
        i -= 1
        a = lengths.keys[i]
        if best and 2 * a < sum(best):
            break
        if lengths.left[a] <= used.get(a, 0):
            continue
        b = lengths.fit(min(room - a, a), used | {a: used.get(a, 0) + 1})
        if b and (best is None or a + b > sum(best)):
            best = (a, b)
            if a + b == room:
                break
    return best


def plan(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, longest first; number of such bins), all pieces placed."""
    lengths, out = _Lengths(counts), []
    while lengths.keys:
        shape, room = [], size
        used: dict[int, int] = {}
        while room and (n := lengths.fit(room, used)):
            shape.append(n)
            used[n] = used.get(n, 0) + 1
            room -= n
        if room and len(shape) > 1:
            small = shape[-1]
            used[small] -= 1
            if (two := best_two(lengths, room + small, used)) and sum(two) > small:
                shape[-1:] = two
            used = {}
            for n in shape:
                used[n] = used.get(n, 0) + 1
        bins = min(lengths.left[n] // k for n, k in used.items())
        lengths.take(used, bins)
        out.append((sorted(shape, reverse=True), bins))
    return out


def slots(shapes: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, copies of the length in a bin, its first offset) of each shape and length."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for shape, bins in shapes:
        offset = 0
        for n in dict.fromkeys(shape):
            k = shape.count(n)
            at = ranks.get(n, 0)
            out.append((n, at, k * bins, sequence, k, offset))
            ranks[n] = at + k * bins
            offset += n * k
        sequence += bins
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, path: str | None = None, in_order: bool = False, digest: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian uint32), sequence_id, offset.

    With digest, ids_crc32 stands in place of the ids, which then leave no task. With in_order, sequences follow the rows of docs: those of equal length are taken in their order, and sequences are
    numbered by the mean position of the ids they hold.
    """
    spark = docs.sparkSession
    place = [*_file_place(docs), F.monotonically_increasing_id()] if in_order else [F.lit(""), F.lit(0), F.lit(0)]
    place = [c.cast(k).alias(n) for c, k, n in zip(place, ("string", "bigint", "bigint"), ("_file", "_block", "_row"), strict=True)]
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *place)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    held, held_kind = ("ids_crc32", "bigint") if digest else ("ids", "binary")
    cut = narrow.mapInArrow(_pieces(path or vocabulary_path(), size, digest), f"doc_id {kind}, _file string, _block bigint, _row bigint, piece int, start bigint, length bigint, {held} {held_kind}")
    pieces = stage((cut if in_order else cut.drop("_file", "_block", "_row")).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    shapes = plan(counts, size)
    if in_order:
        ranked = global_rank(_positions(pieces), "length", F.struct("position", "piece"), "lengths")
        placed = _placed_in_order(ranked, shapes)
    else:
        places = spark.createDataFrame(slots(shapes), _SLOTS)
        placed = _placed(global_rank(pieces.select("uid", "length"), "length", F.xxhash64("uid"), "lengths"), places)
    out = pieces.join(placed, "uid")
    return out.select("doc_id", "piece", "start", "length", held, "sequence_id", "offset")


def _file_place(docs: DataFrame) -> list[Column]:
    """File and start of the split a row comes from. Rows of several sources have none: their partitions are in order."""
    place = [F.input_file_name(), F.input_file_block_start()]
    try:
        docs.select(*place)
    except AnalysisException:
        return [F.lit(""), F.lit(-1)]
    return place


def _positions(pieces: DataFrame) -> DataFrame:
    """uid, length, piece and position: the place of the piece's row among all rows that were read.

    Readers take the splits of files in any order, so runs of rows are put in the order of file names and split starts.
    """
    part = F.shiftright("_row", 33)
    keys = ("_file", "_block", "_part")
    runs = pieces.groupBy("_file", "_block", part.alias("_part")).agg(F.min("_row").alias("first"), F.max("_row").alias("last")).collect()  # a row a split
    table, at = [], 0
    for r in sorted(runs, key=lambda r: tuple(r[k] for k in keys)):
        table.append((*(r[k] for k in keys), r["first"], at))
        at += r["last"] - r["first"] + 1
    starts = pieces.sparkSession.createDataFrame(table, "_file string, _block bigint, _part bigint, first bigint, at bigint")
    joined = pieces.select("uid", "length", "piece", "_file", "_block", "_row", part.alias("_part")).join(F.broadcast(starts), list(keys))
    return joined.select("uid", "length", "piece", (F.col("at") + F.col("_row") - F.col("first")).alias("position"))


def _placed_in_order(ranked: DataFrame, shapes: list[tuple[list[int], int]]) -> DataFrame:
    """uid -> sequence_id, offset. A shape's bins are spread evenly over the order (those of rare shapes from places that
    differ), so a bin takes pieces of about one place of it from each length."""
    stripe, spark = 4096, ranked.sparkSession
    rows = [(*slot, bins, (i * 0.6180339887498949) % 1) for i, slot, bins in _numbered_slots(shapes)]
    table = spark.createDataFrame(rows, f"{_SLOTS}, bins bigint, phase double")
    cut = table.withColumn("from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1, F.lit(stripe).cast("bigint"))))
    cut = cut.repartition(shuffle_partitions(spark)).withColumn("j", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + stripe, "bins") - 1)))
    cut = cut.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("each") - 1)))
    each = cut.select("length", (F.col("sequence") + F.col("j")).alias("bin"), (F.col("base") + F.col("copy") * F.col("length")).alias("offset"), ((F.col("j") + F.col("phase")) / F.col("bins")).alias("time"))
    taken = global_rank(each, "length", F.struct("time", "bin", "offset"), "slots").select("length", "rank", "bin", "offset")
    held = stage(ranked.join(taken, ["length", "rank"]).select("uid", "length", "position", "bin", "offset"), "bins")
    means = held.groupBy("bin").agg((F.sum(F.col("position") * F.col("length")) / F.sum("length")).alias("mean"))
    numbered = global_rank(means.withColumn("all", F.lit(0)), "all", F.struct("mean", "bin"), "sequences").select("bin", F.col("rank").alias("sequence_id"))
    return held.join(numbered, "bin").select("uid", "sequence_id", "offset")


def _numbered_slots(shapes: list[tuple[list[int], int]]) -> list[tuple[int, tuple, int]]:
    """(number of the shape, slot, bins of the shape) of each slot."""
    numbers = [i for i, (shape, _) in enumerate(shapes) for _ in dict.fromkeys(shape)]
    return [(i, slot, shapes[i][1]) for i, slot in zip(numbers, slots(shapes), strict=True)]


def _placed(ranked: DataFrame, places: DataFrame) -> DataFrame:
    """uid -> sequence_id, offset. Slots cover rank intervals; both sides are cut into stripes of ranks for an equi-join."""
    stripe = 4096
    cut = places.withColumn("stripe", F.explode(F.sequence(F.floor(F.col("low") / stripe), F.floor((F.col("low") + F.col("ranks") - 1) / stripe))))
    cut = cut.withColumnRenamed("length", "l2").withColumnRenamed("stripe", "s2")
    at = ranked.withColumn("stripe", F.floor(F.col("rank") / stripe))
    joined = at.join(cut, (F.col("length") == F.col("l2")) & (F.col("stripe") == F.col("s2")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("ranks")))
    k = F.col("rank") - F.col("low")
    return joined.select("uid", (F.col("sequence") + F.floor(k / F.col("each"))).cast("bigint").alias("sequence_id"), (F.col("base") + (k % F.col("each")) * F.col("length")).cast("bigint").alias("offset"))


def packed_digests(docs: DataFrame, in_order: bool = False) -> DataFrame:
    """pack() with the checksum of each piece's ids in place of the ids."""
    return pack(docs, in_order=in_order, digest=True)
