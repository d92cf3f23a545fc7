"""Exact deduplication by exchanging Golomb-coded fingerprints.

1. Every scan task splits its rows into parts (Arrow batches), fingerprints the normalised texts and writes rows and
   fingerprints to a table bucketed by part. The first row of a part also carries the part's sorted distinct 40-bit
   fingerprints, cut by owner (a range of fingerprints) and Golomb-Rice-coded.
2. Owners get only those codes, find fingerprints that several parts hold, and return one bitmap per part.
3. Bitmaps meet the bucketed rows of their part without moving the rows. Rows that are not marked are unique. Marked rows
   (suspects) are grouped by their whole normalised text, so equality is decided on bytes, never on a fingerprint.

A hot text moves once per task (partial aggregation), owners see it once per part, and texts of unique rows never move.
The rows of a large group meet its size and keeper in as many tasks as bound the rows of one by GROUP.

Defined cases: ids are of any type that can be ordered; a null text counts as empty; empty texts are equal to each other; a null id sorts last among equals;
repeated rows (same id and text) are copies of each other of which one is kept; an empty table gives an empty result;
other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.common import GROUP, drop_at_end, new_path, salted, salts, shuffle_partitions, stage, with_salts

#: The characters deleted before texts are compared.
SPACE = bytes([0x20, *range(0x09, 0x0E)])
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
#: Bits of a fingerprint: parts of 10^4 rows cost about 29 bits a row; collisions only add suspects.
BITS = 40
#: Bytes of input whose fingerprints one owner holds (some millions, 8 bytes each).
OWNED = 16 << 30


def golomb_encode(values: np.ndarray, bits: int) -> bytes:
    """Sorted distinct uint64 values below 2**bits as Golomb-Rice-coded gaps.

    A header holds their count, the parameter and the bytes of the unary parts (zeros and a one for each gap), which come
    before the low bits of all gaps, so both are read without a loop.
    """
    n = len(values)
    if n == 0:
        return b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, int(np.floor(np.log2(max(1.0, (1 << bits) / n * np.log(2))))))
    high, low = (gaps >> np.uint64(k)).astype(np.int64), gaps & np.uint64((1 << k) - 1)
    stops = np.cumsum(high + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1, np.uint8)
    unary[stops] = 1
    unary = np.packbits(unary).tobytes()
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    lows = np.packbits(((low[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)).tobytes()
    return n.to_bytes(4, "little") + bytes([k]) + len(unary).to_bytes(4, "little") + unary + lows


def golomb_decode(code: bytes) -> np.ndarray:
    if not code:
        return np.zeros(0, np.uint64)
    n, k, size = int.from_bytes(code[:4], "little"), code[4], int.from_bytes(code[5:9], "little")
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, size, 9)))
    gaps = (np.diff(stops, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        low = np.unpackbits(np.frombuffer(code, np.uint8, offset=9 + size))[: n * k].reshape(n, k).astype(np.uint64)
        gaps |= (low << np.arange(k - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def owners_of(docs: DataFrame) -> int:
    """Owners: as many as there are shuffle partitions, and one for OWNED bytes of input at least."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size if size < 1 << 60 else 0  # rows that don't come from files have no size
    return max(shuffle_partitions(docs.sparkSession), -(-known // OWNED))


def _fingerprinted(owners: int):
    """Scan side: see the module's text, step 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row, part = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            digests = [sha256(t.translate(None, SPACE)).digest() for t in texts]
            head = np.frombuffer(b"".join(digests), ">u8").reshape(n, 4)[:, 0].astype(np.uint64)
            prints = head >> np.uint64(64 - BITS)
            distinct, place, times = np.unique(prints, return_inverse=True, return_counts=True)
            owner = ((distinct.astype(np.float64) / float(1 << BITS)) * owners).astype(np.int64)
            first = np.searchsorted(owner, np.arange(owners + 1))
            codes = [{"owner": o, "code": golomb_encode(distinct[a:b], BITS)} for o, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)) if b > a]
            ids = np.arange(row, row + n, dtype=np.int64) + (task << 40)
            extra = {
                "_part": pa.array(np.full(n, (task << 20) + part, np.int64)),
                "_uid": pa.array(ids),
                "_sha": pa.array(digests, pa.binary()),
                "_owner": pa.array(owner[place].astype(np.int32)),
                "_pos": pa.array((place - first[owner[place]]).astype(np.int32)),
                "_twice": pa.array(times[place] > 1),
                "_codes": pa.array([codes] + [None] * (n - 1), pa.list_(pa.struct([("owner", pa.int32()), ("code", pa.binary())]))),
            }
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], names=[*batch.schema.names, *extra])
            row, part = row + n, part + 1

    return run


def _owner_bitmaps(rows: pd.DataFrame) -> pd.DataFrame:
    """Owner side: which of each part's fingerprints do other parts hold too, as one bit each, in the sorted order."""
    lists = [golomb_decode(c) for c in rows["code"]]
    values, times = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[times > 1]
    out = []
    for part, owner, own in zip(rows["_part"], rows["owner"], lists, strict=True):
        hit = np.isin(own, shared, assume_unique=True)
        if hit.any():
            out.append((part, owner, np.packbits(hit).tobytes()))
    return pd.DataFrame(out, columns=["_part", "_owner", "bitmap"])


class _Marked:
    """The bucketed rows with their suspect bit, and the groups of the suspects."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, rest: bool):
        spark = docs.sparkSession
        owners = owners_of(docs)
        others = [c for c in docs.columns if c not in (id_col, text_col)] if rest else []
        raw = docs.select(
            F.col(f"`{id_col}`").alias("_id"),
            F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"),
            F.col(f"`{text_col}`").isNull().alias("_null"),
            F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0).alias("_")]).alias("_rest"),
        ).withColumn("_n", F.length("_text"))
        added = "_part bigint, _uid bigint, _sha binary, _owner int, _pos int, _twice boolean, _codes array<struct<owner:int,code:binary>>"
        full = StructType([*raw.schema.fields, *StructType.fromDDL(added).fields])
        path, name = new_path(spark, "prints"), f"quarry_prints_{new_path(spark, 'x')[-32:]}"
        raw.mapInArrow(_fingerprinted(owners), full).write.option("compression", "zstd").option("path", path).bucketBy(shuffle_partitions(spark), "_part").saveAsTable(name)
        drop_at_end(spark, name)
        self.rows = spark.table(name)
        codes = self.rows.where(F.col("_codes").isNotNull()).select("_part", F.inline("_codes"))
        bitmaps = codes.groupBy("owner").applyInPandas(_owner_bitmaps, "_part bigint, _owner int, bitmap binary")
        self.bitmaps = stage(bitmaps, "bitmaps").groupBy("_part").agg(F.map_from_entries(F.collect_list(F.struct("_owner", "bitmap"))).alias("_maps"))
        self.others, self.id_col, self.text_col = others, id_col, text_col

    def rows_marked(self, *cols: str) -> DataFrame:
        """Rows with `_suspect`. Only the bitmaps are exchanged: the rows are read in the buckets they were written in."""
        bit = F.element_at("_maps", F.col("_owner"))
        byte = F.conv(F.hex(F.substring(bit, F.floor(F.col("_pos") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
        hit = F.coalesce(F.getbit(byte, F.lit(7) - F.col("_pos") % 8) == 1, F.lit(False))
        held = self.rows.select("_part", "_owner", "_pos", "_twice", *cols)
        return held.join(self.bitmaps.hint("shuffle_hash"), "_part", "left").select(*cols, (F.col("_twice") | hit).alias("_suspect"))

    def groups(self) -> DataFrame:
        """Suspects by their whole normalised text: _sha, _size, _keep_id and _keep_uid (of the row that stays), written."""
        suspects = self.rows_marked("_id", "_uid", "_sha", "_n", "_text").where("_suspect")
        best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("no"), F.col("_id").alias("i"), F.col("_uid").alias("u")))
        by_text = suspects.groupBy("_sha", F.regexp_replace("_text", SPACE_PATTERN, "").alias("_norm")).agg(F.count("*").alias("_size"), best.alias("_best"))
        return stage(by_text.select("_sha", "_size", F.col("_best.i").alias("_keep_id"), F.col("_best.u").alias("_keep_uid")), "groups")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (see the module's text)."""
    marked = _Marked(docs, id_col, text_col, rest=False)
    rows = marked.rows_marked("_id", "_uid", "_sha")
    sha = F.lower(F.hex("_sha")).alias("text_sha256")
    alone = rows.where(~F.col("_suspect")).select(F.col("_id").alias("doc_id"), F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), sha)
    groups = marked.groups()
    heavy = groups.where(F.col("_size") > GROUP).select("_sha", F.ceil(F.col("_size") / GROUP).cast("int").alias("salts"))
    copies = (
        with_salts(rows.where("_suspect"), "_sha", heavy)
        .withColumn("_salt", salted("_uid"))
        .join(with_salts(groups, "_sha", heavy).withColumn("_salt", salts()), ["_sha", "_salt"])
        .select(F.col("_id").alias("doc_id"), F.col("_keep_id").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_uid") == F.col("_keep_uid")).alias("kept"), sha)
    )
    return alone.unionByName(copies)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    marked = _Marked(docs, id_col, text_col, rest=True)
    cols = ["_id", "_uid", "_text", "_null", "_rest"]
    rows = marked.rows_marked(*cols)
    keepers = marked.groups().select(F.col("_keep_uid").alias("_uid"))
    kept = rows.where(~F.col("_suspect")).select(*cols).unionByName(rows.where("_suspect").select(*cols).join(keepers, "_uid", "left_semi").select(*cols))
    source = {id_col: F.col("_id"), text_col: F.when(~F.col("_null"), F.col("_text"))} | {c: F.col("_rest").getField(c) for c in marked.others}
    return kept.select(*[source[c].alias(c) for c in docs.columns])
