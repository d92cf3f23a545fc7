"""Quality classifier: logistic regression on hashed word n-grams, learned by follow-the-regularised-leader updates.

Features of a text are its word n-grams (one and two words) and the n-grams of its words' shapes, hashed into 2**BITS
slots; one that makes up a share s of a text's n-grams has the value sqrt(s), so every text has length one. Learning uses labelled rows that aren't held out, at most TRAIN_ROWS of
them (those whose ids hash lowest; a fixed sample bound). Their features are made where the texts lie, and one task runs
the updates over them in a fixed order. The weights, 2**BITS numbers, are the only thing sent to all tasks; a score is the
sparse dot product of a text's slots with them.

Defined cases: null and empty texts have no features and score the bias alone; a text of any length is used whole; labels
that are null or belong to no document teach nothing; several labels of an id count as their maximum; without any usable
label all scores are 0.5; repeated rows are scored alike; a null id isn't held out and teaches nothing; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage

BITS = 18
TRAIN_ROWS = 8_000
ROUNDS = 8
#: Rate, its smoothing, and the penalties of the leader.
ALPHA, BETA, L1, L2 = 3.0, 1.0, 0.002, 0.01
#: A score of at least this is predicted as good.
THRESHOLD = 0.3

_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


class _Hashes(dict):
    """Word -> (hash of the word, hash of its shape); emptied when it has grown large."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > 500_000:
            self.clear()
        shape = _LETTERS.sub(lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a", _DIGITS.sub("0", word))
        value = self[word] = (xxhash.xxh3_64_intdigest(word.lower()), xxhash.xxh3_64_intdigest("\0" + shape))
        return value


_PAIR, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def slots(text: str, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct slots of a text's features, and their values."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    both = np.array([hashes[w] for w in words], np.uint64).T
    pairs = both[:, :-1] * _PAIR + both[:, 1:]
    at, times = np.unique((np.concatenate([both.ravel(), pairs.ravel()]) * _SPREAD) >> np.uint64(64 - BITS), return_counts=True)
    return at.astype(np.int64), np.sqrt(times / times.sum())


class FtrlProximal:
    """Follow-the-regularised-leader with per-coordinate rates; weights are made from the sums when they are needed."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, 1 << BITS), np.append(x, 1.0)  # the last slot is the bias
        w = self.weights(at)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = grown


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        rows = [slots(t or "", hashes) for t in batch.column("text").to_pylist()]
        coded = [pa.array([x.astype(kind).tobytes() for x in xs], pa.binary()) for xs, kind in (([a for a, _ in rows], "<i4"), ([v for _, v in rows], "<f4"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *coded], names=["doc_id", "quality", "slots", "shares"])


def _learn(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("doc_id", key=lambda ids: ids.map(lambda i: xxhash.xxh3_64_intdigest(str(i))), kind="stable")
    model = FtrlProximal()
    for _ in range(ROUNDS):
        for at, x, label in zip(rows["slots"], rows["shares"], rows["quality"], strict=True):
            model.update(np.frombuffer(at, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(np.float64), int(label))
    return pd.DataFrame({"weights": [model.weights().astype("<f4").tobytes()]})


def is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights (the last is the bias) from docs(doc_id, text) and labels(doc_id, quality)."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    sample = stage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS), "sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # TRAIN_ROWS rows at most
    kind = texts.schema["doc_id"].dataType.simpleString()
    coded = texts.select("doc_id", "quality", "text").mapInArrow(_features, f"doc_id {kind}, quality int, slots binary, shares binary")
    coded = coded.orderBy(F.xxhash64("doc_id"), F.xxhash64("slots"), F.xxhash64("shares")).limit(TRAIN_ROWS)  # ids may repeat
    found = coded.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(_learn, "weights binary").collect()
    return np.frombuffer(found[0]["weights"], "<f4") if found else np.zeros((1 << BITS) + 1, np.float32)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, w = _Hashes(), model.value
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                at, x = slots(text or "", hashes)
                out.append(float(w[-1]) + float(w[at] @ x))
            p = 1.0 / (1.0 + np.exp(-np.clip(np.array(out, np.float64), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text)."""
    w = train(docs, labels) if weights is None else weights
    model = docs.sparkSession.sparkContext.broadcast(w)
    d = docs.select("doc_id", "text")
    scored = d.mapInArrow(_score(model), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
