"""Chat formatting by token-level assembly.

A turn becomes START role SEP text END. Role and text are encoded on their own, so no token spans a boundary, and the
three reserved ids, which no text can produce, are spliced between them. Their written forms (MARKS) are control strings;
where one occurs in a role or text it is escaped with a backslash, as is the backslash itself, so the written conversation
can be parsed back without loss. The loss mask is the prefix sum of +1 where an assistant's text begins and -1 where it
ends. Turns are encoded, and read back from their ids and masks, where they lie, so a conversation of any length is
encoded by many tasks. Its digests run over its turns in order: they alone are one task's stream, with a running hash in
the memory of one batch of turns, and only what was read back is shuffled.

Defined cases: a null text or role is empty; turns are ordered by turn (nulls first), then role, then text, and equal
rows are turns of their own; conv_id is of any type that can be ordered, and a null one is one conversation; an empty table
gives an empty result; texts of any length are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm.tokens import byte_bpe, vocabulary_path

#: The written forms of the reserved ids START, SEP and END.
MARKS = ("### ", ": ", " </turn>\n")
LOSS_ROLE = "assistant"
#: Control strings without the white space around them: what must not stand bare in a role or text.
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")


def escape(text: str, role: bool = False) -> str:
    return (_ROLE_CONTROL if role else _CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Formatter:
    def __init__(self, path: str | None = None):
        self.bpe = byte_bpe(path or vocabulary_path())
        first = self.bpe.size
        self.start, self.sep, self.end = first, first + 1, first + 2

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of a turn."""
        head, body = self.bpe.encode(escape(role, role=True), added=False), self.bpe.encode(escape(text), added=False)
        ids = np.concatenate([[self.start], head, [self.sep], body, [self.end]]).astype("<u4")
        change = np.zeros(len(ids) + 1, np.int8)
        if role == LOSS_ROLE:
            begin = len(head) + 2
            change[begin] += 1
            change[begin + len(body)] -= 1
        return ids, np.cumsum(change[:-1], dtype=np.int8).astype(np.uint8)

    def written(self, ids: np.ndarray) -> str:
        """The text that ids stand for, reserved ids in their written forms."""
        out, begin, marks = [], 0, {self.start: MARKS[0], self.sep: MARKS[1], self.end: MARKS[2]}
        for at in [*np.flatnonzero(ids >= self.start), len(ids)]:
            out.append(self.bpe.decode(ids[begin:at]))
            if at < len(ids):
                out.append(marks[int(ids[at])])
            begin = at + 1
        return "".join(out)

    def read(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """(role, text) of each turn in ids."""
        marks = np.flatnonzero(ids >= self.start)
        out = []
        for a, b, c in zip(marks[::3], marks[1::3], marks[2::3], strict=True):
            if (ids[a], ids[b], ids[c]) != (self.start, self.sep, self.end):
                raise ValueError("not a formatted turn")
            out.append((unescape(self.bpe.decode(ids[a + 1 : b])), unescape(self.bpe.decode(ids[b + 1 : c]))))
        return out

    def under_mask(self, ids: np.ndarray, mask: np.ndarray) -> str:
        """The text under the loss mask: each run of it decoded and unescaped, nothing between."""
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
        return "".join(unescape(self.bpe.decode(ids[a:b])) for a, b in zip(edges[::2], edges[1::2], strict=True))


def _format(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Formatter(path)
        for batch in batches:
            pairs = [f.turn(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            ids, masks = pa.array([i.tobytes() for i, _ in pairs], pa.binary()), pa.array([m.tobytes() for _, m in pairs], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role", "text")), ids, masks], names=["conv_id", "turn", "role", "text", "ids", "loss_mask"])

    return run


def format_turns(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, ids (little-endian uint32), loss_mask (one byte an id) of every turn. No rows move."""
    c = conversations.select("conv_id", "turn", "role", "text")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.schema)
    return c.mapInArrow(_format(path or vocabulary_path()), f"{kept}, ids binary, loss_mask binary")


def _read(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Formatter(path)
        for batch in batches:
            rows = []
            for ids, mask in zip(batch.column("ids").to_pylist(), batch.column("loss_mask").to_pylist(), strict=True):
                ids, mask = np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8)
                ((role, text),) = f.read(ids)
                loss = f.under_mask(ids, mask)
                if loss not in ("", text):
                    raise ValueError("a loss mask that ends inside a text")
                rows.append((role, text, loss != "", len(f.written(ids))))
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *columns], names=["conv_id", "turn", "role", "text", "in_loss", "chars"])

    return run


def read_turns(turns: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, in_loss and chars (of the written form) of every turn, read from its ids and mask."""
    t = turns.select("conv_id", "turn", "ids", "loss_mask")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema.fields[:2])
    return t.mapInArrow(_read(path or vocabulary_path()), f"{kept}, role string, text string, in_loss boolean, chars bigint")


def _digest(kind: pa.DataType):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = object(), None, []

        def close() -> None:
            if state is not None:
                done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for conv, role, text, in_loss, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "in_loss", "chars")), strict=True):
                if state is None or conv != current:
                    close()
                    current, state = conv, [0, sha256(), 0, sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if in_loss:
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += chars
            if len(done) > 5000:
                yield out()
                done = []
        close()
        if done:
            yield out()

    return run


def read_back(turns: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of each conversation, read from the ids and masks of its turns."""
    laid = read_turns(turns, path).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = turns.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return laid.drop("turn").mapInArrow(_digest(to_arrow_type(kind)), schema)
