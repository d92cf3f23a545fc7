"""Byte-level BPE ids of whole texts, fast enough for corpora: chunks are encoded once a worker and looked up after that."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file lies on this machine (every machine of a cluster has it at its own place)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character: printable bytes as themselves, the others
    as the characters from 256 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Chunks(dict):
    """Chunk -> its ids as bytes; emptied when it has grown to LIMIT entries."""

    LIMIT = 800_000

    def __init__(self, core):
        self._any, self._one = core._core_bpe.encode_ordinary, core._core_bpe.encode_single_piece

    def __missing__(self, key: str) -> bytes:
        word = key[1:] if key[:1] == " " else key
        if word.isalpha():  # one piece of the vocabulary's splitting: no pattern is needed
            ids = array("I", self._one(key.encode())).tobytes()
        elif word[-1:] in {",", "."} and word[:-1].isalpha():  # a word and one sign: two pieces
            return self[key[:-1]] + self[key[-1]]
        else:
            ids = array("I", self._any(key)).tobytes()
        if len(key) < 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[key] = ids
        return ids


class ByteBpe:
    """encode(text) -> uint32 ids, equal to those of the tokenizers library with add_special_tokens=False.

    The vocabulary's added tokens that stand in a text are one id each, as in that library, unless `added` is False, which
    encodes their characters like any others (the library's encode_special_tokens).

    A text is cut where one space stands between two characters that aren't white space. The vocabulary's splitting never
    joins text across such a place except to put the space before the next word, so a chunk's ids don't depend on what
    is around it, and a table of chunks already seen answers most of a text.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_of_symbol()
        self._added = {t["content"]: np.uint32(t["id"]).tobytes() for t in spec.get("added_tokens", [])}
        self._names = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        special = set(self._names)
        ranks = {bytes(to_byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if i not in special}
        #: Ids from here on are free.
        self.size = max([*ranks.values(), *special]) + 1
        self._core = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._chunks = _Chunks(self._core)
        #: Spaces beside other white space: such a text is cut with more care.
        self._beside = re.compile(r"\s \S|\S \s| \Z|\A ")
        self._places = re.compile(r"(?<=\S)(?= \S)")
        self._at_added = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if self._added else None

    def encode(self, text: str, added: bool = True) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text, added), "<u4")

    def encode_bytes(self, text: str, added: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if added and any(name in text for name in self._added):
            return b"".join(self._added.get(part) or self.encode_bytes(part, False) for part in self._at_added.split(text))
        if "\0" in text or self._beside.search(text):
            parts = self._places.split(text)
        else:
            parts = text.replace(" ", "\0 ").split("\0")
        return b"".join(map(self._chunks.__getitem__, parts))

    def decode(self, ids) -> str:
        ids = [int(i) for i in ids]
        if not self._names.keys() & set(ids):
            return self._core.decode_bytes(ids).decode("utf-8", errors="surrogatepass")
        return b"".join(self._names.get(i) or self._core.decode_bytes([i]) for i in ids).decode("utf-8", errors="surrogatepass")


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
