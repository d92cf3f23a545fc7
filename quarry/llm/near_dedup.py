"""MinHash near-duplicates by a signature-coordinate inverted join.

1. A text's set is its distinct word shingles (64-bit hashes); its signature has K coordinates. Texts with equal sets
   form a class; only the class's smallest id goes on.
2. A class is posted under each (coordinate, value) pair and size band. Sets of similarity 0.8 differ in size by a factor
   of 1.25 at most, so with bands of that width each class is posted in its own band and the next one, and meets all it
   could be alike to; texts of unlike length that share common shingles don't meet. Pairs of one posting join nothing
   and drop out. Of the others only the rarest are needed: two classes with T equal coordinates share one of the K - T + 1 rarest of either
   (prefix merging); a class with fewer than T shared coordinates can't match at all.
3. Each posting list elects the member whose coordinates are shared most. All members are compared with it alone; the
   confirmed links are contracted to components. This settles a group of copies in linear work.
4. Lists whose members are still in several components are merged in blocks: collisions of two members of different
   components are counted over all coordinates, and pairs below T, of one component, or of unlike sizes are skipped. So
   are pairs that a finer sketch (one-permutation hashing, BINS bytes) puts five deviations below the similarity asked
   for, and pairs that meet in an earlier list. Members that are left with a pair go on: no pair leaves a task, so rows
   grow with the members of a list and not with its pairs.
5. Links are confirmed on the full shingle sets, 100 * intersection >= 80 * union: those of step 3 in a stream of members
   beside their head, those of step 4 in blocks that hold the texts of the members left, most similar pairs first. A pair
   whose components have been joined is skipped, so a block returns fewer links than it has components.

With K = 32 and T = 15 a pair of similarity 0.8 is missed with probability 1e-5, one of 0.9 with less than 1e-9.

Words are runs of characters outside [\\x20\\x09-\\x0D], A-Z lower-cased. Defined cases: a null or empty text has no set,
n_shingles 0 and no links; with fewer words than a shingle the whole sequence is one; rows with the same id are one node that has the links of all
of them; ids are of any type that can be ordered, and a row without one belongs to the class of its text but links nothing itself; texts of any length are used whole; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import by_ids, hot, salted, salts, shuffle_partitions, stage, unstage, with_rows, with_salts
from quarry.llm.components import components

K, T = 32, 15
#: Similarity of a link, in hundredths; words in a shingle, where a caller names no other number.
PERCENT, SHINGLE = 80, 5
#: Ratio of the sizes at the ends of a band; a little more than 1 / 0.8, so rounding can't part two sets that may be alike.
BAND = 1.2501
#: A posting's number: the band above bit 40, the coordinate above bit 32, the value below.
_BAND_BIT, _COORDINATE = 40, 0xFF
#: Members of a posting list that one task compares with each other at a time, if their sets hold SHINGLES in all at most.
BLOCK, SHINGLES = 2_048, 4_000_000
#: Bins of the sketch, a byte each; its slack is SLACK standard deviations of its estimate, so no link is lost to it.
BINS, SLACK = 512, 5.0

_MUL = np.random.default_rng(20240501).integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(20240502).integers(1, 1 << 63, K, dtype=np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hash of each word; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes, words: _Words, shingle: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    ws = text.lower().split()  # of bytes: lower() changes A-Z alone, split() parts at [\x20\x09-\x0D]
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws))
    k = min(shingle, len(h))
    n = len(h) - k + 1
    x = h[:n] + np.uint64(k)
    for i in range(1, k):
        x = _mix(x) + h[i : n + i]
    return np.unique(_mix(x))


def signature(hashes: np.ndarray) -> np.ndarray:
    """K coordinates, each as one number that also names the coordinate: coordinate * 2**32 + smallest value."""
    best = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096]
        best = np.minimum(best, _mix(part[None, :] * _MUL[:, None] + _ADD[:, None]).min(axis=1))
    return (np.arange(K, dtype=np.int64) << 32) | (best >> np.uint64(32)).astype(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One byte a bin: of the smallest hash in it, or 0 for an empty bin."""
    v = np.sort(_mix(hashes ^ _ADD[0]))
    bins = (v >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(BINS, np.uint8)
    out[bins[first]] = (1 + (v[first] >> np.uint64(8)) % np.uint64(255)).astype(np.uint8)
    return out


def _features(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sizes, prints, tokens, sketches = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                s = shingle_set(text or b"", words, shingle)
                sizes.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                tokens.append(signature(s) if len(s) else None)
                sketches.append(sketch(s).tobytes() if len(s) else None)
            columns = [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(tokens, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "print", "tokens", "sketch"])

    return run


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sorted distinct arrays is PERCENT hundredths at least."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < PERCENT * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _confirm(shingle: int):
    """Rows sorted by (head, salt, member): a head's texts come first and the texts to compare with them follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, key, firsts = _Words(), None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("head", "salt", "id", "member")]
            keep = []
            rows = zip(*(c.to_pylist() for c in columns[:2]), columns[3].to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)
            for head, salt, member, text in rows:
                own = shingle_set(text or b"", words, shingle)
                if not member:
                    if (head, salt) != key:
                        key, firsts = (head, salt), []
                    if not any(np.array_equal(own, f) for f in firsts):  # an id may stand on rows of different texts
                        firsts.append(own)
                keep.append(member and (head, salt) == key and any(alike(f, own) for f in firsts))
            out = pa.RecordBatch.from_arrays([columns[0], columns[2]], names=["a", "b"])
            yield out.filter(pa.array(keep, pa.bool_()))

    return run


class _Block:
    """Members of a posting list's blocks i and j, and the pairs of them that may be linked (step 4)."""

    #: Members of block i that are held against all of block j at a time, and pairs whose sketches are.
    ROWS, PAIRS = 96, 8_192

    def __init__(self, rows: pa.Table, token: int, i: int, j: int):
        rows = rows.combine_chunks()
        m = rows.num_rows
        self.comp = rows.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
        self.n, self.side = (rows.column(c).to_numpy() for c in ("n", "side"))
        #: A row for each coordinate. The values are whole: which list has a pair is decided on them, so two values must never look equal.
        self.values = np.ascontiguousarray(rows.column("grid").combine_chunks().flatten().to_numpy().reshape(m, K).T)
        self.prefix = ((rows.column("mask").to_numpy()[None, :] >> np.arange(K)[:, None]) & 1).astype(bool)
        self.sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(m, BINS)
        self.full = np.packbits(self.sketch > 0, axis=1).view(np.uint64)
        self.coordinate, self.i, self.j = (token >> 32) & _COORDINATE, i, j
        #: Two members of the band below have met there.
        self.below = np.floor(np.log(self.n) / np.log(BAND)) < token >> _BAND_BIT

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of both members and the sketches' similarity, of pairs of different components that may be alike."""
        xs, ys = np.flatnonzero(self.side == self.i), np.flatnonzero(self.side == self.j)
        main = np.bincount(self.comp[ys]).argmax() if len(ys) else -1
        if self.i == self.j:  # one member of a pair at least is outside the largest component
            xs = xs[self.comp[xs] != main]
        found = [self._close(*self._collisions(xs[at : at + self.ROWS], ys, main)) for at in range(0, len(xs), self.ROWS)]
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind) for k, kind in enumerate((np.int64, np.int64, np.float64)))

    def _collisions(self, xs: np.ndarray, ys: np.ndarray, main: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs with T equal coordinates that meet in no list of a lower coordinate."""
        small, large = np.minimum.outer(self.n[xs], self.n[ys]), np.maximum.outer(self.n[xs], self.n[ys])
        open_ = (self.comp[xs][:, None] != self.comp[ys]) & (100 * small >= PERCENT * large) & ~(self.below[xs][:, None] & self.below[ys])
        if self.i == self.j:
            open_ &= (self.comp[ys] == main) | (ys > xs[:, None])
        # Members of neither side that have no open pair are left out before coordinates are compared.
        xs, ys, open_ = xs[open_.any(axis=1)], ys[open_.any(axis=0)], open_[np.ix_(open_.any(axis=1), open_.any(axis=0))]
        equal = np.zeros(open_.shape, np.uint8)
        for k in range(K):
            same = self.values[k, xs][:, None] == self.values[k, ys]
            equal += same
            if k < self.coordinate:  # of the lists in which a pair meets, that of the lowest coordinate has it
                open_ &= ~(same & self.prefix[k, xs][:, None] & self.prefix[k, ys])
        x, y = np.nonzero(open_ & (equal >= T))
        return xs[x], ys[y]

    def _close(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs whose sketches allow a similarity of PERCENT. Bins sample the union without replacement."""
        filled, equal = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for at in range(0, len(x), self.PAIRS):
            part = slice(at, at + self.PAIRS)
            filled[part] = np.bitwise_count(self.full[x[part]] | self.full[y[part]]).sum(axis=1)
            same = np.packbits(self.sketch[x[part]] == self.sketch[y[part]], axis=1).view(np.uint64)
            equal[part] = np.bitwise_count(same).sum(axis=1) - (BINS - filled[part])  # bins that are empty in both are equal too
        s = PERCENT / 100
        union = (self.n[x] + self.n[y]) / (1 + s)
        deviation = np.sqrt(s * (1 - s) / filled * np.maximum(1 - filled / union, 0.02))
        keep = equal / filled >= s - SLACK * deviation - 0.01
        return x[keep], y[keep], (equal / filled)[keep]

    def links(self, texts: list[bytes], words: _Words, shingle: int) -> list[tuple[int, int]]:
        """Places of confirmed pairs that join all components of the block which links join."""
        x, y, similar = self.pairs()
        sets: dict[int, np.ndarray] = {}
        root = list(range(int(self.comp.max()) + 1))

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        def full(at: int) -> np.ndarray:
            if at not in sets:
                sets[at] = shingle_set(texts[at], words, shingle)
            return sets[at]

        out = []
        for p in np.argsort(-similar, kind="stable").tolist():
            a, b = int(x[p]), int(y[p])
            one, two = find(int(self.comp[a])), find(int(self.comp[b]))
            if one != two and alike(full(a), full(b)):
                root[one] = two
                out.append((a, b))
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int, int, int]]:
    """(rows, token, i, j) of each block of rows sorted by (token, i, j); one is in memory at a time."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("token", "i", "j")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            own = tuple(keys[a].tolist())
            if own != key and held:
                yield pa.Table.from_batches(held), *key
                held = []
            held.append(batch.slice(a, b - a))
            key = own
    if held:
        yield pa.Table.from_batches(held), *key


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each block that have a pair left."""
    for rows, *key in _blocks(batches):
        x, y, _ = _Block(rows, *key).pairs()
        if len(x):
            yield from rows.take(np.union1d(x, y)).combine_chunks().to_batches()


def _joined(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for rows, *key in _blocks(batches):
            texts = [t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()]
            if found := _Block(rows, *key).links(texts, words, shingle):
                ids = rows.column("id").combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(side)) for side in zip(*found, strict=True)], names=["a", "b"])

    return run


def classes(feats: DataFrame) -> DataFrame:
    """features -> (id, n, rep) of every row: rep is the smallest id with the same set."""
    reps = feats.where("n > 0").groupBy("print").agg(F.min("id").alias("rep"))
    return feats.select("id", "n", "print").join(reps, "print", "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))


def postings(members: DataFrame) -> DataFrame:
    """members(id, n, tokens) -> candidates (id, band, prefix, mask, shared), one row for each band: see step 2.

    mask has a bit for each coordinate in the prefix.
    """
    own = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))).cast("bigint")
    banded = members.withColumn("band", F.explode(F.array(own, own + 1)))
    one = banded.select("id", F.explode(F.transform("tokens", lambda t: t + F.shiftleft(F.col("band"), _BAND_BIT))).alias("token"))
    often = one.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    band = F.shiftright("token", _BAND_BIT).alias("band")
    joined = one.join(often, "token").groupBy("id", band).agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t")).where(F.size("t") >= T)
    prefix = F.slice(F.transform("t", lambda x: x["token"]), 1, F.size("t") - (T - 1))
    shared = F.aggregate("t", F.lit(0).cast("bigint"), lambda a, x: a + x["df"])
    held = joined.select("id", "band", prefix.alias("prefix"), shared.alias("shared"))
    return held.withColumn("mask", F.expr(f"aggregate(prefix, 0L, (a, t) -> a | shiftleft(1L, CAST(shiftright(t, 32) & {_COORDINATE} AS INT)))"))


def confirmed(docs: DataFrame, pairs: DataFrame, heavy: DataFrame, shingle: int) -> DataFrame:
    """The pairs (head, id) whose full sets are alike. Each text moves once for each head it is compared with.

    A head with many members is salted: its text goes to as many groups as bound the members of one by GROUP, and a task
    streams over sorted rows with one head's sets in memory.
    """
    kind = docs.schema["id"].dataType.simpleString()
    members = with_salts(pairs, "head", heavy).select("id", "head", salted("id").alias("salt"), F.lit(True).alias("member"))
    heads = with_salts(pairs.select("head").distinct(), "head", heavy).select(F.col("head").alias("id"), "head", salts().alias("salt"), F.lit(False).alias("member"))
    work = stage(members.unionByName(heads), "work")
    joined = with_rows(docs, "id", work).repartition("head", "salt").sortWithinPartitions("head", "salt", "member")
    out = stage(joined.select("head", "salt", "id", "member", "text").mapInArrow(_confirm(shingle), f"a {kind}, b {kind}"), "links")
    unstage(work)
    return out


def stars(found: DataFrame, base: DataFrame) -> DataFrame:
    """(head, id): each member of a posting list with the one whose coordinates are shared most (step 3), if they collide often enough."""
    posted = found.select("id", "shared", F.explode("prefix").alias("token"))
    heads = posted.groupBy("token").agg(F.min(F.struct((-F.col("shared")).alias("s"), F.col("id").alias("i"))).alias("head")).select("token", F.col("head.i").alias("head"))
    met = stage(posted.join(heads, "token").where("id != head").select("id", "head").distinct(), "met")
    heavy = hot(met, "head")
    one = base.select("id", "n", "tokens")
    other = with_salts(base.join(met.select(F.col("head").alias("id")).distinct(), "id", "left_semi").withColumnRenamed("id", "head"), "head", heavy)
    other = other.select("head", salts().alias("salt"), F.col("n").alias("n2"), F.col("tokens").alias("tokens2"))
    both = with_salts(met, "head", heavy).select("id", "head", salted("id").alias("salt")).join(one, "id").join(other, ["head", "salt"])
    sized = 100 * F.least("n", "n2") >= PERCENT * F.greatest("n", "n2")
    out = stage(both.where(sized & (F.size(F.array_intersect("tokens", "tokens2")) >= T)).select("head", "id").distinct(), "stars")
    unstage(met, heavy)
    return out


def open_entries(found: DataFrame, comps: DataFrame) -> DataFrame:
    """(id, comp, mask, token, side, i, j): the members of lists with several components, in the blocks they go to.

    Members of a list's largest component are not compared with each other, so they have blocks of their own, which meet
    those of the other members only.
    """
    labelled = found.join(comps.withColumnRenamed("node", "id"), "id", "left").select("id", "mask", "prefix", F.coalesce("component", "id").alias("comp"))
    spread = labelled.select("id", "comp", "mask", F.explode("prefix").alias("token"))
    held = spread.groupBy("token", "comp").agg(F.count("*").alias("n"))
    lists = held.groupBy("token").agg(F.sum("n").alias("df"), F.max(F.struct("n", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    block = F.greatest(F.lit(16), F.least(F.lit(BLOCK), F.floor(SHINGLES / F.pow(F.lit(BAND), F.shiftright("token", _BAND_BIT)))))
    alone = F.col("df") <= block
    lists = lists.select(
        "token",
        F.when(~alone, F.col("main.comp")).alias("main"),
        F.when(alone, 0).otherwise(F.ceil(F.col("main.n") / block)).cast("int").alias("mains"),
        F.when(alone, 1).otherwise(F.ceil((F.col("df") - F.col("main.n")) / block)).cast("int").alias("others"),
    )
    work, hashed = spread.join(lists, "token"), F.xxhash64("id")
    in_main = F.coalesce(F.col("comp") == F.col("main"), F.lit(False))
    work = work.withColumn("side", F.when(in_main, F.pmod(hashed, F.greatest("mains", F.lit(1)))).otherwise(F.col("mains") + F.pmod(hashed, F.col("others"))).cast("int"))
    work = work.withColumn("other", F.explode(F.sequence(F.when(in_main, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1)))
    return work.select("id", "comp", "mask", "token", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))


def links(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """Confirmed links (a, b) between class representatives; enough of them to connect all that are connected."""
    spark, kind = docs.sparkSession, docs.schema["id"].dataType
    found = stage(postings(members.select("id", "n", "tokens")), "candidates")
    base = by_ids(members, "id", found.select("id").distinct(), "left_semi")
    pairs = stars(found, base)
    heavy = hot(pairs, "head")
    first = confirmed(docs, pairs, heavy, shingle)
    unstage(pairs, heavy)
    comps = stage(components(first), "contracted")
    unstage(first)

    entries = stage(open_entries(found, comps), "entries")
    unstage(found)
    own = by_ids(members, "id", entries.select("id").distinct(), "left_semi").select("id", "n", F.expr("transform(tokens, t -> CAST((t & 4294967295L) - 2147483648L AS INT))").alias("grid"), "sketch")
    keys, n = ("token", "i", "j"), shuffle_partitions(spark)
    laid = entries.join(own, "id").repartition(n, *keys).sortWithinPartitions(*keys)
    left = stage(laid.mapInArrow(_left, laid.schema), "left")
    unstage(entries)
    texts = by_ids(docs, "id", left.select("id").distinct(), "left_semi").select("id", "text")
    beside = left.join(texts, "id").repartition(n, *keys).sortWithinPartitions(*keys)
    second = stage(beside.mapInArrow(_joined(shingle), f"a {kind.simpleString()}, b {kind.simpleString()}"), "links")
    unstage(left)
    return comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second)


def id_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) of the classes in which one id stands."""
    several = rows.where("n > 0").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a != z").select("id", "a")
    return rows.where("n > 0").join(several, "id").select("a", F.col("rep").alias("b"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable over links), kept."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    feats = stage(narrow.mapInArrow(_features(shingle), f"id {kind}, n bigint, print binary, tokens array<bigint>, sketch binary"), "features")
    rows = stage(classes(feats), "classes")
    members = by_ids(feats.select("id", "n", "tokens", "sketch").where("n > 0"), "id", rows.where("id = rep AND n > 0").select("id").distinct(), "left_semi")
    found = components(links(narrow, members, shingle).unionByName(id_links(rows)))
    unstage(feats)
    out = rows.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    comp = F.coalesce("component", "rep")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all their columns."""
    lost = stage(near_dedup(docs, id_col, text_col, shingle).where("NOT kept").select("doc_id"), "lost").withColumnRenamed("doc_id", id_col)
    return by_ids(docs, id_col, lost, "left_anti").select(*[f"`{c}`" for c in docs.columns])
