"""Operators on documents against plain versions, with odd rows of every kind."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import exact_dedup as X
from quarry.llm import license_scan as L
from quarry.llm import mixing as M
from quarry.llm import near_dedup as N
from quarry.llm import packing as P
from quarry.llm import quality_classifier as C
from quarry.llm import quality_rules as Q
from quarry.llm.components import components
from quarry.llm.tokens import byte_bpe, vocabulary_path

#: Columns whose names operators might use themselves.
CLASHING = ["_id", "rank", "text_sha256", "_row", "_uid", "id", "token", "kept", "_q"]


def odd_rows():
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 6)))
    base = [" ".join(word() for _ in range(r.randint(3, 90))) for _ in range(40)]
    rows = []
    for i, t in enumerate(base):
        ws = t.split()
        rows += [t, t.replace(" ", "\n\t", 1), t.upper()]
        rows.append(" ".join(ws[:-1] + [word()]))
        rows.append(" ".join(w if r.random() > 0.05 else word() for w in ws))
        if i < 5:
            rows += [f"{t} end {k}" for k in range(12)]
    rows += [None, "", " ", "\n\x0b\x0c\r", "one", "one", "One", "one two", "x" * 200_000, " ".join(["again"] * 30_000), "tab\tvs space", "tab vs\nspace"]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}", None if i % 11 == 0 else "en", *[i] * len(CLASHING)) for i, t in enumerate(odd_rows())]
    rows += rows[:2]  # repeated rows
    schema = "doc_id long, text string, source string, lang string, " + ", ".join(f"`{c}` long" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


# -- exact dedup --------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.sets(st.integers(0, 2**40 - 1), max_size=300))
def test_golomb_round_trip(values):
    v = np.array(sorted(values), np.uint64)
    assert (X.golomb_decode(X.golomb_encode(v, 40)) == v).all()


def test_exact_dedup(docs, empty):
    got = X.exact_dedup(docs).collect()
    groups = defaultdict(list)
    for i, t in rows_of(docs):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    want = []
    for norm, members in groups.items():
        keep = min(members)[1]
        want += [(i, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for _, i in members]
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(want)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept) and len(kept) == len(groups)  # of repeated rows one is kept
    assert X.exact_dedup(empty).collect() == []


def test_exact_dedup_of_large_groups_and_text_ids(spark, monkeypatch):
    """A group of more rows than one task gets; ids that are text."""
    monkeypatch.setattr(X, "GROUP", 10)
    rows = [(f"k{i:03}", "same text" + " " * (i % 4)) for i in range(95)] + [("z", "other"), (None, "same  text"), ("y", None)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in X.exact_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert len(got) == 98 and got["z"] == ("z", 1, True) and got["y"] == ("y", 1, True)
    assert all(got[i] == ("k003", 96, i == "k003") for i, _ in rows if i not in ("z", "y"))


def test_drop_copies_keeps_columns(docs, empty):
    out = X.drop_copies(docs)
    assert out.columns == docs.columns and out.count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows_of(docs)})
    first = {r.doc_id: tuple(r) for r in docs.collect()}
    assert all(first[r.doc_id] == tuple(r) for r in out.collect())
    assert X.drop_copies(empty).count() == 0


# -- near-duplicates ----------------------------------------------------------------------------------------------------


def brute_components(rows, k):
    sets = {}
    for i, t in rows:
        ws = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.setdefault(i, set()).update(tuple(ws[j : j + k]) for j in range(max(1, len(ws) - k + 1)) if ws)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup(docs, empty, k):
    got = N.near_dedup(docs, shingle=k).collect()
    want = brute_components(rows_of(docs), k)
    assert len(got) == docs.count()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, n, c) for i, (n, c) in want.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert N.near_dedup(empty, shingle=k).collect() == []


def test_near_dedup_without_a_hub(spark):
    """A chain: neighbours are alike, the ends are not, and a posting list's head links few of its members."""
    words = [f"w{i}" for i in range(600)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 100])) for i in range(60)]
    rows += [(100 + i, " ".join(words[:50] + [f"v{i}_{j}" for j in range(50)])) for i in range(40)]  # a shared passage, not alike
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_dedup(docs, shingle=2).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 2).items()} and got[59] == 0 and got[120] == 120


def block_rows(sets, comps, masks=None, side=0):
    """Entries of a posting list, as the merge reads them."""
    grids = [(N.signature(s) & 0xFFFFFFFF) - (1 << 31) for s in sets]
    return pa.table({
        "id": pa.array(range(len(sets)), pa.int64()), "comp": pa.array(comps, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()),
        "mask": pa.array(masks or [(1 << N.K) - 1] * len(sets), pa.int64()), "side": pa.array([side] * len(sets), pa.int32()),
        "grid": pa.array([g.tolist() for g in grids], pa.list_(pa.int32())), "sketch": pa.array([N.sketch(s).tobytes() for s in sets], pa.binary()),
    })


def band_of(n):
    return int(np.floor(np.log(n) / np.log(N.BAND))) << N._BAND_BIT


def test_block_keeps_pairs_whose_bytes_collide():
    """Two members whose values at the lowest coordinate differ, though one byte made of them is equal, meet in the next one's list."""
    old = lambda v: 1 + N._mix(np.array([v], np.uint64)) % np.uint64(255)
    twin = next(v for v in range(1, 10_000) if old(v) == old(0))
    rows = block_rows([np.arange(100, dtype=np.uint64)] * 2, [1, 2], [3, 3])
    values = np.zeros((2, N.K), np.int32)
    values[1, 0] = twin
    rows = rows.set_column(rows.schema.get_field_index("grid"), "grid", pa.array(values.tolist(), pa.list_(pa.int32())))
    x, y, _ = N._Block(rows, band_of(100) | 1 << 32, 0, 0).pairs()
    assert sorted(zip(x.tolist(), y.tolist())) in ([(0, 1)], [(1, 0)])
    assert not len(N._Block(rows, band_of(100) | 2 << 32, 0, 0).pairs()[0])  # coordinate 2's list leaves it to coordinate 1's


def test_block_pairs_against_all_pairs():
    """Each pair of different components with T equal coordinates is left to the list of the lowest coordinate in which both prefixes meet."""
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([r.permutation(base)[: int(k)], r.integers(0, 2**63, 400 - int(k), dtype=np.uint64)])) for k in r.integers(330, 400, 70)]
    comps, masks = r.integers(0, 12, 70).tolist(), [int(m) for m in r.integers(0, 1 << 32, 70)]
    rows = block_rows(sets, comps, masks)
    grid = np.array(rows.column("grid").to_pylist())
    for coordinate in (0, 3, 17):
        got = {tuple(sorted(p)) for p in zip(*(c.tolist() for c in N._Block(rows, band_of(400) | coordinate << 32, 0, 0).pairs()[:2]))}
        for a in range(70):
            for b in range(a + 1, 70):
                same = grid[a] == grid[b]
                meet = [k for k in range(N.K) if same[k] and masks[a] >> k & 1 and masks[b] >> k & 1]
                wanted = comps[a] != comps[b] and same.sum() >= N.T and not [k for k in meet if k < coordinate]
                size = max(len(sets[a]), len(sets[b]))
                if wanted and N.alike(sets[a], sets[b]):
                    assert (a, b) in got
                if (a, b) in got:
                    assert wanted and 100 * min(len(sets[a]), len(sets[b])) >= 80 * size


def test_block_links_join_what_all_pairs_join():
    """Fewer links than components, with the same components as all linked pairs, and each link is one."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(w if r.random() > 0.03 else f"x{r.random()}" for w in words).encode() for _ in range(90)]
    sets = [N.shingle_set(t, N._Words(), 2) for t in texts]
    found = N._Block(block_rows(sets, list(range(90))), band_of(300), 0, 0).links(texts, N._Words(), 2)
    linked = [(a, b) for a in range(90) for b in range(a) if N.alike(sets[a], sets[b]) and (N.signature(sets[a]) == N.signature(sets[b])).sum() >= N.T]

    def joined(pairs):
        root = list(range(90))
        for a, b in pairs:
            x, y = root[a], root[b]
            root = [x if c == y else c for c in root]
        return sorted(Counter(root).values())

    assert 0 < len(found) < 90 < len(linked) and all(N.alike(sets[a], sets[b]) for a, b in found) and joined(found) == joined(linked)


def test_near_dedup_loses_no_link_of_a_varied_group(spark):
    """A group of copies that differ by a few words each, many pairs of which lie just above or below the limit."""
    r = random.Random(12)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if r.random() > 0.029 else f"x{r.randrange(10**9)}" for w in words)) for i in range(700)]
    rows += [(1000 + i, " ".join(f"y{i}_{j}" for j in range(60))) for i in range(50)]
    got = {x.doc_id: x.component_id for x in N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    sets = {i: frozenset(zip(t.split(), t.split()[1:])) for i, t in rows}
    near, linked = [(a, b) for a in range(700) for b in range(a) if 75 * len(sets[a] | sets[b]) <= 100 * len(sets[a] & sets[b])], 0
    for a, b in near:
        if 80 * len(sets[a] | sets[b]) <= 100 * len(sets[a] & sets[b]):
            linked += 1
            assert got[a] == got[b]
    assert 2_000 < linked < len(near) and got == {i: c for i, (_, c) in brute_components(rows, 2).items()}


def test_near_dedup_with_ids_of_other_kinds(spark):
    """Ids that are text; and an id on rows of several texts, which links their classes."""
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve", "red green blue black white grey")
    rows = [("x", a), ("b", a), ("x", b), ("k", b), ("z", c), ("c", c + " x"), (None, c)]
    got = {(x.doc_id, x.component_id, x.kept) for x in N.near_dedup(spark.createDataFrame(rows, "doc_id string, text string"), shingle=2).collect()}
    assert got == {("x", "b", False), ("b", "b", True), ("k", "b", False), ("z", "c", False), ("c", "c", True), (None, "c", False)}


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**63, 900, dtype=np.uint64), r.integers(0, 2**63, 100, dtype=np.uint64)
    hits = [np.count_nonzero(N.signature(np.unique(np.concatenate([a, b + np.uint64(s)]))) == N.signature(np.unique(np.concatenate([a, b + np.uint64(s + 5000)])))) for s in range(20)]
    assert abs(np.mean(hits) / N.K - 900 / 1100) < 0.06


def test_drop_near_copies(docs):
    out = N.drop_near_copies(docs)
    want = {i for i, (_, c) in brute_components(rows_of(docs), 5).items() if i == c}
    assert out.columns == docs.columns and {r.doc_id for r in out.select("doc_id").collect()} == want


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_null_ids(spark):
    """A row without an id takes part in its text's class; it is kept only where no row with an id has that text."""
    rows = [(None, "a b c d e f", None), (3, "a b c d e f", "s"), (None, "x y z u v w", "s"), (None, None, None), (4, "", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    exact = sorted(map(str, X.exact_dedup(d).select("doc_id", "keep_id", "group_size", "kept").collect()))
    assert exact == sorted(map(str, spark.createDataFrame([(None, 3, 2, False), (3, 3, 2, True), (None, None, 1, True), (None, 4, 2, False), (4, 4, 2, True)], "doc_id long, keep_id long, group_size long, kept boolean").collect()))
    near = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_dedup(d, shingle=2).collect()}
    assert near == {(None, 5, 3, False), (3, 5, 3, True), (None, 5, None, True), (None, 0, None, True), (4, 0, 4, True)}
    assert P.pack(d).count() == 5 and M.mix(d).count() == 5 and L.scan_licenses(d).count() == 5 and Q.quality_report(d).count() == 5


# -- license scan -------------------------------------------------------------------------------------------------------


def test_matching_statistics():
    sequences = [L.words_of(t) for _, t in L.TEMPLATES]
    sequences = [q[:40] for q in sequences]
    automaton = L.SuffixAutomaton(sequences)
    subs = {tuple(q[i:j]) for q in sequences for i in range(len(q)) for j in range(i + 1, len(q) + 1)}
    every, r = sorted({w for q in sequences for w in q}) + [b"zz"], random.Random(3)
    for _ in range(60):
        t = []
        while len(t) < 40:
            q = r.choice(sequences)
            i = r.randrange(len(q))
            t += q[i : i + r.randint(1, 9)] if r.random() < 0.6 else [r.choice(every)]
        longest = [max(n for n in range(e + 1) if n == 0 or tuple(t[e - n : e]) in subs) for e in range(len(t) + 1)]
        want = [(e, longest[e]) for e in range(1, len(t) + 1) if longest[e] >= 3 and (e == len(t) or longest[e + 1] != longest[e] + 1)]
        found = list(automaton.matches(t, 3))
        assert [(e, n) for e, n, _ in found] == want
        assert all(sequences[k][at - n + 1 : at + 1] == t[e - n : e] for e, n, s in found for k, at in automaton.ends[s].items())


def test_chains_against_all_chains():
    """The chain that covers most, by trying every match as the one before."""
    scanner, r = L.scanner(), random.Random(7)
    split = [L.words_of(t) for _, t in L.TEMPLATES]
    for _ in range(80):
        t = []
        while len(t) < 120:
            q = r.choice(split[3:12] if r.random() < 0.8 else split)
            i = r.randrange(len(q))
            t += q[i : i + r.randint(2, 30)] + [b"zz"] * r.choice([0, 0, 1, 3, 9])
        found = [(e - n, e, at - n + 1, k) for e, n, s in scanner.automaton.matches(t, L.LEAST) for k, at in scanner.automaton.ends[s].items()]
        want = {}
        for k in {f[3] for f in found}:
            own, most = [f for f in found if f[3] == k], []
            for begin, end, place, _ in own:
                covers = [end - begin]
                for (b, e, p, _), c in zip(own, most):
                    both = max(0, e - begin)
                    if begin - e <= L.GAP and both < end - begin and place + both >= p + e - b:
                        covers.append(c + end - begin - both)
                most.append(max(covers))
            want[k] = max(most)
        got = {k: (a, b, n) for k, a, b, n in scanner.chains(t)}
        assert {k: n for k, (_, _, n) in got.items()} == want and all(0 <= a and b <= len(t) and n <= b - a for a, b, n in got.values())


def test_licenses_of_all_kinds():
    scan = lambda t: L.scanner().scan(t)
    assert scan("// SPDX-License-Identifier: LGPL-2.1-or-later\nint x;")["labels"] == "lgpl-2.1"
    assert "lgpl-2.1" in scan("This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.")["labels"].split(",")
    assert scan("(c) 2020 X. All rights reserved.")["labels"] == "all-rights-reserved" and scan("All rights reserved.")["score"] < 0.7
    for label, text in L.TEMPLATES:
        assert label in scan(f"some words before {text} and after")["labels"].split(",")
    assert scan("the rights of the software to the use of this")["labels"] == ""


def test_license_scan(docs, empty, spark):
    texts = [
        "Released under the MIT License. x", "UNDER the mit-license!! under The MIT  license", "Apache License, Version 2.0 and cc by-nc", "cc by nc by nc cc by nc", "permitted. cc by", None, "",
        "x " * 50_000 + "under the mit license", "This work is licensed under the GNU General Public License, version 3.", "licensed under the gnu general nothing",
    ]
    got = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(j, label) for p, label in L.PHRASES.items() for j in range(len(words)) if words[j : j + len(p.split())] == p.split()]
        starts = [j for j, _ in places]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[8].labels == "gpl-3" and got[8].spans[0].begin == 0 and got[8].spans[0].end == 12 and got[9].labels == "" and 0 < got[9].score < 0.8
    assert L.scan_licenses(docs).count() == docs.count() and L.scan_licenses(empty).collect() == []


# -- quality rules ------------------------------------------------------------------------------------------------------


def plain_measures(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated)


def test_quality_rules(docs, empty, spark):
    texts = [t for _, t in rows_of(docs)] + ["a b c a b c d", "l1\nl1\n\n \nl2\nl1\n", "a # b $$ | <x>", "a a a a a", "x y z w x y z w x y z", "a b"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in Q.quality_report(d).collect():
        m = plain_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m, repr(texts[r.doc_id])[:80]
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0]) and not (r.base_failed and r.kept)
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and Q.keep_good(empty).count() == 0 and Q.quality_report(empty).collect() == []
    good = spark.createDataFrame([(1, " ".join(f"the word{i} of" for i in range(40)))], "doc_id long, text string")
    assert Q.quality_report(good).first().kept and Q.keep_good(good).count() == 1
    plan = Q.quality_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- mixing -------------------------------------------------------------------------------------------------------------


def slots_of(phases):
    """(source, block) of each slot."""
    out = []
    for p in phases:
        assert p.first == len(out)
        of = {t: s for s, slots in p.pattern.items() for t in slots}
        given = Counter()
        for t in range(p.slots):
            s = of[t % p.length]
            out.append((s, p.start[s] + given[s]))
            given[s] += 1
        assert given == Counter(p.blocks)
    return out


def plain_schedule(blocks, weights):
    """Slot by slot: of the sources whose next block is released, that with the earliest deadline."""
    left, out = dict(blocks), []
    while any(left.values()):
        live = {s: w for s, w in weights.items() if left[s]}
        total, given, t = sum(live.values()), Counter(), 0
        while all(left[s] for s in live):
            ready = [s for s in live if given[s] * total // live[s] <= t]
            s = min(ready, key=lambda s: (-(-(given[s] + 1) * total // live[s]), -live[s], s is None, s or 0))
            out.append((s, blocks[s] - left[s]))
            given[s] += 1
            left[s] -= 1
            t += 1
    return out


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.dictionaries(st.sampled_from([None, 0, 1, 2, 3, 4]), st.tuples(st.integers(1, 60), st.integers(1, 50)), min_size=1))
def test_schedule_is_earliest_deadline_first(sources):
    """Periods repeated give the slots of a plain simulation, and any prefix of a phase deviates by less than a block."""
    blocks, weights = {s: n for s, (n, _) in sources.items()}, {s: float(w) for s, (_, w) in sources.items()}
    order, whole = slots_of(M.schedule(blocks, weights)), M.whole_weights(weights)
    assert order == plain_schedule(blocks, whole)
    done, active, start, at_start = Counter(), set(blocks), 0, Counter()
    for t, (s, _) in enumerate(order):
        done[s] += 1
        total = sum(whole[x] for x in active)
        for x in active:
            assert abs(done[x] - at_start[x] - whole[x] / total * (t + 1 - start)) < 1 + 1e-6
        if done[s] == blocks[s]:
            active, start, at_start = active - {s}, t + 1, done.copy()


def test_whole_weights():
    assert M.whole_weights({"a": 3, "b": 1}) == {"a": 7500, "b": 2500}
    many = M.whole_weights({i: 1.0 + (i == 0) * 1e9 for i in range(1000)})
    assert min(many.values()) == 1 and sum(many.values()) < 3000


def test_mix(docs, empty):
    got = sorted(M.mix(docs, block=7).collect(), key=lambda r: r.position)
    rows = Counter(r.source for r in got)
    assert [r.position for r in got] == list(range(docs.count())) and Counter(r.doc_id for r in got) == Counter(i for i, _ in rows_of(docs)) and None in rows
    blocks = {s: -(-n // 7) for s, n in rows.items()}
    order = slots_of(M.schedule(blocks, M.default_weights(dict(rows))))
    assert [(r.slot, r.source, r.block) for r in got] == [(t, s, b) for t, (s, b) in enumerate(order) for _ in range(min(7, rows[s] - 7 * b))]
    assert M.mix(empty).collect() == []
    late = sorted(M.mix(docs, weights={"s1": 2.0, "s2": 1.0}, block=1).collect(), key=lambda r: r.position)
    known = sum(r.source in ("s1", "s2") for r in late)
    assert all(r.source in ("s1", "s2") for r in late[:known])


@pytest.mark.parametrize("kind, values", [("int", [0, 1, 2, None]), ("boolean", [True, False, None]), ("date", [None])])
def test_mix_sources_of_other_kinds(spark, kind, values):
    rows = [(i, values[i % len(values)]) for i in range(40)]
    got = M.mix(spark.createDataFrame(rows, f"doc_id long, source {kind}"), block=3).collect()
    assert {(r.doc_id, r.source) for r in got} == set(rows) and sorted(r.position for r in got) == list(range(40))


def test_mixed_rows_in_order(docs, empty, tmp_path):
    position = {(r.doc_id): r.position for r in M.mix(docs, block=7).collect()}
    docs.write.parquet(str(tmp_path / "docs"))
    for given in (docs, docs.sparkSession.read.parquet(str(tmp_path / "docs"))):
        out = M.mixed(given, block=7)
        rows = out.collect()
        assert out.columns == docs.columns and sorted(map(str, rows)) == sorted(map(str, docs.collect()))
        seen = [position[r.doc_id] for r in rows]
        assert sum(a > b for a, b in zip(seen, seen[1:])) <= 4  # repeated rows share an entry here
    assert M.mixed(empty).collect() == []


# -- packing ------------------------------------------------------------------------------------------------------------


def test_tokens_equal_those_of_the_library():
    from tokenizers import Tokenizer

    t, plain = Tokenizer.from_file(vocabulary_path()), Tokenizer.from_file(vocabulary_path())
    plain.encode_special_tokens = True
    ours, r = byte_bpe(vocabulary_path()), random.Random(2)
    texts = ["", "  ", "a  b", " a", "a ", "a \n b", "\n\n x\ty  ", "\x1c a\x1d b", "<|endoftext|> x", "a <|endoftext|> x<|endoftext|><|endoftext|>\n", "<|endof<|endoftext|>text|>", "don't  we'll", "é ü  ß", "x" * 5000, "a\x85 b", "a\0 b", "it's, 's. .s ,", "日本語, テスト. x", "a　 b", "ab́ ć, d"]
    texts += ["".join(r.choices(["a", "B", "é", " ", "  ", "\n", ",", ".", "7", "'s", "\t", " ", "日", "́", "-", "\r\n"], k=30)) for _ in range(300)]
    for x in texts:
        assert t.encode(x, add_special_tokens=False).ids == ours.encode(x).tolist(), repr(x)
        assert plain.encode(x, add_special_tokens=False).ids == ours.encode(x, added=False).tolist(), repr(x)
        assert ours.decode(ours.encode(x)) == x == ours.decode(ours.encode(x, added=False))


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), min_size=1, max_size=30))
def test_plan_places_every_piece(counts):
    shapes = P.plan(counts, 64)
    used = Counter()
    for shape, bins in shapes:
        assert sum(shape) <= 64 and bins > 0
        for n in shape:
            used[n] += bins
    assert used == Counter(counts)
    first_fit = []
    for n in sorted(Counter(counts).elements(), reverse=True):
        i = next((i for i, room in enumerate(first_fit) if room >= n), None)
        if i is None:
            first_fit.append(64 - n)
        else:
            first_fit[i] -= n
    assert sum(b for _, b in shapes) <= len(first_fit) + 1


@settings(max_examples=80, deadline=None, derandomize=True)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_plan_is_best_two_fit(pieces):
    """Bin by bin over single pieces: the longest that fits, again and again; then the two best in place of the smallest."""
    left, want = Counter(pieces), []
    while +left:
        shape, room = [], 40
        while fits := [n for n in +left if n <= room]:
            shape.append(max(fits))
            left[max(fits)] -= 1
            room -= max(fits)
        if room and len(shape) > 1:
            small = shape.pop()
            left[small] += 1
            pool = sorted((+left).elements())
            pairs = [(a + b, max(a, b)) for i, a in enumerate(pool) for b in pool[i + 1 :] if a + b <= room + small]
            if pairs and max(pairs)[0] > small:
                total, a = max(pairs)
                new = [a, total - a]
            else:
                new = [small]
            shape += new
            left.subtract(new)
        want.append(sorted(shape, reverse=True))
    assert [shape for shape, bins in P.plan(Counter(pieces), 40) for _ in range(bins)] == want


def test_packed_sequences_follow_the_mix(spark, tmp_path, empty):
    """Over the first sequences, sources have the shares of the first mixed rows, though files of unlike size are read in any order."""
    r = random.Random(8)
    rows = [(i, " ".join(["a"] * r.randint(1, 40)), "hot" if i % 10 else "rare") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    M.mixed(docs, {"hot": 1.0, "rare": 1.0}).write.parquet(str(tmp_path / "mixed"))
    source = {i: s for i, _, s in rows}
    got = P.pack(spark.read.parquet(str(tmp_path / "mixed")), size=64, in_order=True).collect()
    assert sorted(x.doc_id for x in got) == list(range(3000))
    by_sequence = defaultdict(list)
    for x in got:
        by_sequence[x.sequence_id].append(x)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = sorted((x.offset, x.length) for x in pieces)
        assert [a for a, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))] and sum(n for _, n in at) <= 64
    for share in (0.05, 0.1, 0.15):  # rare rows are used up after a fifth
        first = [x for q in range(int(share * len(by_sequence))) for x in by_sequence[q]]
        assert abs(sum(source[x.doc_id] == "rare" for x in first) / len(first) - 0.5) < 0.12
    assert P.pack(empty, in_order=True).collect() == []


def test_pack(docs, empty):
    got = P.pack(docs).collect()
    bpe = byte_bpe(vocabulary_path())
    texts = dict(rows_of(docs))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        copies = sum(p.piece == 0 for p in pieces)
        want = bpe.encode(texts[i] or "").tolist() + [P.END]
        pieces = sorted({(p.piece, p.start, p.length, bytes(p.ids)) for p in pieces})
        assert len(by_doc[i]) == copies * len(pieces)
        joined = np.frombuffer(b"".join(p[3] for p in pieces), "<u4").tolist()
        assert joined == want and [p[0] for p in pieces] == list(range(len(pieces))) and all(p[2] == P.SIZE for p in pieces[1:])
        assert [p[1] for p in pieces] == np.cumsum([0, *(p[2] for p in pieces)])[:-1].tolist()
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= P.SIZE
    assert len(by_sequence) <= sum(r.length for r in got) / P.SIZE * 1.02 + 2
    digests = P.packed_digests(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in digests) == Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(bytes(r.ids))) for r in got)
    assert P.pack(empty).collect() == []


# -- quality classifier -------------------------------------------------------------------------------------------------


def test_classifier(spark, docs, empty, sf_dir):
    d, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    more = labels.select("doc_id", "quality").unionByName(spark.createDataFrame([(10**9, 1), (None, 0), (3, None)], "doc_id long, quality int"))
    got = C.classify(d, more).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    low, high = ([r.score for r in got if truth.get(r.doc_id) == q] for q in (0, 1))
    assert np.mean(high) > np.mean(low)
    weights = C.train(d, more)
    odd = C.classify(docs, more, weights).collect()
    assert len(odd) == docs.count() and len({r.score for r in odd if not (dict(rows_of(docs))[r.doc_id] or "").split()}) == 1
    assert C.classify(empty, more, weights).collect() == []
    assert C.classify(docs, more.limit(0)).select("score").distinct().collect() == [(0.5,)]


def test_ftrl_against_plain_updates():
    """The update rule written out for one weight at a time."""
    r, m = random.Random(4), C.FtrlProximal()
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= C.L1 else -(z[i] - np.sign(z[i]) * C.L1) / ((C.BETA + n[i] ** 0.5) / C.ALPHA + C.L2)

    for _ in range(200):
        at = sorted(r.sample(range(40), 6))
        x, y = [r.random() for _ in at], r.randint(0, 1)
        m.update(np.array(at), np.array(x), y)
        row = [*zip(at, x), (1 << C.BITS, 1.0)]
        p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in row)))
        for i, v, w in [(i, v, weight(i)) for i, v in row]:
            g = (p - y) * v
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / C.ALPHA * w
            n[i] += g * g
    assert np.allclose([m.weights(np.array([i]))[0] for i in [*range(40), 1 << C.BITS]], [weight(i) for i in [*range(40), 1 << C.BITS]])


def test_classifier_on_rows_that_are_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.where("quality IS NOT NULL").collect()}
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in C.classify(d, labels).collect() if r.held_out and r.doc_id in truth]
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert len(good) > 20 and len(bad) > 5
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95 and np.mean([p == y for _, p, y in held]) > 0.9


def test_ftrl_learns():
    m, r = C.FtrlProximal(), np.random.default_rng(0)
    data = []
    for _ in range(400):
        y = int(r.random() < 0.5)
        at = np.unique(r.integers(0, 500, 8) + (1000 if y else 2000))
        data.append((at, np.full(len(at), 1 / np.sqrt(len(at))), y))
    for at, x, y in data[:300] * 3:
        m.update(at, x, y)
    w = m.weights()
    assert np.mean([((w[at] @ x + w[-1]) > 0) == bool(y) for at, x, y in data[300:]]) > 0.95


def test_stop_words_are_lower_case():
    assert all(w == w.lower() for w in Q.STOP_WORDS) and F is not None
