"""Fingerprints and their links against plain Python."""

import random
import re
from itertools import product

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from siren.llm import simhash as S
from siren.llm.components import components

SCHEMA = "doc_id long, text string, fp string, rows string, component string"


def naive(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, distance=3):
    """fingerprint to the smallest one of its component."""
    prints = sorted(prints)
    parent = {p: p for p in prints}

    def top(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    every = np.array(prints, np.uint64)
    for k, p in enumerate(prints):
        for other in np.flatnonzero(np.bitwise_count(every[k + 1 :] ^ every[k]) <= distance):
            a, b = sorted((top(p), top(prints[k + 1 + int(other)])))
            parent[b] = a
    return {p: top(p) for p in prints}


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def linked(spark, prints, **limits):
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long").repartition(4)
    found = {r.node: r.component for r in components(S.links(table, **limits)).collect()}
    groups = {}
    for p in prints:
        groups.setdefault(found.get(signed(p), signed(p)), set()).add(p)
    return {p: min(g) for g in groups.values() for p in g}


def clustered(seed=1):
    """Scattered fingerprints, chains, and dense clusters whose members differ in a few of the same bits."""
    draw = random.Random(seed)
    out = {draw.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for size in (3, 40, 400):
        centre = draw.getrandbits(64)
        bits = draw.sample(range(64), 14)
        for _ in range(size):
            out.add(centre ^ sum(1 << b for b in draw.sample(bits, draw.randint(0, 7))))
    at = draw.getrandbits(64)
    for _ in range(30):
        out.add(at)
        at ^= sum(1 << b for b in draw.sample(range(64), 3))
    return out


@pytest.mark.parametrize("limits", [{}, {"crowded": 0}, {"crowded": 0, "most": 0}, {"distance": 1}, {"distance": 2, "crowded": 4}, {"distance": 0}])
def test_links_find_every_component(spark, limits):
    prints = clustered()
    assert linked(spark, prints, **limits) == classes(prints, limits.get("distance", 3))


@pytest.mark.parametrize("m", [2, 3, 4])
def test_any_number_of_parts(spark, monkeypatch, m):
    monkeypatch.setattr(S, "part_count", lambda n, distance: m)
    prints = clustered(m)
    assert linked(spark, prints) == classes(prints)


def test_crowded_values_are_not_paired(spark):
    """4,096 fingerprints that share 52 bits: linked without pairing any, and what is paired does not grow with squares."""
    base = random.Random(7).getrandbits(64) & ~0xFFF
    prints = {base | k for k in range(4096)}
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    links = S.links(table)
    assert links.count() < 4096 * 70
    assert linked(spark, prints) == dict.fromkeys(prints, base)


def test_far_apart_in_one_value(spark):
    """Codewords that share three parts and are never within the distance stay apart."""
    draw, prints = random.Random(3), []
    while len(prints) < 60:
        p = draw.getrandbits(16)
        if all((p ^ q).bit_count() > 3 for q in prints):
            prints.append(p)
    assert linked(spark, prints, crowded=0, most=0) == {p: p for p in prints}


@given(st.lists(st.text("ab é\n\x1c", max_size=40), max_size=4), st.integers(1, 9))
def test_fingerprint_of_pieces(texts, size):
    for text in [*texts, None, "one", "One two"]:
        assert S.fingerprint(text, piece_bytes=size) == naive(text) == S.fingerprint(text)


def test_thresholds_are_the_cheapest():
    draw = np.random.default_rng(5)
    costs = draw.integers(1, 100, (50, 3, 4)).astype(float)
    found = S.allocate(costs, 4)
    assert ((found + 1).sum(axis=1) == 4).all()

    def cost(row, t):
        return sum(costs[row, k, x] for k, x in enumerate(t) if x >= 0)

    for row in range(50):
        every = [t for t in product(range(-1, 4), repeat=3) if sum(t) == 1]
        assert cost(row, found[row]) == min(cost(row, t) for t in every)


def test_counts_within():
    counts = np.random.default_rng(6).integers(0, 9, 1 << 8)
    found = S.within(counts, 8, 3)
    for value in (0, 7, 255):
        for t in range(4):
            assert found[t, value] == sum(int(n) for v, n in enumerate(counts) if (v ^ value).bit_count() <= t)


def test_correlated_bits_share_a_part():
    draw = np.random.default_rng(8)
    halves = draw.integers(0, 2, (500, 32))
    bits = np.concatenate([halves, halves], axis=1)  # bit k and bit k + 32 are the same
    parts = S.grouped_bits((bits.T @ bits).astype(float), 500, 4)
    assert sorted(b for part in parts for b in part) == list(range(64)) and {len(p) for p in parts} == {16}
    assert all((b + 32) % 64 in part for part in parts for b in part)


def test_rows_of_all_kinds(spark, monkeypatch):
    monkeypatch.setattr(S, "HEAVY_ROWS", 3)
    draw = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    long = " ".join(draw.choices(words, k=2000))
    docs = [(k, " ".join(draw.choices(words, k=draw.randint(0, 30)))) for k in range(60)]
    docs += [(100, long), (101, long.replace("w1 ", "w2 ", 1)), (102, long.upper()), (103, None), (104, " \n"), (None, ""), (None, "w5")]
    docs += [(5, docs[5][1]), (5, "another text"), (105, "日本 語 です ね")] + [(200 + k, "the same few words") for k in range(9)]
    table = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in docs], SCHEMA)
    found = S.fingerprint_classes(table).select("doc_id", "fingerprint", "component_id").collect()
    groups = classes({naive(t) for _, t in docs})
    first = {}
    for d, t in docs:
        if d is not None:
            g = groups[naive(t)]
            first[g] = min(first.get(g, d), d)
    wanted = [(d, f"{naive(t):016x}", first.get(groups[naive(t)])) for d, t in docs]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))
    assert S.fingerprint_classes(table.limit(0)).count() == 0


def test_nothing_is_marked_where_no_value_is_crowded(spark, monkeypatch):
    """Without crowded values every fingerprint stands for itself: no join of all entries to labels."""
    names = []
    real = S.written
    monkeypatch.setattr(S, "written", lambda df, name: names.append(name) or real(df, name))
    table = spark.createDataFrame([(value * 0x9E3779B97F4A7C15 % (1 << 62),) for value in range(1, 300)] + [(8,), (9,)], "fp long")
    found = {(r.a, r.b) for r in S.links(table).collect()}
    assert found == {(8, 9)} and "marked" not in names
    S.links(table, crowded=0).collect()
    assert "marked" in names


def test_only_entries_of_crowded_values_are_marked(spark, monkeypatch):
    """One crowded group does not take all other entries into the join to labels."""
    rows = {}
    real = S.written

    def counted(df, name):
        table = real(df, name)
        rows[name] = table.count()
        return table

    monkeypatch.setattr(S, "written", counted)
    draw = random.Random(12)
    base = draw.getrandbits(64)
    group = [base, *(base ^ (1 << b) for b in range(64))]
    others = [p ^ flip for p in (draw.getrandbits(64) for _ in range(1000)) for flip in (0, 1 << draw.randrange(64))]
    prints = sorted({*group, *others})
    assert linked(spark, prints, crowded=16) == classes(prints)
    assert 0 < rows["marked"] < rows["met"] / 4
