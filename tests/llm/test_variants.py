"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from siren.llm import variants as V

SCHEMA = "doc_id long, text string, word string, n long, root array<string>"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_force(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], counts.get(form[w]), root))
    return sorted(out)


def found(spark, docs):
    table = spark.createDataFrame([(d, t, "x", 1, ["y"]) for d, t in docs], SCHEMA)
    return sorted(tuple(r) for r in V.variants(table).select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_agrees_with_brute_force(spark):
    """Chains of forms, repeats, other alphabets, empty and NULL texts and ids, clashing columns."""
    draw = random.Random(4)
    base = ["settlement", "ÉTÉRIEUX", "çhamberé", "rescue", "abcdef", "ÿÀöüßø", "aaaaaa"]
    words = Counter()
    for word in base:
        n, at = 700, word
        for _ in range(3):
            words[at] += n
            k = draw.randrange(len(at))
            at, n = at[:k] + draw.choice(["", "e", "ef", "é"]) + at[k + 1 :], n // 6
    every = [w for w, n in words.items() for _ in range(n)]
    draw.shuffle(every)
    docs = [(k, " ".join(every[k * 50 : k * 50 + 50])) for k in range(len(every) // 50)]
    docs += [(1, docs[1][1]), (None, "settlement, settlement! x2rescue"), (7, None), (8, ""), (9, "1 2 ×÷ 日本")]
    result = found(spark, docs)
    assert result == brute_force(docs)
    assert any(form is not None and root != form for _, _, _, form, _, root in result)


def test_empty_table_and_ties(spark):
    assert found(spark, []) == []
    docs = [(k, "planets plbnets plcnets") for k in range(300)] + [(k, "pl nets plxnets") for k in range(20)]
    assert found(spark, docs) == brute_force(docs)


@given(st.text("ab", min_size=6, max_size=9), st.text("ab", min_size=6, max_size=9))
def test_one_edit_keeps_a_chunk(a, b):
    if one_edit(a, b):
        assert set(V.chunks_of(a)) & set(V.grams_of(b)) and set(V.chunks_of(b)) & set(V.grams_of(a))


@given(st.text("aZé ", max_size=60), st.integers(1, 9))
def test_pieces_change_nothing(text, size):
    assert V.run_counts(text, size) == V.run_counts(text, 1000)


def test_hot_chunk_is_dealt(spark, monkeypatch):
    """Thousands of words with one chunk: several salts, every pair once."""
    monkeypatch.setattr(V, "SALT_ROWS", 50)
    words = [f"prefix{a}{b}{c}" for a in "abcdefg" for b in "hijklmn" for c in "opqrst"]
    pairs = [(r.a, r.b) for r in V.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()]
    assert sorted(pairs) == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))
