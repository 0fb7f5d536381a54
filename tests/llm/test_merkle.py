"""The manifest against a tree built in one place."""

import zlib
from collections import Counter
from hashlib import sha256

import pytest

from siren.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, block long, node string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    fields = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return H(*["-" if f is None else f"{len(f.encode())}:{f}" for f in fields])


def proofs(nodes):
    """The root, and for each node its siblings with their sides."""
    paths, at, row = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(row) > 1:
        for k, place in enumerate(at):
            other = place ^ 1
            paths[k].append((None if other >= len(row) else row[other], place & 1))
            at[k] = place >> 1
        row = [H(*row[k : k + 2]) for k in range(0, len(row), 2)]
    return row[0], paths


def brute_force(docs):
    """Rows (doc_id, text, lang, source, n_chars) to sorted results."""
    trees = {}
    for d, text, lang, source, n in docs:
        changed = n + 1 if n is not None and d is not None and zlib.crc32(str(d).encode()) % 7 == 0 else n
        row = (d is not None, d or 0, leaf(d, source, lang, n, text), leaf(d, source, lang, changed, text), d)
        trees.setdefault(b"" if lang is None else b"s" + lang.encode(), []).append(row)
    names = sorted(trees)
    sub = {name: proofs([row[2] for row in sorted(trees[name], key=lambda r: r[:3])]) for name in names}
    root, above = proofs([sub[name][0] for name in names]) if names else (None, [])
    out = []
    for name, path_above in zip(names, above):
        for row, path in zip(sorted(trees[name], key=lambda r: r[:3]), sub[name][1]):
            node = row[3]
            for other, right in path + path_above:
                node = H(node) if other is None else H(other, node) if right else H(node, other)
            proof = H(*[other for other, _ in path + path_above if other is not None])
            out.append((row[4], row[2], sub[name][0], root, proof, node, node == root))
    return Counter(out)


def check(spark, docs, levels):
    rows = [(d, t, lang, s, n, "x", 1, "y") for d, t, lang, s, n in docs]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = M.manifest(table, levels).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )
    assert Counter(map(tuple, found.collect())) == brute_force(docs)


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_agrees_with_one_tree(spark, levels):
    """Several rounds of superblocks, lone leaves, languages of all sizes, NULLs, repeats, a run over many superblocks."""
    docs = [(k, f"text {k}", f"l{k % 3}", "s", k) for k in range(0, 57)]
    docs += [(100, "lone", "zz", "s", 4), (None, None, None, None, None), (7, "", None, "é", 0), (7, "x", None, "é", None)]
    docs += [(1, "same", "l1", "s", 4)] * 9 + [(None, "no id", "l1", None, 1)] * 2 + [(2, "long " * 50_000, "é", "", 3)]
    check(spark, docs, levels)


@pytest.mark.parametrize("docs", [[], [(3, "a", "en", "s", 1)], [(3, "a", "en", "s", 1), (4, "b", "de", "s", 1)]])
def test_small_tables(spark, docs):
    check(spark, docs, 2)


def test_tampered_rows_fail(spark):
    docs = [(k, "t", "en", "s", 1) for k in range(40)]
    table = spark.createDataFrame([(d, t, lang, s, n, "x", 1, "y") for d, t, lang, s, n in docs], SCHEMA)
    failed = {r.doc_id for r in M.manifest(table).where("NOT verified").collect()}
    assert failed == {k for k in range(40) if zlib.crc32(str(k).encode()) % 7 == 0} and failed


def test_paths_fold_back():
    for n in range(1, 20):
        nodes = [H(str(k)) for k in range(n)]
        levels = M.tree_levels(nodes, (n - 1).bit_length())
        assert all(M.folded(nodes[k], M.path_of(levels, k)) == levels[-1][0] for k in range(n))
