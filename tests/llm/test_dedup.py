"""Exact dedup, components and the similarity join against plain Python."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import combinations

import pytest

from siren.llm import jaccard_join
from siren.llm.block_naming import exact_dedup
from siren.llm.components import components
from siren.llm.jaccard_join import similarity_classes

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, uid long, n long, _row string, component string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, "x", "y") for d, t in rows], SCHEMA).repartition(3).checkpointed()


@pytest.fixture(autouse=True)
def written_tables(monkeypatch, tmp_path):
    """Rows are numbered twice, so tests read written tables too."""
    from pyspark.sql import DataFrame

    def checkpointed(df):
        path = str(tmp_path / f"table-{random.random()}")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    monkeypatch.setattr(DataFrame, "checkpointed", checkpointed, raising=False)


def shingles(text, size=5):
    words = WORDS.findall((text or "").encode().lower())
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def brute_force(docs, percent=75):
    """Sorted (doc_id, n_shingles, component_id)."""
    sets = [shingles(text) for _, text in docs]
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, found in enumerate(sets):
        for shingle in found:
            holders[shingle].append(k)
    for k, found in enumerate(sets):
        for other, common in Counter(j for s in found for j in holders[s] if j > k).items():
            if 100 * common >= percent * (len(found) + len(sets[other]) - common):
                parent[max(top(k), top(other))] = min(top(k), top(other))
    smallest = defaultdict(list)
    for k, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            smallest[top(k)].append(doc_id)
    return sorted(((d, len(sets[k]), min(smallest[top(k)], default=None)) for k, (d, _) in enumerate(docs)), key=str)


def corpus(seed):
    """Random texts, chains of near copies, many copies, a passage that many share, and odd rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = [rng.choices(vocabulary, k=rng.choice([0, 1, 3, 5, 6, 30, 120])) for _ in range(60)]
    for _ in range(6):
        base = rng.choices(vocabulary, k=rng.choice([40, 100, 200]))
        for _ in range(rng.choice([2, 5, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(words)
    passage = rng.choices(vocabulary, k=60)
    texts += [rng.choices(vocabulary, k=rng.choice([5, 10, 20])) + passage for _ in range(40)]
    texts += [texts[70]] * 20
    docs = [(k, " ".join(words)) for k, words in enumerate(texts)]
    docs += [(None, docs[75][1]), (7, docs[75][1]), (7, None), (8, ""), (9, " \n "), (10, docs[80][1].upper())]
    return docs + [(1000, "É é"), (1001, "é é"), (1002, "long " * 20_000), (1003, "long " * 19_000)]


@pytest.mark.parametrize(("seed", "shard"), [(1, 2_000_000), (2, 400)])
def test_similarity_classes(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(jaccard_join, "HELD_ENTRIES", shard)
    docs = corpus(seed)
    rows = similarity_classes(table(spark, docs), shard_entries=shard).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == brute_force(docs)


def test_similarity_at_the_threshold(spark):
    """Sets of exactly 75 %, and just below it."""
    base = [f"b{k}" for k in range(14)]  # 10 shingles
    docs = [(1, " ".join(base)), (2, " ".join(base[:12] + ["x", "y"])), (3, " ".join(base[:12])), (4, "a b"), (5, "A b")]
    rows = similarity_classes(table(spark, docs)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == brute_force(docs)


def test_similarity_of_nothing(spark):
    assert similarity_classes(table(spark, [])).count() == 0
    rows = similarity_classes(table(spark, [(1, None), (2, ""), (3, "a")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == [(1, 0, 1), (2, 0, 2), (3, 1, 3)]


@pytest.mark.parametrize("block", [4, 64, 4096])
def test_exact_dedup(spark, block):
    rng = random.Random(block)
    docs = [(k, "".join(rng.choices("abAB", k=rng.choice([0, 1, 3, 4, 5, 8, 9])))) for k in range(150)]
    docs += [(500, "Ab" * 700), (501, "aB" * 700), (502, "aB" * 699 + "xx"), (503, "É"), (504, "é"), (505, "ab" * 350)]
    docs += [(k, "the same text") for k in range(600, 700)] + [(None, "THE SAME TEXT"), (None, "only here"), (7, None), (7, None)]
    rows = exact_dedup(table(spark, docs), block).collect()
    digest = {text: sha256((text or "").encode().lower()).hexdigest() for _, text in docs}
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[digest[text]].append(doc_id)
    expected = Counter(
        (d, max((i for i in groups[digest[t]] if i is not None), default=None), len(groups[digest[t]]), digest[t])
        for d, t in docs
    )
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == expected
    kept = [r for r in rows if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(table(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(5)
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(500, k) for k in range(501, 560)]
    loose = [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(90)]
    links = [*chain, *star, *loose, (7, 7), (9, 8), (8, 9), (8, 9)]
    rng.shuffle(links)
    found = {r.node: r.component for r in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    parent = {x: x for link in links for x in link}

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for a, b in links:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    assert found == {x: top(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_filter_keeps_every_link():
    """Any two sets that are linked share a prefix entry that passes the filter of positions."""
    import numpy as np

    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 30)
        one = rng.sample(range(60), n)
        two = list(set(rng.sample(one, max(1, n - rng.randint(0, 6)))) | set(rng.sample(range(60), rng.randint(0, 5))))
        for a, b in combinations([sorted(one), sorted(two)], 2):
            if not jaccard_join.linked(len(set(a) & set(b)), len(a), len(b), 75):
                continue
            lengths = [len(x) - int(jaccard_join.needed_overlap(np.array(len(x)), 75)) + 1 for x in (a, b)]
            shared = [x for x in a[: lengths[0]] if x in b[: lengths[1]]]
            assert any(jaccard_join.possible(len(a), len(b), a.index(x), b.index(x), 75) for x in shared)


@pytest.mark.parametrize("shard_entries", [1, 7, 100])
def test_lists_over_many_shards(spark, shard_entries):
    """Lists of shingles that are dealt over shards find the same components."""
    draw = random.Random(shard_entries)
    parts = [" ".join(f"p{k}w{j}" for j in range(30)) for k in range(6)]
    docs = [(k, " ".join(draw.sample(parts, 4)) + f" end {k % 9}") for k in range(120)]
    docs += [(200 + k, parts[0] + " " + parts[1] + f" own{k} more{k}") for k in range(40)]
    found = similarity_classes(table(spark, docs), shard_entries=shard_entries).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, found.collect()), key=str) == brute_force(docs)


def _nodes(plan):
    """The nodes of a physical plan that ran, those of its stages too."""
    yield plan
    kind = plan.getClass().getSimpleName()
    inner = "executedPlan" if kind == "AdaptiveSparkPlanExec" else "plan" if kind.endswith("QueryStageExec") else None
    children = plan.children()
    for child in [getattr(plan, inner)()] if inner else [children.apply(k) for k in range(children.size())]:
        yield from _nodes(child)


def test_only_classes_of_many_copies_are_repeated(spark, monkeypatch):
    """A row for each class and task, of 300 classes, would be broadcast as if it were as small as the classes."""
    monkeypatch.setattr(jaccard_join, "MANY_COPIES", 20, raising=False)
    docs = [(k, " ".join(f"t{k % 300}w{j}" for j in range(9))) for k in range(600)]
    docs += [(1000 + k, "one text that has very many copies of itself") for k in range(90)]
    docs += [(2000, docs[5][1] + " end"), (None, docs[7][1]), (2001, "alone"), (2002, None)]
    found = similarity_classes(table(spark, docs)).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, found.collect()), key=str) == brute_force(docs)
    plan = found._jdf.queryExecution().executedPlan()
    made = [n.metrics().apply("numOutputRows").value() for n in _nodes(plan) if n.nodeName() == "Generate"]
    assert 300 < sum(made) < 400


def test_texts_around_a_common_core_are_not_compared(spark, monkeypatch):
    """20,000 unlinked texts that share shingles: every list is one cell, which is ruled out against itself."""
    live = []

    def counted(*args, find=jaccard_join.live_entries):
        live.append(find(*args))
        return live[-1]

    monkeypatch.setattr(jaccard_join, "live_entries", counted)
    docs = [(k, f"one two three four five six seven x{k}") for k in range(20_000)]
    docs += [(30_000 + k, " ".join(f"c{j}" for j in range(40)) + f" y{k}") for k in range(300)]
    found = similarity_classes(table(spark, docs)).select("doc_id", "component_id").collect()
    assert all(r.component_id == min(r.doc_id, 30_000) for r in found)
    assert live[0].count() == 0
