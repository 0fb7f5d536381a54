"""Toxicity by a logistic classifier whose score must not change when identity terms are swapped.

Features are the presence of a word or of a word's first four or five bytes. Those that labels tell apart (a log odds
ratio of at least ``MIN_Z`` standard errors) are counted by Spark over a bounded sample of labelled texts. The fit
minimises the log loss, a ridge term, and for each labelled text with an identity term the squared changes of its score
when its terms are swapped for others of their group, and for the group's neutral word: a term that merely stands
beside insults gets no weight of its own, so neutral mentions of a group stay below the threshold.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siren.llm.arrays import IN_LETTERS, Texts, Words, mix, prefix_hashes
from siren.llm.rows import held, id_and_text, lots, release, slices, smallest, written

#: Labelled texts that are learned from, of each label: those whose ids have the smallest hashes.
SAMPLE = {0: 12_000, 1: 6_000}
MIN_Z, MIN_TEXTS, MAX_FEATURES = 3.0, 3, 4_096
RIDGE, SWAP_WEIGHT, STEPS, RATE = 3e-4, 4.0, 300, 0.1
PREFIXES = (4, 5)
LOT = 2_000_000

#: Terms that stand for one another, by group, behind a neutral word that can take their place.
IDENTITY_TERMS = (
    ("people", "women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("people", "muslims", "jews", "christians", "hindus", "buddhists", "atheists", "catholics"),
    ("local", "muslim", "jewish", "christian", "hindu", "buddhist", "atheist", "catholic"),
    ("local", "gay", "lesbian", "bisexual", "straight", "queer"),
    ("local", "black", "white", "asian", "latino", "african", "european", "arab"),
    ("people", "immigrants", "refugees", "foreigners", "natives"),
    ("leute", "frauen", "männer"), ("leute", "muslime", "juden", "christen"), ("leute", "flüchtlinge", "ausländer"),
    ("gens", "femmes", "hommes"), ("gens", "musulmans", "juifs", "chrétiens"), ("gens", "immigrés", "étrangers"),
    ("personas", "mujeres", "hombres"), ("personas", "musulmanes", "judíos", "cristianos"),
    ("personas", "inmigrantes", "extranjeros"),
)
_NEXT = {term: g[1:][(k + 1) % (len(g) - 1)] for g in IDENTITY_TERMS for k, term in enumerate(g[1:])}
_NEUTRAL = {term: g[0] for g in IDENTITY_TERMS for term in g[1:]}
_TERM = re.compile(r"(?<![^\W\d_])(" + "|".join(sorted(_NEXT, key=len, reverse=True)) + r")(?![^\W\d_])", re.IGNORECASE)


def swapped(text: str) -> list[str]:
    """The text with each identity term replaced by the next one of its group, and by its neutral word; none without."""
    if not _TERM.search(text):
        return []
    return [_TERM.sub(lambda found: to[found.group().lower()], text) for to in (_NEXT, _NEUTRAL)]


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features, and the number of the text each occurs in; they may repeat."""
    held = Texts.of(pa.array(texts, pa.string()), lower=True)
    words = Words.of(held, IN_LETTERS)
    text = words.text_of()
    hashes, owners = [words.hashes], [text]
    for k in PREFIXES:
        longer = words.ends - words.starts > k
        starts = words.starts[longer]
        hashes.append(mix(prefix_hashes(held.data, starts, starts + k) ^ np.uint64(k)))
        owners.append(text[longer])
    return np.concatenate(hashes), np.concatenate(owners)


def _vectors(texts: list[str | None], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once; ``vocabulary`` is sorted."""
    hashes, owners = features(texts)
    if not len(vocabulary) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    maybe = np.zeros(1 << 16, bool)
    maybe[vocabulary & np.uint64(0xFFFF)] = True
    near = maybe[hashes & np.uint64(0xFFFF)]
    hashes, owners = hashes[near], owners[near]
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    hit = vocabulary[at] == hashes
    return np.divmod(np.unique(owners[hit] * len(vocabulary) + at[hit]), len(vocabulary))


class Scorer:
    def __init__(self, model: dict):
        self._vocabulary, self._weights, self._bias = model["vocabulary"], model["weights"], model["bias"]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for part in lots(texts, LOT):
            text, feature = _vectors(part, self._vocabulary)
            logits = self._bias + np.bincount(text, self._weights[feature], minlength=len(part))
            out.append(1 / (1 + np.exp(-np.clip(logits, -40, 40))))
        return np.concatenate([np.zeros(0), *out])


def fit(
    rows: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[int, np.ndarray]], n: int, swap_weight: float
) -> tuple[np.ndarray, float]:
    """Weights and bias. ``rows``: each text's features; ``swaps``: (row, features of the row with swapped terms)."""

    def flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = [len(x) for x in lists]
        return np.repeat(np.arange(len(lists)), sizes), np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)

    if not len(labels):
        return np.zeros(n), float("-inf")
    owner, feature = flat(rows)
    other_owner, other_feature = flat([x for _, x in swaps])
    base = np.array([k for k, _ in swaps], np.int64)
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    weights, bias = np.zeros(n), float(np.log(rate / (1 - rate)))
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        score = 1 / (1 + np.exp(-np.clip(bias + np.bincount(owner, weights[feature], len(rows)), -40, 40)))
        slope = (score - labels) / len(labels)  # of the loss by each text's logit
        other_slope = np.zeros(len(swaps))
        if len(swaps):
            logits = bias + np.bincount(other_owner, weights[other_feature], len(swaps))
            other = 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
            change = 2 * swap_weight * (score[base] - other) / len(swaps)
            np.add.at(slope, base, change * score[base] * (1 - score[base]))
            other_slope = -change * other * (1 - other)
        gradient = np.bincount(feature, slope[owner], n) + np.bincount(other_feature, other_slope[other_owner], n)
        gradient = np.append(gradient + RIDGE * weights, slope.sum() + other_slope.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - float(move[-1])
    return weights, bias


def train(
    docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None, swap_weight: float = SWAP_WEIGHT
) -> dict:
    """A model from the labelled texts: at most ``sample[label]`` of each label, however many there are.

    Rows of ``labels`` without id or label are not used; an id with both labels is toxic. With no labels, or only one,
    no feature is told apart and the model knows the rate alone.
    """
    limits = sample or SAMPLE
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.where(F.col("toxic").isin(0, 1)).withColumn("_hash", F.xxhash64("doc_id"))
    limit = F.when(F.col("toxic") == 1, limits[1]).otherwise(limits[0])
    chosen = smallest(written(marked, "marked"), "toxic", "_hash", limit, "doc_id").select("doc_id", "toxic")
    # An id that many rows share gives one text, so the sample stays bounded.
    texts = id_and_text(docs).where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    texts = written(texts.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")), "labelled")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch, "text", LOT):
                toxic = np.array(part.column("toxic").to_pylist(), np.int64)
                hashes, owners = features(part.column("text").to_pylist())
                pairs = np.unique(np.stack([hashes, owners.astype(np.uint64)], 1), axis=0)
                found, index = np.unique(pairs[:, 0], return_inverse=True)
                marks = toxic[pairs[:, 1].astype(np.int64)]
                ones = np.bincount(index, marks, len(found)).astype(np.int64)
                every = np.bincount(index, minlength=len(found)).astype(np.int64)
                arrays = [pa.array(found.view(np.int64)), pa.array(ones), pa.array(every - ones)]
                yield pa.RecordBatch.from_arrays(arrays, ["feature", "ones", "zeros"])

    counts = texts.mapInArrow(counted, "feature long, ones long, zeros long").groupBy("feature")
    counts = counts.agg(F.sum("ones").alias("a"), F.sum("zeros").alias("b"))
    total = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = F.lit(total.get(1, 0)), F.lit(total.get(0, 0))
    a, b, c, d = (x + 0.5 for x in (F.col("a"), F.col("b"), ones - F.col("a"), zeros - F.col("b")))
    z = F.log(a * d / (b * c)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    told = counts.where(F.col("a") + F.col("b") >= MIN_TEXTS).withColumn("z", F.abs(z)).where(F.col("z") >= MIN_Z)
    best = told.orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).select("feature").collect()
    terms = sorted({*_NEXT, *_NEUTRAL.values()})
    term_hashes, _ = features(terms)
    vocabulary = np.array([r.feature for r in best], np.int64).view(np.uint64)
    vocabulary = np.unique(np.concatenate([vocabulary, term_hashes[: len(terms)]]))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(given: list[str]) -> list[list[int]]:
            text, feature = _vectors(given, vocabulary)
            ends = np.searchsorted(text, np.arange(1, len(given)))
            return [x.tolist() for x in np.split(feature, ends)]

        for batch in batches:
            for part in slices(batch, "text", LOT):
                given = part.column("text").to_pylist()
                others = [swapped(t) for t in given]
                found = iter(lists([t for texts in others for t in texts]))
                swap_lists = [[next(found) for _ in texts] for texts in others]
                kind = pa.list_(pa.int32())
                arrays = [part.column("toxic"), pa.array(lists(given), kind), pa.array(swap_lists, pa.list_(kind))]
                yield pa.RecordBatch.from_arrays(arrays, ["toxic", "given", "swapped"])

    # At most the sample's size of rows.
    fitted = texts.orderBy("doc_id").mapInArrow(vectors, "toxic int, given array<int>, swapped array<array<int>>").toPandas()
    rows = [np.asarray(x, np.int64) for x in fitted["given"]]
    swaps = [(k, np.asarray(x, np.int64)) for k, every in enumerate(fitted["swapped"]) for x in every]
    labels_seen = fitted["toxic"].to_numpy(float)
    weights, bias = fit(rows, labels_seen, swaps, len(vocabulary), swap_weight)
    return {"vocabulary": vocabulary, "weights": weights, "bias": bias}


def with_toxicity(docs: DataFrame, model: dict, text_col: str = "text", name: str = "_toxicity") -> DataFrame:
    """Add the score (0 to 1) of every whole text; NULL counts as empty and an empty text has the model's base rate."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = held(key, lambda: Scorer(shared.value))
        for batch in batches:
            yield pd.Series(scorer.scores(batch.tolist()), dtype=float)

    return docs.withColumn(name, score(F.col(text_col).cast("string")))


def held_out(modulus: int = 4, remainder: int = 2) -> Column:
    """Whether a document is kept out of training, by the crc32 of its id as text; one without an id is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Learn from the labels of documents that are not held out, and score every document. Rows repeat as given."""
    model = train(docs, labels.where(~held_out()))
    return with_toxicity(id_and_text(docs), model).select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("_toxicity").alias("score"),
        (F.col("_toxicity") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score stays below the threshold."""
    model = train(docs, labels.where(~held_out()))
    return with_toxicity(docs, model).where(F.col("_toxicity") < threshold).select(docs.columns)
