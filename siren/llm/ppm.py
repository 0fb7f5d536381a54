"""Language ID by prediction by partial matching: the language whose frozen model codes a text shortest.

Each language has a tree of byte contexts, up to ``ORDER`` bytes long, with how often each byte followed. A byte is
coded in the longest context the tree has; a byte that never followed there costs an escape and is coded in the next
shorter context, at last as one of 256 equally likely bytes. With c of n occurrences of a context followed by the byte
and d different bytes, the byte has c / (n + d) and the escape d / (n + d). Statistics are frozen after training, so
the cost of a byte depends on its context alone: costs of all contexts of all languages are laid out in one table and
a text's code length is a sum of looked-up costs, exact but for floating point.

Texts are coded in UTF-8 with A-Z in lower case, as if they stood behind line breaks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siren.llm.arrays import inside, padded
from siren.llm.rows import held, id_and_text, lots, release, slices, smallest, written

ORDER = 3
#: Different training texts per language, those with the smallest hashes; every byte of them counts, once.
SAMPLE = 1_500
#: Contexts per language that are kept, the most frequent ones; each must have been seen so often.
MAX_CONTEXTS, MIN_CONTEXT = 12_000, 4
UNKNOWN = "und"
#: Bytes that are looked up at once.
SLICE = 1_000_000


def _counted(sample: DataFrame) -> DataFrame:
    """How often each byte followed each context of each length: (lang, size, gram, n), gram with the byte lowest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                langs = np.array(part.column("lang").to_pylist(), object)
                texts = np.array(part.column("text").to_pylist(), object)
                for lang in set(langs.tolist()):
                    data, starts, ends = padded(texts[langs == lang].tolist(), ORDER)
                    at = inside(len(data), starts, ORDER)
                    wide = data.astype(np.int64)
                    for size in range(ORDER + 1):
                        gram = wide[at]
                        for back in range(1, size + 1):
                            gram = gram | wide[at - back] << (8 * back)
                        grams, n = np.unique(gram, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(grams), pa.string()), pa.array(np.full(len(grams), size, np.int32)),
                             pa.array(grams), pa.array(n.astype(np.int64))],
                            ["lang", "size", "gram", "n"],
                        )

    grams = sample.mapInArrow(count, "lang string, size int, gram long, n long")
    return grams.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, sample: int = SAMPLE, max_contexts: int = MAX_CONTEXTS) -> dict:
    """Counts of each language's contexts, from (lang, text) rows; at most ``max_contexts`` contexts a language."""
    rows = labelled.select(
        F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("_hash"),
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    # Copies are one text, before the ranking and in the sample.
    hashes = written(rows.select("lang", "_hash").distinct(), "hashes")
    limits = smallest(hashes, "lang", "_hash", sample).groupBy("lang").agg(F.max("_hash").alias("_limit"))
    limits = labelled.sparkSession.createDataFrame(limits.collect(), limits.schema)  # one row per language
    chosen = rows.join(F.broadcast(limits), "lang").where("_hash <= _limit").select("lang", "text").distinct()
    counts = _counted(chosen)
    context = F.shiftright("gram", 8)
    totals = counts.groupBy("lang", "size", context.alias("context")).agg(F.sum("n").alias("total"))
    best = Window.partitionBy("lang").orderBy(F.desc(F.col("size") == 0), F.desc("total"), "size", "context")
    kept = totals.where((F.col("total") >= MIN_CONTEXT) | (F.col("size") == 0)).withColumn(
        "_rank", F.row_number().over(best)
    )
    kept = kept.where(F.col("_rank") <= max_contexts).select("lang", "size", "context")
    model = counts.withColumn("context", context).join(kept, ["lang", "size", "context"])
    model = model.select("lang", "size", "gram", "n").toPandas().sort_values(["lang", "size", "gram"])
    languages = sorted(model["lang"].unique().tolist())
    return {
        "languages": languages,
        "lang": np.searchsorted(languages, model["lang"].to_numpy(str)).astype(np.int32) if languages else [],
        "size": model["size"].to_numpy(np.int32),
        "gram": model["gram"].to_numpy(np.int64),
        "n": model["n"].to_numpy(np.int64),
    }


class Scorer:
    """Code lengths of texts under every language of a model.

    Contexts are numbers whose digits are classes of bytes, the last byte lowest. A kept context's shorter ends are
    kept too, for they are at least as frequent; so each context's costs follow from those of its end.
    """

    def __init__(self, model: dict):
        self.languages = model["languages"]
        lang, size, gram, n = (np.asarray(model[k], np.int64) for k in ("lang", "size", "gram", "n"))
        seen = np.unique(np.append(gram & 255, ord("\n")))
        self._class = np.zeros(256, np.int64)  # class 0: bytes that training never saw
        self._class[seen] = np.arange(1, len(seen) + 1)
        self._width = width = len(seen) + 1
        byte = self._class[gram & 255]
        context = sum(self._class[gram >> (8 * k) & 255] * width ** (k - 1) for k in range(1, ORDER + 1))
        context %= width**size
        costs = np.full((1, width, len(self.languages)), 8.0, np.float32)
        tables, self._row = [costs], np.zeros(1, np.int32)
        before = 0
        for length in range(ORDER + 1):
            at = size == length
            values, index = np.unique(context[at], return_inverse=True)
            if length:
                self._row = np.tile(self._row, width)
                costs = tables[-1][self._row[values] - before] if len(values) else costs[:0]
                before += len(tables[-1])
                self._row[values] = before + np.arange(len(values))
                tables.append(costs)
            for k in range(len(self.languages)):
                mine = lang[at] == k
                row, sym, times = index[mine], byte[at][mine], n[at][mine]
                total = np.bincount(row, times, len(costs))
                different = np.bincount(row, minlength=len(costs))
                known = different > 0
                escape = np.log2((total[known] + different[known]) / different[known])
                costs[known, :, k] += escape[:, None]
                costs[row, sym, k] = np.log2((total[row] + different[row]) / times)
        costs = np.concatenate(tables)
        self._costs = costs.reshape(len(costs) * width, len(self.languages))

    def bits(self, texts: list[str | None]) -> np.ndarray:
        """Code lengths: a row per text, a column per language."""
        data, starts, ends = padded(texts, ORDER)
        marks = np.unique(np.concatenate([starts, ends]))
        sums = np.zeros((len(marks), len(self.languages)))
        total = np.zeros(len(self.languages))
        for low in range(ORDER, len(data), SLICE):
            high = min(len(data), low + SLICE)
            classes = self._class[data[low - ORDER : high]]
            context = sum(classes[ORDER - k : len(classes) - k] * self._width ** (k - 1) for k in range(1, ORDER + 1))
            cells = self._row[context].astype(np.int64) * self._width + classes[ORDER:]
            running = np.cumsum(self._costs[cells], axis=0, dtype=np.float64)
            inside = (marks >= low) & (marks < high)
            # What comes before a mark: the sum up to the byte in front of it.
            index = marks[inside] - low
            sums[inside] = total + np.where(index[:, None] > 0, running[index - 1], 0)
            total = total + running[-1]
        sums[marks >= len(data)] = total
        return sums[np.searchsorted(marks, ends)] - sums[np.searchsorted(marks, starts)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text, and its share of the probability that the models give the text."""
        bits = self.bits(texts)
        langs, scores = [], []
        for text, lengths in zip(texts, bits, strict=True):
            if not self.languages or not text or not any(map(str.isalpha, text)):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(np.argmin(lengths))
            langs.append(self.languages[best])
            scores.append(float(1 / np.exp2(np.maximum(lengths[best] - lengths, -1000)).sum()))
        return langs, scores


def with_language(docs: DataFrame, model: dict, text_col: str = "text", name: str = "_language") -> DataFrame:
    """Add a column struct(lang, score). NULL texts and texts without a letter are ``und`` with score 0.

    Ties go to the language that sorts first; with no training text at all every text is ``und``. Rows are scored one
    by one, whole, in parts of bounded size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = held(key, lambda: Scorer(shared.value))
        for batch in batches:
            langs, scores = [], []
            for part in lots(batch.tolist(), SLICE):
                more = scorer.predict(part)
                langs += more[0]
                scores += more[1]
            yield pd.DataFrame({"lang": pd.Series(langs, dtype=object), "score": pd.Series(scores, dtype=float)})

    return docs.withColumn(name, predict(F.col(text_col).cast("string")))


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a document is kept out of training, by the crc32 of its id as text; one without an id is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from the documents that are not held out and have a language, and predict every document's."""
    model = train(docs.where(~held_out(5, 0)), sample)
    rows = with_language(id_and_text(docs), model)
    return rows.select(
        "doc_id",
        held_out(5, 0).alias("held_out"),
        F.col("_language.lang").alias("lang_pred"),
        F.col("_language.score").alias("score"),
    )


def accepted(docs: DataFrame, min_score: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The documents whose language the models tell: some letter, and a share of at least ``min_score``."""
    model = train(docs.where(~held_out(5, 0)), sample)
    rows = with_language(docs, model)
    return rows.where((F.col("_language.lang") != UNKNOWN) & (F.col("_language.score") >= min_score)).select(docs.columns)
