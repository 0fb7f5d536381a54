"""Spelling variants: words that differ by one edit, by asymmetric q-chunks, and the frequent form each leads to.

Of a pair, one word contributes two disjoint chunks, its first q code points and the next q, where q is half its length. One
edit leaves one of the two whole and moves it by one place at most, so the other word holds it as a gram within shift one.
Grams at other places, and of other lengths than a partner's chunk can have, meet nothing and are not made. The smaller word
of a pair gives the chunks, the larger one the grams; what meets is verified by its edit distance. Keys name the length of
the chunk's word and the chunk's place, so lists are as short as the method allows; long ones are dealt over tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siren.llm.rows import id_and_text, release, written
from siren.operators.lookup import lookup_join

MIN_LENGTH, MIN_COUNT, RATIO, TYPO_EVERY = 6, 5, 5, 199
#: Different words that a task counts before it hands them on.
HELD_WORDS = 200_000
PIECE_CHARS = 1_000_000
#: Chunks of one key in one task.
SALT_ROWS = 4096

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def run_counts(text: str, piece_chars: int = PIECE_CHARS) -> Counter[str]:
    """How often each run of letters occurs in a text, A-Z in lower case; a long text is read in pieces."""
    raw: Counter[str] = Counter()
    start = 0
    while len(text) - start > piece_chars:
        end = start + piece_chars
        within = _RUN.match(text, end)
        end = within.end() if within else end  # never within a run
        raw.update(_RUN.findall(text[start:end]))
        start = end
    raw.update(_RUN.findall(text[start:] if start else text))
    out: Counter[str] = Counter()
    for run, n in raw.items():
        out[run.translate(_LOWER)] += n
    return out


def misspelt(doc_id: int | None, run: str, every: int = TYPO_EVERY) -> str:
    """The run, or the run without one code point where ``every`` divides the crc32 of ``<doc_id>:<run>``."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            arrays = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for run, n in run_counts(text.as_py() or "").items():
                    word = misspelt(doc_id, run)
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield handed()
        yield handed()

    counted = id_and_text(docs).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def chunks_of(word: str) -> list[tuple[int, int, str]]:
    """(length, chunk, text) of a word's two chunks."""
    length, q = len(word), len(word) // 2
    return [(length, 0, word[:q]), (length, 1, word[q : 2 * q])]


def grams_of(word: str) -> list[tuple[int, int, str]]:
    """(length, chunk, text) of the chunks, of words one edit away, that this word may hold within shift one."""
    out = set()
    for length in range(len(word) - 1, len(word) + 2):
        q = length // 2
        for chunk in (0, 1):
            for at in range(max(0, chunk * q - 1), chunk * q + 2):
                if at + q <= len(word):
                    out.add((length, chunk, word[at : at + q]))
    return sorted(out)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b: every two words that differ by exactly one inserted, deleted or replaced code point, once."""

    def keyed(batches: Iterator[pa.RecordBatch], make, name: str) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                rows = [(*key, w) for w in batch.column("word").slice(start, 4096).to_pylist() for key in make(w)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
                types = [pa.int32(), pa.int32(), pa.string(), pa.string()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["length", "chunk", "gram", name])

    key = ["length", "chunk", "gram"]
    of_key = "length int, chunk int, gram string, "
    chunks = words.select("word").mapInArrow(lambda batches: keyed(batches, chunks_of, "a"), of_key + "a string")
    grams = words.select("word").mapInArrow(lambda batches: keyed(batches, grams_of, "b"), of_key + "b string")
    # Long lists of chunks are dealt over as many salts as they need, and the grams of their key go to each.
    salts = written(chunks.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts")), "salts")
    long_lists = salts.where("salts > 1")
    dealt = chunks.join(long_lists, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).cast("int")
    )
    met = grams.join(salts, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    met = met.drop("salts").join(dealt.drop("salts"), [*key, "_salt"])
    one_edit = (F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)
    return met.where(one_edit).select("a", "b").distinct()


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    ``form`` is the near word with the largest ``n`` (ties: the first by code points) if that is ``ratio`` times the
    word's own or more, else NULL; ``root`` is where forms lead to, the word itself if it has none. NULL and empty texts
    have no words; a NULL ``doc_id`` counts as an empty one; repeated rows count each time. Other columns are not read.
    """
    words = written(vocabulary(docs), "words")
    pairs = written(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"))
    both = both.unionAll(both.select(F.col("other").alias("word"), F.col("word").alias("other")))
    counted = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    # The largest n first, then the smallest word.
    best = F.min(F.struct((-F.col("other_n")).alias("_n"), F.col("other").alias("_word"))).alias("_best")
    near = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    leads = -F.col("_best._n") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(leads, F.col("_best._word")).alias("form"), F.when(leads, -F.col("_best._n")).alias("form_n"),
    )
    found = written(found, "forms")
    roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps taken; counts grow by ``ratio`` with each step, so rounds are few
        roots = written(roots, "roots")
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = written(lookup_join(roots, onward, "root", spread_by="word"), "moved")
        if moved.where("_next IS NOT NULL").isEmpty():
            break
        roots = moved.select("word", F.coalesce("_next", "root").alias("root"))
    return found.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
