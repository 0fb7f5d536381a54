"""Quality rules: word, line and repetition counts, and perplexity bands under a Kneser-Ney model of each language.

The model is over grams of five bytes as they are, so it grows with the corpus. Spark counts the grams of all different
lines of whole texts: each task sums its own before the shuffle, and only lines that several texts may share are moved. From the counts Spark makes interpolated, modified
Kneser-Ney tables (three discounts in each order, lower orders by the number of different predecessors): one row for each
gram and each context, sorted by their codes. Lookups are binary searches in sorted arrays.

Lines are dealt into two folds by their CRC32. Each fold has a model of its own, and a line is scored by the model of the
other one, so that no line, however often it is copied, vouches for itself.

A model of at most ``MAX_MODEL_ROWS`` rows is broadcast. A larger one stays where it is: texts are put into blocks, each
block asks for the rows that its grams need, and gets them as sorted arrays of its own. Both ways give the same scores.

A document's perplexity is held against its language's band: the median log perplexity of the documents that pass the
plain rules, less or plus ``WIDTH`` robust standard deviations. Its perplexity without any context, where bytes count by how
many different bytes stand before them, has an upper limit too: long contexts learn the patterns of junk that a corpus
repeats, and predict it well, but it is made of bytes that few others go before. Medians come from exact counts of
small bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from siren.llm.arrays import Texts, Words, inside, padded, windows
from siren.llm.rows import release, slices, written
from siren.operators.lookup import fits

ORDER, BITS, FOLDS = 5, 8, 2
#: A model beyond this is joined to blocks of texts of about so many bytes.
MAX_MODEL_ROWS, BLOCK_BYTES = 4_000_000, 1 << 25
#: Robust standard deviations: of the perplexity below and above its median, and of that without context above its own.
#: Set on one half of sf0.1's labels, so that at least 98% of its good documents and 97% of sf0.01's stay; README has shares.
WIDTH, LEAST_DEVIATION = (4.0, 12.0, 3.0), 0.02
BIN = 0.002
LOT = 4_000_000
#: Bits of the table of lines that several texts hold (16 MB), and of a part of it; a full table only moves more lines.
LINE_BITS, PART_BITS = 27, 17
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
BLANKS = "\t\n\x0b\x0c\r "
RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Codes of the grams that end at the positions."""
    code = data[at].astype(np.int64)
    for back in range(1, ORDER):
        code |= data[at - back].astype(np.int64) << (BITS * back)
    return code


def line_grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all grams of the lines, and how many each line has: one for each of its bytes."""
    data, starts, ends = padded(lines, ORDER - 1, lower=False)
    return grams(data, inside(len(data), starts, ORDER - 1)), ends - starts


def model_name(lang: str | None, fold: int) -> str:
    return f"{fold}" if lang is None else f"{fold}={lang}"


def fold_of(line: str) -> int:
    return crc32(line.encode()) % FOLDS


def gram_key(codes, order: int):
    """The key of a gram's own row, of arrays or columns."""
    return (codes & ((1 << BITS * order) - 1)) + (order << BITS * ORDER)


def context_key(codes, order: int):
    """The key of the row of what stands before a gram's last byte."""
    return ((codes & ((1 << BITS * order) - 1)) >> BITS) + ((ORDER + order) << BITS * ORDER)


def base_failed(n_words, n_repeat_words):
    """The plain rules, of columns or arrays."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


def _passing_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str | None, str]]]:
    """(lang, line) of every line of the texts that pass the plain rules, once for each text, in lists of bounded size.

    Texts that fail the plain rules are rejected anyway and do not count. NULL languages are one of their own.
    """
    release()
    for batch in batches:
        for part in slices(batch, "text", LOT):
            langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
            rules = text_rules(texts)
            failed = base_failed(rules["n_words"], rules["n_repeat_words"]).tolist()
            yield [(x, line) for t, x, f in zip(texts, langs, failed, strict=True) if not f for line in set(t.split("\n"))]


def _line_hashes(lines: list[tuple[str | None, str]]) -> np.ndarray:
    return np.array([xxh64_intdigest(line, crc32((lang or "").encode())) for lang, line in lines], np.uint64).view(np.int64)


def shared_marks(rows: DataFrame) -> np.ndarray:
    """Bits that tell which lines more than one text holds, by the lines' hashes; a few others are marked by chance.

    Only hashes are shuffled, and only a table of fixed size (16 MB) reaches the driver.
    """
    part_bits, cell_bits = PART_BITS, LINE_BITS

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines in _passing_lines(batches):
            hashes, n = np.unique(_line_hashes(lines), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n)], ["hash", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            cells = np.sort(batch.column("cell").to_numpy())
            for some in np.split(cells, np.flatnonzero(np.diff(cells >> part_bits)) + 1):
                if len(some):
                    bits = held.setdefault(int(some[0] >> part_bits), np.zeros(1 << part_bits - 3, np.uint8))
                    some = some & ((1 << part_bits) - 1)
                    np.bitwise_or.at(bits, some >> 3, (1 << (some & 7)).astype(np.uint8))
        arrays = [pa.array(list(held), pa.int64()), pa.array([bits.tobytes() for bits in held.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["part", "bits"])

    shared = rows.mapInArrow(hashed, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1")
    cells = shared.select(F.col("hash").bitwiseAND((1 << cell_bits) - 1).alias("cell"))
    cells = cells.repartition(F.shiftright("cell", part_bits))
    out = np.zeros(1 << cell_bits - 3, np.uint8)
    size = 1 << part_bits - 3
    for row in cells.mapInArrow(packed, "part long, bits binary").collect():
        out[row.part * size : (row.part + 1) * size] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """How often each gram occurs in the different lines of each language and fold: (model, gram, n).

    Every line of the texts that pass the plain rules counts once in each language. A text's copies, or a passage that many
    texts share, do not pass for fluent language, and how rows are dealt out has no part in it. Lines that only one text
    holds are counted where they are; only those that ``shared_marks`` marks are moved, to be made one. ``docs`` is read
    three times.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    marks = docs.sparkSession.sparkContext.broadcast(shared_marks(rows))
    mask = (1 << LINE_BITS) - 1

    def chosen(batches: Iterator[pa.RecordBatch], shared: bool) -> Iterator[list[tuple[str | None, str]]]:
        for lines in _passing_lines(batches):
            cells = _line_hashes(lines) & mask
            marked = (marks.value[cells >> 3] >> (cells & 7) & 1).astype(bool)
            yield [lines[k] for k in np.flatnonzero(marked == shared).tolist()]

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines in chosen(batches, True):
            found = set(lines)
            arrays = [pa.array([pair[k] for pair in found], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "line"])

    def counted(lots: Iterator[list[tuple[str | None, str]]]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            codes, index = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(index, np.concatenate([n for _, n in parts])).astype(np.int64)

        for some in lots:
            of_model: dict[str, list[str]] = {}
            for lang, line in some:
                of_model.setdefault(model_name(lang, fold_of(line)), []).append(line)
            for name, lines in of_model.items():
                parts = held.setdefault(name, [])
                parts.append(np.unique(line_grams(lines)[0], return_counts=True))
                if len(parts) == 16:
                    held[name] = [merged(parts)]
        for name, parts in held.items():
            codes, n = merged(parts)
            for k in range(0, len(codes), 1 << 16):
                some = slice(k, k + (1 << 16))
                arrays = [pa.array([name] * len(codes[some]), pa.string()), pa.array(codes[some]), pa.array(n[some])]
                yield pa.RecordBatch.from_arrays(arrays, ["model", "gram", "n"])

    def made_one(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str | None, str]]]:
        release()
        for batch in batches:
            for part in slices(batch, "line", LOT):
                yield list(zip(part.column("lang").to_pylist(), part.column("line").to_pylist(), strict=True))

    schema = "model string, gram long, n long"
    alone = rows.mapInArrow(lambda batches: counted(chosen(batches, False)), schema)
    shared = rows.mapInArrow(moved, "lang string, line string").distinct()
    counts = alone.unionAll(shared.mapInArrow(lambda batches: counted(made_one(batches)), schema))
    return counts.groupBy("model", "gram").agg(F.sum("n").alias("n"))


def discounts(ones: int, twos: int, threes: int, fours: int) -> list[float]:
    """What is taken from counts of 1, 2, and 3 or more; plain fractions where the counts of counts give none."""
    if not (ones and twos and threes):
        return [0.5, 0.75, 0.9]
    y = ones / (ones + 2 * twos)
    given = [1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), given, strict=True)]


def kneser_ney(counts: DataFrame) -> DataFrame:
    """Tables of all models, from the counts of their longest grams: (model, key, value), sorted by key in each file.

    A gram's value is its discounted count over its context's total; a context's is the weight of the shorter gram. In lower
    orders a gram counts by how many different bytes stood before it.
    """
    spark = counts.sparkSession
    orders = [counts.select("model", F.lit(ORDER).alias("order"), "gram", "n")]
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND((1 << BITS * order) - 1).alias("gram")
        fewer = orders[-1].groupBy("model", shorter).agg(F.count(F.lit(1)).alias("n"))
        orders.append(fewer.select("model", F.lit(order).alias("order"), "gram", "n"))
    every = orders[0]
    for some in orders[1:]:
        every = every.unionAll(some)
    every = written(every, "grams")
    times = [F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
    found = every.groupBy("model", "order").agg(*times).collect()
    taken = [(r.model, r.order, *discounts(r.n1, r.n2, r.n3, r.n4)) for r in found]
    taken = spark.createDataFrame(taken, "model string, order int, d1 double, d2 double, d3 double")
    every = every.join(F.broadcast(taken), ["model", "order"])  # five rows a model
    context = F.shiftright("gram", BITS)
    n = F.col("n")
    singles, pairs, more = (F.count_if(c) for c in (n == 1, n == 2, n > 2))
    weight = (singles * F.max("d1") + pairs * F.max("d2") + more * F.max("d3")) / F.sum("n")
    contexts = every.groupBy("model", "order", context.alias("context")).agg(F.sum("n").alias("total"), weight.alias("weight"))
    mine = n - F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
    known = every.withColumn("context", context).join(contexts, ["model", "order", "context"])
    shift = F.lit(1 << BITS * ORDER)
    rows = known.select("model", (F.col("gram") + F.col("order") * shift).alias("key"), (mine / F.col("total")).alias("value"))
    weights = contexts.select("model", (F.col("context") + (F.col("order") + ORDER) * shift).alias("key"), F.col("weight").alias("value"))
    rows = rows.unionAll(weights).withColumn("value", F.col("value").cast("float"))
    return written(rows.sortWithinPartitions("model", "key"), "model")


Arrays = tuple[np.ndarray, np.ndarray]


def sorted_arrays(rows: pa.Table) -> dict[str, Arrays]:
    """Each model's keys, sorted, and values."""
    names, keys, values = (rows.column(c) for c in ("model", "key", "value"))
    names = names.combine_chunks().dictionary_encode()
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    index = names.indices.to_numpy(zero_copy_only=False)
    keys, values = keys.to_numpy(), values.to_numpy()
    order = np.lexsort((keys, index))
    index, keys, values = index[order], keys[order], values[order]
    edges = np.searchsorted(index, np.arange(len(names.dictionary) + 1))
    return {
        name: (keys[edges[k] : edges[k + 1]], values[edges[k] : edges[k + 1]])
        for k, name in enumerate(names.dictionary.to_pylist())
    }


def log_probabilities(model: Arrays | None, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each gram's last byte behind the others, and without regard to them."""
    p = alone = np.full(len(codes), 1 / (1 << BITS))
    if model is None or not len(model[0]):
        return np.log(p), np.log(p)
    keys, values = model

    def value(wanted: np.ndarray, other: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], other)

    for order in range(1, ORDER + 1):
        p = value(gram_key(codes, order), 0.0) + value(context_key(codes, order), 1.0) * p
        alone = p if order == 1 else alone
    return np.log(p), np.log(alone)


def text_rules(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The plain counts of each text; NULL has none of anything."""
    held = Texts.of(pa.array(texts, pa.string()))
    words = Words.of(held)

    def per_text(marks: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marks)])
        return sums[held.ends] - sums[held.starts]

    character = (held.data & 0xC0) != 0x80
    blank = np.isin(held.data, list(b"\x20\x09\x0a\x0b\x0c\x0d"))
    hashes, first = windows(words.hashes, words.counts, 3)
    owner = words.text_of()
    key = hashes + owner[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, index, times = np.unique(key, return_inverse=True, return_counts=True)
    repeated = first[times[index] > 1]
    covered = np.zeros(len(words.hashes), bool)
    for k in range(3):
        covered[repeated + k] = True
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": per_text(character & ~blank),
        "n_symbols": per_text(_SYMBOL[held.data]),
        "n_dup_lines": np.array([duplicate_lines(t) for t in texts], np.int64),
        "n_repeat_words": np.bincount(owner[covered], minlength=len(texts)).astype(np.int64),
    }


def duplicate_lines(text: str | None) -> int:
    lines = (text or "").split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[str] = set()
    count = 0
    for line in lines:
        if line in seen and line.strip(BLANKS):
            count += 1
        seen.add(line)
    return count


SCORED = "doc_id long, lang string, " + ", ".join(f"{r} long" for r in RULES) + ", log_perplexity double, log_alone double"


def lines_to_score(texts: list[str | None], langs: list[str | None]) -> dict[str, tuple[list[int], list[str]]]:
    """For each model, the lines that it scores, and which text each is in."""
    out: dict[str, tuple[list[int], list[str]]] = {}
    for k, (text, lang) in enumerate(zip(texts, langs, strict=True)):
        for line in (text or "").split("\n"):
            owners, lines = out.setdefault(model_name(lang, (fold_of(line) + 1) % FOLDS), ([], []))
            owners.append(k)
            lines.append(line)
    return out


def scored_part(part: pa.RecordBatch, models: dict[str, Arrays]) -> pa.RecordBatch:
    """Rows of ``SCORED``; the log perplexities are of all bytes of all lines, NULL without any."""
    langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
    total, total_alone, size = (np.zeros(len(texts)) for _ in range(3))
    for name, (owners, lines) in lines_to_score(texts, langs).items():
        codes, lengths = line_grams(lines)
        different, index = np.unique(codes, return_inverse=True)
        owner = np.repeat(owners, lengths)
        log_p, log_alone = log_probabilities(models.get(name), different)
        total += np.bincount(owner, log_p[index], len(texts))
        total_alone += np.bincount(owner, log_alone[index], len(texts))
        size += np.bincount(owner, minlength=len(texts))
    with np.errstate(invalid="ignore"):
        means = [-total / size, -total_alone / size]
    rules = text_rules(texts)
    arrays = [part.column("doc_id"), part.column("lang"), *(pa.array(rules[r]) for r in RULES)]
    arrays += [pa.array(mean, from_pandas=True) for mean in means]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang", *RULES, "log_perplexity", "log_alone"])


def _blocks(rows: DataFrame) -> DataFrame:
    """The texts with the number of their block: rows of one task, one after the other, of about ``BLOCK_BYTES``."""
    block_bytes = BLOCK_BYTES

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in slices(batch, "text", min(LOT, block_bytes)):
                yield part.append_column("block", pa.array([block] * part.num_rows, pa.int64()))
                size += part.column("text").nbytes
                if size >= block_bytes:
                    block, size = block + 1, 0

    return written(rows.mapInArrow(numbered, "doc_id long, lang string, text string, block long"), "blocks")


def _wanted(blocks: DataFrame) -> DataFrame:
    """The rows that each block needs of the models: (block, model, key)."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], np.ndarray] = {}

        def put_out() -> Iterator[pa.RecordBatch]:
            for (block, name), codes in held.items():
                keys = [key(codes, order) for order in range(1, ORDER + 1) for key in (gram_key, context_key)]
                keys = np.unique(np.concatenate(keys))
                for k in range(0, len(keys), 1 << 16):
                    some = keys[k : k + (1 << 16)]
                    arrays = [pa.array(np.full(len(some), block)), pa.array([name] * len(some), pa.string()), pa.array(some)]
                    yield pa.RecordBatch.from_arrays(arrays, ["block", "model", "key"])
            held.clear()

        for batch in batches:
            for part in slices(batch, "text", LOT):
                numbers = part.column("block").to_numpy(zero_copy_only=False)
                for block in np.unique(numbers).tolist():
                    if held and all(block != other for other, _ in held):
                        yield from put_out()
                    mine = part.filter(pa.array(numbers == block))
                    for name, (_, lines) in lines_to_score(mine.column("text").to_pylist(), mine.column("lang").to_pylist()).items():
                        before = held.get((block, name), np.zeros(0, np.int64))
                        held[block, name] = np.union1d(before, line_grams(lines)[0])
        yield from put_out()

    return blocks.mapInArrow(asked, "block long, model string, key long").distinct()


def score_texts(docs: DataFrame, model: DataFrame, max_rows: int = MAX_MODEL_ROWS) -> DataFrame:
    """Per row: doc_id, lang, the plain counts, and the log perplexity of its lines' bytes (NULL without any)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
    )
    if fits(model, max_rows, max_rows * 64):
        shared = docs.sparkSession.sparkContext.broadcast(sorted_arrays(model.toArrow()))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", LOT):
                    yield scored_part(part, shared.value)

        return rows.mapInArrow(scored, SCORED)

    def scored_block(texts: pa.Table, answers: pa.Table) -> pa.Table:
        models = sorted_arrays(answers) if answers.num_rows else {}
        parts = [part for batch in texts.to_batches() for part in slices(batch, "text", LOT)]
        return pa.Table.from_batches([scored_part(part, models) for part in parts])

    blocks = _blocks(rows)
    answers = _wanted(blocks).join(model, ["model", "key"]).select("block", "model", "key", "value")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored_block, SCORED)


def _median(values: np.ndarray, weights: np.ndarray) -> float:
    order = np.argsort(values)
    upto = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(upto, upto[-1] / 2)])


def middles(scored: DataFrame, column: str) -> dict[str | None, tuple[float, float]]:
    """Median and robust standard deviation of each language, from the documents that pass the plain rules."""
    bins = F.round(F.col(column) / BIN).cast("long").alias("bin")
    passed = scored.where(f"NOT base_failed AND {column} IS NOT NULL")
    counts = passed.groupBy("lang", bins).agg(F.count(F.lit(1)).alias("n")).collect()  # some thousand bins a language
    out = {}
    for lang in {r.lang for r in counts}:
        values = np.array([r.bin * BIN for r in counts if r.lang == lang])
        weights = np.array([r.n for r in counts if r.lang == lang])
        middle = _median(values, weights)
        out[lang] = middle, max(1.4826 * _median(np.abs(values - middle), weights), LEAST_DEVIATION)
    return out


def quality(docs: DataFrame, width: tuple[float, float, float] = WIDTH, max_model_rows: int = MAX_MODEL_ROWS) -> DataFrame:
    """Per row: the plain counts, ``base_failed``, ``kept``, and the log perplexity behind the verdict.

    NULL and empty texts have counts of 0 and fail the plain rules; no text is cut. Rows repeat as given. Where no
    document of a language passes the plain rules, it has no band and keeps none.
    """
    model = kneser_ney(written(count_grams(docs), "counts"))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    scored = written(score_texts(docs, model, max_model_rows).withColumn("base_failed", failed), "perplexity")
    alone = middles(scored, "log_alone")
    limits = [
        (lang, middle - width[0] * deviation, middle + width[1] * deviation, alone[lang][0] + width[2] * alone[lang][1])
        for lang, (middle, deviation) in middles(scored, "log_perplexity").items()
    ]
    limits = docs.sparkSession.createDataFrame(limits, "_lang string, _low double, _high double, _alone double")
    judged = scored.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    inside_band = F.col("log_perplexity").between(F.col("_low"), F.col("_high")) & (F.col("log_alone") <= F.col("_alone"))
    kept = ~F.col("base_failed") & F.coalesce(inside_band, F.lit(False))
    return judged.select("doc_id", *RULES, "base_failed", kept.alias("kept"), "log_perplexity", "log_alone")
