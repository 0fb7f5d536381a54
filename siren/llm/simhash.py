"""Near duplicates by SimHash fingerprints, found by the generalised pigeonhole principle.

The 64 bits are dealt into ``m`` parts, correlated bits into one part. If each part i has a threshold t_i (-1: not probed)
and the t_i + 1 add up to ``distance`` + 1, a fingerprint within the distance differs in at most t_i bits of some part i.
Every fingerprint gets thresholds of its own: a dynamic program over the parts spends the budget where the counts of part
values promise the fewest candidates, so crowded values are passed over. It probes the values within t_i of its own in
each part, and what it meets is verified on all 64 bits.

Copies and equal fingerprints are one entry. Dense clusters of different fingerprints are not paired: all fingerprints
within half the distance of a common point are linked, so each is linked to the smallest one there, which takes a fixed
number of rows for each fingerprint. Values whose fingerprints form one component by that are left out; of values that stay
too crowded to pair, all fingerprints are linked around the edges between two points, which finds the odd distance.
Every link that matters for a component is found, whatever the data; counts are estimates that change no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siren.llm.components import components
from siren.llm.rows import id_and_text, release, slices, written

DISTANCE, SHINGLE_WORDS, SEED = 3, 3, 42
BITS = 64
#: Bits of a part that its counts are kept by; 65,536 counts a part are all that reaches the driver.
COUNTED_BITS = 16
#: A row that is shuffled costs as much as so many comparisons.
ROW_COST = 16
#: Values with more comparisons than this for each of their rows have their fingerprints linked around points first.
CROWDED = 128
#: Fingerprints with more rows than this, or 1/10,000 of all rows, are joined by broadcast.
HEAVY_ROWS = 100_000
#: Probes of one value in one task.
SALT_ROWS = 4096
PIECE_BYTES = 1_000_000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes, size: int) -> Iterator[bytes]:
    """Parts of a text that end between words, of about ``size`` bytes."""
    start = 0
    while len(text) - start > size:
        space = _SPACE.search(text, start + size)
        if space is None:
            break
        yield text[start : space.start()]
        start = space.end()
    yield text[start:]


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, piece_bytes: int = PIECE_BYTES) -> int:
    """The fingerprint of a text; of a long one, pieces are counted one after the other."""
    ones, n, carried = np.zeros(BITS, np.int64), 0, []
    for piece in _pieces((text or "").encode().lower(), piece_bytes):  # of bytes: A-Z only
        found = carried + _WORD.findall(piece)
        carried = found[max(0, len(found) - words + 1) :]
        if len(found) >= words:
            hashes = _hashes(found, words)
            n += len(hashes)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(carried), SEED) if carried else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _hashes(found: list[bytes], words: int) -> np.ndarray:
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    lengths = np.array([len(w) for w in found]) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(found) - words + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], "<u8")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of each row; NULL, empty and blank texts have 0."""

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch, "text", 8_000_000):
                found = np.array([fingerprint(text.as_py(), words) for text in part.column("text")], "<u8")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(of_texts, "doc_id long, fp long")


def ball(width: int, radius: int) -> int:
    """How many values of ``width`` bits are within ``radius`` of one."""
    return sum(comb(width, k) for k in range(radius + 1))


def masks(bits: list[int], radius: int) -> np.ndarray:
    """What to flip to reach every value within ``radius``."""
    return np.array([sum(1 << b for b in some) for k in range(radius + 1) for some in combinations(bits, k)], np.uint64)


def part_count(n: int, distance: int) -> int:
    """How many parts are cheapest for ``n`` fingerprints whose bits are even."""

    def cost(m: int) -> float:
        widths = [BITS // m + (k < BITS % m) for k in range(m)]
        radius = [(distance + 1) // m - 1 + (k < (distance + 1) % m) for k in range(m)]
        sizes = [ball(w, t) for w, t in zip(widths, radius, strict=True)]
        return ROW_COST * sum(sizes) + n * sum(s / 2**w for s, w in zip(sizes, widths, strict=True))

    # Parts of more than 32 bits would not fit beside their number.
    return min(range(2, max(2, distance + 1) + 1), key=cost)


def grouped_bits(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Bits in ``m`` parts, those that go together in one: each part grows from the closest pair that is left.

    ``together[i, j]`` is how many fingerprints have both bits.
    """
    share = together / max(n, 1)
    single = share.diagonal()
    spread = np.sqrt(np.maximum(single * (1 - single), 1e-12))
    close = np.abs(share - np.outer(single, single)) / np.outer(spread, spread)
    np.fill_diagonal(close, 0)
    left, parts = list(range(len(close))), []
    for k in range(m):
        size = -(-len(left) // (m - k))
        part: list[int] = []
        while len(part) < size:
            if part:
                gain = close[np.ix_(left, part)].sum(axis=1)
            else:
                gain = close[np.ix_(left, left)].max(axis=1)
            part.append(left.pop(int(np.argmax(gain))))
        parts.append(part)
    return parts


def values_of(prints: np.ndarray, part: list[int]) -> np.ndarray:
    """The value of a part in each fingerprint."""
    out = np.zeros(len(prints), np.uint64)
    for place, bit in enumerate(part):
        out |= ((prints >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
    return out


def within(counts: np.ndarray, width: int, distance: int) -> np.ndarray:
    """[t, value]: about how many fingerprints differ from a value of ``width`` bits in at most t bits.

    ``counts`` are by the lowest bits of values; the bits above them are taken as even.
    """
    bits = len(counts).bit_length() - 1
    at = np.arange(len(counts))
    shells = [counts.astype(float)]
    for t in range(1, distance + 1):
        moved = sum((shells[-1][at ^ (1 << b)] for b in range(bits)), np.zeros(len(counts)))
        # Of the ways to flip a bit of the last shell, some lead back into the one before it.
        back = (bits - t + 2) * shells[-2] if t > 1 else 0
        shells.append((moved - back) / t)
    rest = width - bits
    even = [ball(rest, min(t, rest)) / 2**rest for t in range(distance + 1)]
    return np.array([sum(shells[s] * even[t - s] for s in range(t + 1)) for t in range(distance + 1)])


def allocate(costs: np.ndarray, budget: int) -> np.ndarray:
    """[row, part]: thresholds with the least cost whose t + 1 add up to ``budget``.

    ``costs[row, part, t]`` is for thresholds t from 0; -1 costs nothing.
    """
    rows, parts, most = costs.shape
    best = np.full((rows, budget + 1), np.inf)
    best[:, 0] = 0
    choice = np.zeros((parts, rows, budget + 1), np.int64)
    for part in range(parts):
        options = np.full((most + 1, rows, budget + 1), np.inf)
        options[0] = best
        for spent in range(1, min(most, budget) + 1):
            options[spent, :, spent:] = best[:, : budget + 1 - spent] + costs[:, part, spent - 1, None]
        choice[part] = options.argmin(axis=0)
        best = options.min(axis=0)
    out, left, row = np.zeros((rows, parts), np.int64), np.full(rows, budget), np.arange(rows)
    for part in reversed(range(parts)):
        spent = choice[part, row, left]
        out[:, part] = spent - 1
        left = left - spent
    return out


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy().view(np.uint64)


def _together(prints: DataFrame) -> np.ndarray:
    """In how many fingerprints each two bits stand; 4,096 numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(_longs(batch, "fp").copy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.astype(np.float32).T @ bits.astype(np.float32)
        arrays = [pa.array(np.arange(BITS * BITS), pa.int32()), pa.array(total.ravel().astype(np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, ["cell", "n"])

    found = prints.select("fp").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BITS * BITS)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(BITS, BITS)


def _counts(prints: DataFrame, parts: list[list[int]]) -> np.ndarray:
    """[part, value]: fingerprints by the lowest bits of each part's value."""
    bits = [min(COUNTED_BITS, len(part)) for part in parts]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(parts), 1 << COUNTED_BITS), np.int64)
        for batch in batches:
            for k, part in enumerate(parts):
                found = values_of(_longs(batch, "fp"), part[: bits[k]]).astype(np.int64)
                total[k] += np.bincount(found, minlength=1 << COUNTED_BITS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total.ravel()[cells])], ["cell", "n"])

    found = prints.select("fp").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(parts) << COUNTED_BITS, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(len(parts), -1)


def _entries(prints: DataFrame, parts: list[list[int]], counts: np.ndarray, distance: int) -> DataFrame:
    """(code, probe, fp): each fingerprint under its own value of each part (0) and under those that it probes (1)."""
    table = prints.sparkSession.sparkContext.broadcast(counts)
    widths = [len(part) for part in parts]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected = [within(table.value[k], w, distance) for k, w in enumerate(widths)]
        rows_of = np.array([[ball(w, t) for t in range(distance + 1)] for w in widths])
        flips = [[masks(list(range(w)), t) for t in range(distance + 1)] for w in widths]
        low = np.uint64((1 << COUNTED_BITS) - 1)
        for batch in batches:
            every = _longs(batch, "fp")
            for start in range(0, len(every), 4096):
                found = every[start : start + 4096]
                values = [values_of(found, part) for part in parts]
                costs = np.stack([expected[k][:, (values[k] & low).astype(np.int64)].T for k in range(len(parts))], axis=1)
                thresholds = allocate(costs + ROW_COST * rows_of, distance + 1)
                codes, probes, owners = [], [], []
                for k, value in enumerate(values):
                    of_part = np.uint64(k << 32)
                    codes.append(value | of_part)
                    probes.append(np.zeros(len(found), np.int32))
                    owners.append(found)
                    for t in range(distance + 1):
                        mine = thresholds[:, k] == t
                        if mine.any():
                            near = (value[mine][:, None] ^ flips[k][t]) | of_part
                            codes.append(near.ravel())
                            probes.append(np.ones(near.size, np.int32))
                            owners.append(np.repeat(found[mine], near.shape[1]))
                arrays = [np.concatenate(codes).view(np.int64), np.concatenate(probes), np.concatenate(owners).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["code", "probe", "fp"])

    return prints.select("fp").mapInArrow(spread, "code long, probe int, fp long")


def around(prints: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``distance``, without pairing any.

    With distance 2r, those within r of a common point; with 2r + 1 the same for each bit left out in turn. All
    fingerprints that meet are within the distance of each other, so each is linked to the smallest of them.
    """
    radius, odd = distance // 2, distance % 2
    skipped = list(range(BITS)) if odd else [-1]
    flips = [masks([b for b in range(BITS) if b != skip], radius) for skip in skipped]
    stays = [np.uint64(2**BITS - 1 - (1 << skip if skip >= 0 else 0)) for skip in skipped]

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = _longs(batch, "fp")
            for start in range(0, len(every), 1024):
                found = every[start : start + 1024]
                for skip, flip, stay in zip(skipped, flips, stays, strict=True):
                    near = (found[:, None] & stay) ^ flip
                    arrays = [pa.array(np.full(near.size, skip, np.int8)), pa.array(near.ravel().view(np.int64))]
                    arrays.append(pa.array(np.repeat(found, near.shape[1]).view(np.int64)))
                    yield pa.RecordBatch.from_arrays(arrays, ["skip", "point", "fp"])

    met = prints.select("fp").mapInArrow(points, "skip tinyint, point long, fp long")
    least = met.groupBy("skip", "point").agg(F.min("fp").alias("b"), F.max("fp").alias("_most")).where("b != _most")
    return met.join(least, ["skip", "point"]).where("fp != b").select(F.col("fp").alias("a"), "b").distinct()


def _between(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries of crowded codes that still hold several components, with their components and how many they are."""
    marked = entries.join(labels, F.col("fp") == F.col("node"), "left").select(
        "code", "probe", "fp", F.coalesce("component", "fp").alias("component")
    )
    marked = written(marked, "marked")
    open_codes = marked.groupBy("code").agg(
        F.sum("probe").alias("probes"), F.sum(1 - F.col("probe")).alias("own"),
        F.min("component").alias("_low"), F.max("component").alias("_high"),
    )
    open_codes = open_codes.where("_low != _high").select("code", "probes", "own")
    return written(marked.join(open_codes, "code"), "open")


def links(prints: DataFrame, distance: int = DISTANCE, crowded: int = CROWDED, most: int | None = None) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp``: their components are those of all pairs within ``distance``.

    Values with more than ``crowded`` comparisons for each of their rows are linked around points first; values with more
    than ``most`` (by default as many as the rows that stand for a fingerprint then) are not paired.
    """
    n = prints.count()
    parts = grouped_bits(_together(prints), n, part_count(n, distance))
    entries = written(_entries(prints, parts, _counts(prints, parts), distance), "probes")
    met = entries.groupBy("code").agg(
        F.sum("probe").alias("probes"), F.sum(1 - F.col("probe")).alias("own"),
        F.min("fp").alias("_low"), F.max("fp").alias("_high"),
    )
    met = met.where("_low != _high AND probes > 0 AND own > 0").select("code", "probes", "own")
    entries = written(entries.join(met, "code"), "met")
    is_crowded = F.col("probes") * F.col("own") > crowded * (F.col("probes") + F.col("own"))
    dense = written(entries.where(is_crowded).select("fp").distinct(), "dense")
    near = written(around(dense, distance - distance % 2), "near")
    labels = components(near)
    # Only crowded values need components, and only their entries are joined to them, however many others there are;
    # under any other value a fingerprint stands for itself, and few are compared.
    if labels.isEmpty():
        entries = entries.withColumn("component", F.col("fp"))
    else:
        marked = _between(entries.where(is_crowded).drop("probes", "own"), labels)
        entries = entries.where(~is_crowded).withColumn("component", F.col("fp")).unionByName(marked)
    most = len(masks(list(range(BITS - 1)), distance // 2)) * BITS if most is None else most
    much = F.col("probes") * F.col("own") > most * (F.col("probes") + F.col("own"))
    salts = F.ceil(F.col("probes") / SALT_ROWS).cast("long")
    paired = entries.where(~much)
    one = paired.where("probe = 1").select(
        "code", F.pmod(F.xxhash64("fp"), salts).alias("_salt"), F.col("fp").alias("a"), F.col("component").alias("_of_a")
    )
    two = paired.where("probe = 0").select(
        "code", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("_salt"), F.col("fp").alias("b"),
        F.col("component").alias("_of_b"),
    )
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = one.join(two, ["code", "_salt"]).where((F.col("a") < F.col("b")) & (F.col("_of_a") != F.col("_of_b")) & close)
    odd = around(written(entries.where(much).select("fp").distinct(), "crowded"), distance)
    return near.unionAll(pairs.select("a", "b").distinct()).unionAll(odd)


def fingerprint_classes(docs: DataFrame, distance: int = DISTANCE, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 lowercase hex digits), component_id.

    ``component_id`` is the smallest ``doc_id`` that links of at most ``distance`` bits lead to; NULL ids count for nothing,
    and where there is no other it is NULL. NULL and empty texts and those without words have fingerprint zero, which is
    linked like any other. Rows that repeat an id are linked by their own texts. Other columns are not read.
    """
    rows = written(fingerprints(docs, words), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("rows"))
    prints = written(prints, "prints")
    labels = components(written(links(prints, distance), "links"))
    named = prints.join(labels, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_doc", "rows", F.coalesce("component", "fp").alias("component")
    )
    first = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = written(named.join(first, "component").select("fp", "rows", "component_id"), "named")
    # At most 10,000 fingerprints are heavy, so they can be broadcast; no other one fills a task.
    heavy = F.col("rows") > max(HEAVY_ROWS, rows.count() // 10_000)
    broad = F.broadcast(named.where(heavy).select("fp", "component_id", F.lit(True).alias("_heavy")))
    split = rows.join(broad, "fp", "left")
    light = split.where("_heavy IS NULL").select("doc_id", "fp").join(named.where(~heavy), "fp")
    every = split.where("_heavy").select("doc_id", "fp", "component_id").unionAll(light.select("doc_id", "fp", "component_id"))
    return every.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
