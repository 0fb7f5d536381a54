"""Similarity self-join of documents on word shingles, by grouped prefixes.

Shingles are ordered from rare to frequent. Two sets of Jaccard similarity t or more share a shingle among the first
``n - ceil(t n) + 1`` of each, so only those prefixes are indexed. Documents with the same set form a class, and
classes with the same size and the same prefix form a group that enters the index once. Groups that share a prefix
shingle are filtered by their sizes and by the positions of the shingle, expanded to their classes, and verified on
the whole sets.

A shingle that many similar documents share would pair all of them. Only connectivity is asked for, so a longer list is
first paired sparsely: each entry with its neighbour and with the first two, in the order of how many rare shingles an
entry has, so that the first ones are nearest to all and the same in most lists. After these links are verified
and their components known, pairs within a component are left out and all others of the list go on. No pair of
different components that could be linked is skipped.

Before texts are moved, pairs must pass a bitmap of each set: 512 bits, each the parity of the shingles that hash to
it. Two sets differ in at least as many shingles as their bitmaps differ in bits, so a pair whose bitmaps differ in more
than the threshold allows is never linked.

Frequencies only order the shingles, and any order gives the same links; they are counted over all documents in a
table of fixed size, which is all that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siren.llm.arrays import Texts, Words, mix, windows
from siren.llm.components import components
from siren.llm.rows import id_and_text, release, slices, written

SHINGLE_WORDS, PERCENT = 5, 75
#: Cells of the table of frequencies (2 MB).
FREQUENCY_BITS = 19
LOT = 2_000_000
#: Indexed shingles of one task, and how many a task collects before it hands them on.
SHARD_ENTRIES, HELD_ENTRIES = 1_000_000, 500_000
#: Lists up to this long are paired in full at once.
SHORT_LIST = 2
#: Cells of the table of frequencies that travel together.
CHUNK = 4096
#: Classes of more documents than this, or 1/10,000 of all, are dealt over so many tasks.
MANY_COPIES, SALTS = 1_000, 32
#: Words of 64 bits of a set's bitmap, and cells of the table of wanted texts (8 MB as bits) and of its parts.
BITMAP = [f"bits_{k}" for k in range(8)]
WANTED_BITS, WANTED_PART_BITS = 26, 16
#: Entries of one list and size band in one task.
DEALT_ENTRIES = 4096

PROFILE = "uid long, doc_id long, text_hash long, n long, gid long, set_hash long, " + ", ".join(f"{b} long" for b in BITMAP)
CANDIDATES = "kind int, list long, a long, b long, position long"


def shingles(texts: pa.Array | list[str | None], words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, one text after the other; and how many each text has.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    found = Words.of(Texts.of(column, lower=True))
    hashes, first = windows(found.hashes, found.counts, words)
    owner = found.text_of()[first]
    short = np.flatnonzero((found.counts > 0) & (found.counts < words))
    begins = np.concatenate([[0], np.cumsum(found.counts)])[short]
    whole = found.counts[short].astype(np.uint64)
    for k in range(words - 1):
        has = found.counts[short] > k
        whole[has] = mix(whole[has] * np.uint64(0x9E3779B97F4A7C15) + found.hashes[begins[has] + k])
    hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(found.counts))


def needed_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """What a set of n must share with any set it is linked with."""
    return -(-n * percent // 100)


def linked(common: int, n: int, m: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


def _frequencies(rows: DataFrame, words: int) -> np.ndarray:
    """In how many documents the shingles of each cell occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        cells = np.zeros(1 << FREQUENCY_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, "text", LOT):
                hashes, _ = shingles(part.column("text"), words)
                cells += np.bincount((hashes >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64), minlength=len(cells))
        yield packed({k: cells[k * CHUNK : (k + 1) * CHUNK] for k in range(len(cells) // CHUNK)})

    def packed(chunks: dict[int, np.ndarray]) -> pa.RecordBatch:
        blobs = [zstandard.compress(chunk.astype("<i8").tobytes(), 1) for chunk in chunks.values()]
        arrays = [pa.array(list(chunks), pa.int32()), pa.array(blobs, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["chunk", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, cells in zip(batch.column("chunk").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                found = np.frombuffer(zstandard.decompress(cells), "<i8")
                sums[chunk] = sums[chunk] + found if chunk in sums else found
        yield packed(sums)

    chunks = rows.select("text").mapInArrow(count, "chunk int, cells binary").repartition("chunk")
    found = chunks.mapInArrow(add, "chunk int, cells binary").collect()  # the whole table once
    cells = np.zeros(1 << FREQUENCY_BITS, np.int64)
    for row in found:
        cells[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(zstandard.decompress(bytes(row.cells)), "<i8")
    return cells


class Profiles:
    """Prefixes of texts: shingles from rare to frequent, positions, and each text's size and hashes."""

    def __init__(self, column: pa.Array, frequencies: np.ndarray, words: int, percent: int):
        hashes, self.n = shingles(column, words)
        owner = np.repeat(np.arange(len(self.n)), self.n)
        self.bitmap = _bitmaps(mix(hashes ^ np.uint64(0xA0761D6478BD642F)), self.n)
        self.set_hash = _sums(mix(hashes ^ np.uint64(0xD6E8FEB86659FD93)), self.n)
        cell = frequencies[(hashes >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)]
        # Rare: no more frequent than shingles that share a cell by chance.
        chance = frequencies.mean()
        rare = np.concatenate([[0], np.cumsum(cell <= chance + 6 * np.sqrt(chance) + 1)])
        ends = np.cumsum(self.n)
        self.rare = rare[ends] - rare[ends - self.n]
        order = np.lexsort((hashes, cell, owner))
        hashes = hashes[order]
        begins = np.concatenate([[0], np.cumsum(self.n)])[:-1]
        position = np.arange(len(hashes)) - np.repeat(begins, self.n)
        length = np.where(self.n > 0, self.n - needed_overlap(self.n, percent) + 1, 0)
        inside = position < np.repeat(length, self.n)
        self.shingles, self.positions, self.owner, self.lengths = hashes[inside], position[inside], owner[inside], length
        at = self.positions.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.gid = mix(_sums(mix(self.shingles ^ at), length) + self.n.astype(np.uint64))


def _bitmaps(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """For each text, the parities of its values in 512 cells, as 64-bit words."""
    bit = np.uint64(1) << (values & np.uint64(63))
    word = (values >> np.uint64(6)) % np.uint64(len(BITMAP))
    ends = np.cumsum(counts)
    out = []
    for k in range(len(BITMAP)):
        parity = np.bitwise_xor.accumulate(np.concatenate([np.zeros(1, np.uint64), np.where(word == np.uint64(k), bit, np.uint64(0))]))
        out.append(parity[ends] ^ parity[ends - counts])
    return out


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _profiles(rows: DataFrame, frequencies, words: int, percent: int) -> DataFrame:
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", LOT):
                found = Profiles(part.column("text"), frequencies.value, words, percent)
                arrays = [part.column(c) for c in ("uid", "doc_id", "text_hash")]
                arrays.append(pa.array(found.n))
                arrays += [pa.array(x.view(np.int64)) for x in (found.gid, found.set_hash, *found.bitmap)]
                yield pa.RecordBatch.from_arrays(arrays, ["uid", "doc_id", "text_hash", "n", "gid", "set_hash", *BITMAP])

    return rows.mapInArrow(profile, PROFILE)


def _index(rows: DataFrame, frequencies, words: int, percent: int, shards: int, shard_entries: int) -> DataFrame:
    """Packed entries of the index: each group once per task, its prefix dealt over the shards."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def packed() -> pa.RecordBatch:
            every = np.concatenate(held, axis=1)
            shard = (every[0] % np.uint64(shards)).astype(np.int64)
            parts = _parts(frequencies.value, every[0] >> np.uint64(32), shard_entries)
            shard += shards * (mix(every[1] ^ np.uint64(0x2545F4914F6CDD1D)) % parts.astype(np.uint64)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            every, shard = every[:, order], shard[order]
            heads = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
            out = [(int(shard[a]), a, b) for a, b in zip(heads, [*heads[1:], len(shard)], strict=True)]
            payloads = [pack(every[:, a:b]) for _, a, b in out]
            arrays = [pa.array([k for k, _, _ in out], pa.int64()), pa.array(payloads, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["shard", "payload"])

        for batch in batches:
            for part in slices(batch, "text", LOT):
                found = Profiles(part.column("text"), frequencies.value, words, percent)
                new = np.zeros(len(found.n), bool)
                for k, gid in enumerate(found.gid.tolist()):
                    if found.n[k] and gid not in seen:
                        seen.add(gid)
                        new[k] = True
                use = new[found.owner]
                owner = found.owner[use]
                held.append(
                    np.stack([found.shingles[use], found.gid[owner], found.n[owner].astype(np.uint64),
                              found.rare[owner].astype(np.uint64), found.positions[use].astype(np.uint64)])
                )
                size += held[-1].shape[1]
                if size >= HELD_ENTRIES:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    return rows.select("text").mapInArrow(entries, "shard long, payload binary")


def _parts(frequencies: np.ndarray, shingle: np.ndarray, shard_entries: int) -> np.ndarray:
    """Over how many shards a shingle's list is dealt, by how long it can be; shingles are the upper 32 bits."""
    return frequencies[(shingle >> np.uint64(32 - FREQUENCY_BITS)).astype(np.int64)] // shard_entries + 1


def pack(entries: np.ndarray) -> bytes:
    """Rows shingle, gid, n, rare, position; consecutive entries of a group name it once. Of shingles 32 bits stay, which
    can only add candidates."""
    shingle, gid, n, rare, position = entries
    first = np.ones(len(gid), bool)
    first[1:] = (gid[1:] != gid[:-1]) | (n[1:] != n[:-1])
    heads = np.flatnonzero(first)
    counts = np.diff(np.append(heads, len(gid)))
    wide = int(position.max(initial=0)) >> 16 > 0
    sizes = np.array([len(gid), len(heads), wide], "<u8")
    arrays = [sizes, gid[heads].astype("<u8"), *(x.astype("<u4") for x in (n[heads], rare[heads], counts))]
    arrays += [(shingle >> np.uint64(32)).astype("<u4"), position.astype("<u4" if wide else "<u2")]
    return b"".join(a.tobytes() for a in arrays)


def unpack(payload: bytes) -> np.ndarray:
    size, heads, wide = np.frombuffer(payload, "<u8", 3).tolist()
    at = 24
    out = []
    per_head = [("<u8", heads), ("<u4", heads), ("<u4", heads), ("<u4", heads)]
    for kind, count in [*per_head, ("<u4", size), ("<u4" if wide else "<u2", size)]:
        out.append(np.frombuffer(payload, kind, count, at).astype(np.uint64))
        at += out[-1].size * int(kind[2])
    gid, n, rare, counts, shingle, position = out
    counts = counts.astype(np.int64)
    return np.stack([shingle, *(np.repeat(x, counts) for x in (gid, n, rare)), position])


def possible(n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m can be linked if their first common shingle stands at positions i and j."""
    common = np.minimum(n - i, m - j)
    return (100 + percent) * common >= percent * (n + m)


def candidates(entries: np.ndarray, percent: int, shard: int, dealt: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Pairs of groups (kind 0) from the lists of a shard, and the entries of its long lists (kind 1).

    ``dealt`` marks the entries of lists that have parts in other shards; those are long, whatever stands here.
    """
    # Shingles of one group only, which most are, have no list.
    dealt = np.zeros(entries.shape[1], bool) if dealt is None else dealt
    met = np.sort(entries[0])
    met = met[np.flatnonzero(met[1:] == met[:-1])] if len(met) > 1 else met[:0]
    met = np.unique(np.concatenate([met, entries[0][dealt]]))
    near = np.searchsorted(met, entries[0])
    shared = np.flatnonzero(met[np.minimum(near, len(met) - 1)] == entries[0]) if len(met) else np.zeros(0, np.int64)
    parted = np.unique(entries[0][dealt])
    shingle, gid, n, rare, position = entries[:, shared]
    order = np.lexsort((position, gid, n, shingle))
    shingle, gid, rare = shingle[order], gid[order], rare[order]
    n, position = n[order].astype(np.int64), position[order].astype(np.int64)
    new = np.ones(len(gid), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (gid[1:] != gid[:-1]) | (n[1:] != n[:-1])
    order = np.lexsort((gid[new], rare[new], shingle[new]))
    shingle, gid, n, position = (x[new][order] for x in (shingle, gid, n, position))
    heads = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]])) if len(shingle) else np.zeros(0, int)
    sizes = np.diff(np.append(heads, len(shingle)))
    left, right = [], []
    long = (sizes > SHORT_LIST) | np.isin(shingle[heads], parted)
    for size in range(2, SHORT_LIST + 1):
        of_size = heads[(sizes == size) & ~long]
        for a in range(size):
            for b in range(a + 1, size):
                left.append(of_size + a)
                right.append(of_size + b)
    long_heads, long_sizes = heads[long], sizes[long]
    row = np.repeat(long_heads - np.concatenate([[0], np.cumsum(long_sizes)[:-1]]), long_sizes) if len(long_heads) else 0
    entry = (np.arange(long_sizes.sum()) + row).astype(np.int64)
    if len(entry):
        left += [entry[:-1], entry, entry]
        right.append(np.where(shingle[entry[:-1]] == shingle[entry[1:]], entry[1:], entry[:-1]))
        right += [np.repeat(long_heads, long_sizes), np.repeat(long_heads + (long_sizes > 1), long_sizes)]
    left, right = np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])
    use = (gid[left] != gid[right]) & possible(n[left], n[right], position[left], position[right], percent)
    pairs = np.stack([gid[left[use]], gid[right[use]]])
    pairs = np.unique(np.sort(pairs, axis=0), axis=1).view(np.int64)
    code = (np.int64(shard) << np.int64(32)) | shingle[entry].astype(np.int64)
    zero, none = np.zeros(pairs.shape[1], np.int64), np.zeros(len(entry), np.int64)
    return {
        "kind": np.concatenate([zero, none + 1]).astype(np.int32),
        "list": np.concatenate([zero, code]),
        "a": np.concatenate([pairs[0], gid[entry].view(np.int64)]),
        "b": np.concatenate([pairs[1], none]),
        "position": np.concatenate([zero, position[entry]]),
    }


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of class ids whose whole sets are similar enough; texts are never broadcast."""

    def sets_of(texts: dict[int, bytes]) -> dict[int, np.ndarray]:
        hashes, counts = shingles(pa.array(list(texts.values()), pa.binary()).cast(pa.string()), words)
        return dict(zip(texts, np.split(hashes, np.cumsum(counts)[:-1]), strict=True)) if texts else {}

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        unpacked = zstandard.ZstdDecompressor()
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            blobs = dict(zip(a, batch.column("blob_a"), strict=True)) | dict(zip(b, batch.column("blob_b"), strict=True))
            sets: dict[int, np.ndarray] = {}
            some: dict[int, bytes] = {}
            size = 0
            for i, blob in blobs.items():
                text = unpacked.decompress(blob.as_py())
                if some and size + len(text) > LOT:
                    sets.update(sets_of(some))
                    some, size = {}, 0
                some[i] = text
                size += len(text)
            sets.update(sets_of(some))
            keep = []
            for x, y in zip(a, b, strict=True):
                one, other = sets[x], sets[y]
                common = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(linked(common, len(one), len(other), percent))
            arrays = [batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b"])

    left = texts.select(F.col("uid").alias("a"), F.col("blob").alias("blob_a"))
    right = texts.select(F.col("uid").alias("b"), F.col("blob").alias("blob_b"))
    both = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return both.select("a", "b", "blob_a", "blob_b").mapInArrow(verify, "a long, b long")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _near(percent: int) -> Column:
    """Whether sets ``_1`` and ``_2`` could be linked by their sizes and bitmaps; a linked pair always could."""
    n, m = F.col("n_1"), F.col("n_2")
    differ = sum((F.bit_count(F.col(f"{b}_1").bitwiseXOR(F.col(f"{b}_2"))) for b in BITMAP), F.lit(0))
    # common >= percent (n + m) / (100 + percent), and n + m - 2 common shingles differ.
    near = (100 + percent) * (n + m - differ) >= 2 * percent * (n + m)
    return near & (100 * n >= percent * m) & (100 * m >= percent * n)


def _side(rows: DataFrame, number: int, *plain: str) -> DataFrame:
    return rows.select([F.col(c) if c in plain else F.col(c).alias(f"{c}_{number}") for c in rows.columns])


def _wanted(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """Rows that may be among the needed ones, by a table of bits of fixed size; joins leave out those that are not."""
    size, part = 1 << WANTED_BITS, 1 << WANTED_PART_BITS
    cell = F.pmod(F.xxhash64("uid"), F.lit(size)).cast("int").alias("cell")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bits of the parts that have any, a part at a time; cells come in order."""
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for k in np.unique(cells // part).tolist():
                bits = held.setdefault(k, np.zeros(part, bool))
                bits[cells[cells // part == k] % part] = True
        parts = [pa.array(list(held), pa.int32()), pa.array([np.packbits(b).tobytes() for b in held.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(parts, ["part", "bits"])

    dealt = needed.select(cell).repartition(F.floor(F.col("cell") / part))
    table = np.zeros(size // 8, np.uint8)
    for row in dealt.mapInArrow(mark, "part int, bits binary").toLocalIterator():  # the whole table once
        table[row.part * part // 8 : (row.part + 1) * part // 8] = np.frombuffer(bytes(row.bits), np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(zstandard.compress(table.tobytes(), 1))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        wanted = np.frombuffer(zstandard.decompress(sent.value), np.uint8)
        compressor = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            found = batch.filter(pa.array((wanted[cells >> 3] >> (7 - (cells & 7)) & 1).astype(bool)))
            blobs = [compressor.compress(t or b"") for t in found.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([found.column("uid"), pa.array(blobs, pa.binary())], ["uid", "blob"])

    return rows.select("uid", "text", cell).mapInArrow(keep, "uid long, blob binary")


def _links(rows: DataFrame, pairs: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """The pairs that are linked; of the texts, only theirs are read again and moved."""
    needed = pairs.select(F.col("a").alias("uid")).unionAll(pairs.select(F.col("b").alias("uid"))).distinct()
    texts = written(_wanted(rows, needed), f"texts-{name}")
    return written(_verified(pairs, texts, words, percent), f"links-{name}")


def _could(percent: int) -> Column:
    """Whether sets of ``n_1`` and ``n_2`` can be linked if their first common shingle is at these positions or later."""
    common = F.least(F.col("n_1") - F.col("position_1"), F.col("n_2") - F.col("position_2"))
    return (100 + percent) * common >= percent * (F.col("n_1") + F.col("n_2"))


def _band(percent: int) -> Column:
    """Sizes that can be linked are in one band or in bands next to each other."""
    return F.floor(F.log(F.col("n")) / F.log(F.lit(100.1 / percent))).cast("long")


def live_entries(lists: DataFrame, labels: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(list, uid, n, position, component) of the entries of cells that may hold a link between components."""
    marked = lists.join(labels, F.col("uid") == F.col("node"), "left").select(
        "list", "uid", "n", "position", F.coalesce("component", "uid").alias("component")
    )
    marked = written(marked, "marked-lists")
    ends = [F.min("component").alias("low"), F.max("component").alias("high")]
    cells = marked.groupBy("list", "n", "position").agg(*ends)
    open_lists = marked.groupBy("list").agg(*ends).where("low < high").select("list")
    cells = cells.join(open_lists, "list", "left_semi").withColumn("band", _band(percent))
    # Of one size, what stands first can be linked with most.
    sizes = cells.groupBy("list", "n", "band").agg(
        F.min("position").alias("position_2"), F.min("low").alias("low_2"), F.max("high").alias("high_2")
    )
    sizes = sizes.select("list", F.explode(F.expr("sequence(band - 1, band + 1)")).alias("band"),
                         F.col("n").alias("n_2"), "position_2", "low_2", "high_2")
    one = cells.withColumns({"n_1": F.col("n"), "position_1": F.col("position")})
    apart = F.least("low", "low_2") != F.greatest("high", "high_2")
    on = (one["list"] == sizes["list"]) & (one["band"] == sizes["band"]) & _could(percent) & apart
    live = one.join(sizes, on, "left_semi").select("list", "n", "position")
    return written(marked.join(live, ["list", "n", "position"], "left_semi"), "live-entries")


def _cross_pairs(lists: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list that are not in one component yet and could be linked."""
    entries = live_entries(lists, labels, percent).withColumn("band", _band(percent))
    salts = entries.groupBy("list", "band").agg(F.ceil(F.count(F.lit(1)) / DEALT_ENTRIES).alias("salts"))
    entries = entries.join(salts, ["list", "band"]).join(classes.select("uid", *BITMAP), "uid")
    entries = written(entries, "open-entries")
    kept = ["list", "uid", "n", "position", "component", *BITMAP]
    one = _side(entries.select(*kept, "band", F.pmod(F.xxhash64("uid"), "salts").alias("salt")), 1, "list", "band", "salt")
    # Entries of the band above meet those of this band, where salts are dealt by this band's size.
    above = entries.withColumn("band", F.col("band") - 1).drop("salts").join(salts, ["list", "band"])
    other = entries.withColumn("_above", F.lit(False)).unionByName(above.withColumn("_above", F.lit(True)))
    two = other.select(*kept, "band", "_above", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    two = _side(two, 2, "list", "band", "salt", "_above")
    order = F.col("_above") | (F.col("uid_1") < F.col("uid_2"))
    pairs = one.join(two, ["list", "band", "salt"]).where(
        order & (F.col("component_1") != F.col("component_2")) & _could(percent) & _near(percent)
    )
    return pairs.select(*_ordered(F.col("uid_1"), F.col("uid_2"))).distinct()


def similarity_classes(
    docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, shard_entries: int = SHARD_ENTRIES
) -> DataFrame:
    """One row per row of ``docs``: uid, doc_id, text_hash (xxhash64 of the text), n_shingles, component_id, component.

    ``component_id`` is the smallest ``doc_id`` that links lead to (NULL ids count for nothing), ``component`` the uid
    of a row that stands for the component. NULL and empty texts, and texts without words, are linked with nothing.
    ``docs`` must read the same rows in the same order again, as a table does: rows are numbered in two passes.
    """
    spark: SparkSession = docs.sparkSession
    rows = id_and_text(docs).withColumns({"uid": F.monotonically_increasing_id(), "text_hash": F.xxhash64("text")})
    cells = _frequencies(rows, words)
    shards = int(cells.sum()) * (100 - percent) // 100 // shard_entries + 1
    frequencies = spark.sparkContext.broadcast(cells)
    profiles = written(_profiles(rows, frequencies, words, percent), "profiles")
    classes = profiles.where("n > 0").groupBy("gid", "set_hash", "n").agg(
        F.min("uid").alias("uid"), F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("rows"),
        *[F.min(b).alias(b) for b in BITMAP],  # the same in all rows of a class
    )
    classes = written(classes, "classes")

    def of_shard(key: tuple, table: pa.Table) -> pa.Table:
        every = [unpack(payload.as_py()) for payload in table.column("payload")]
        entries = np.concatenate(every, axis=1)
        del every
        shard = key[0].as_py() % shards
        return pa.table(candidates(entries, percent, shard, _parts(frequencies.value, entries[0], shard_entries) > 1))

    index = _index(rows, frequencies, words, percent, shards, shard_entries)
    found = written(index.groupBy("shard").applyInArrow(of_shard, CANDIDATES), "candidates")
    member = classes.select("gid", "uid", "n", *BITMAP)
    group_pairs = found.where("kind = 0").select(F.col("a").alias("gid_1"), F.col("b").alias("gid_2")).distinct()
    pairs = group_pairs.join(_side(member, 1), "gid_1").join(_side(member, 2), "gid_2").where(_near(percent))
    pairs = pairs.select(*_ordered(F.col("uid_1"), F.col("uid_2")))
    # Classes of one group: a list of their own, paired with their neighbour and with the first.
    same = Window.partitionBy("gid").orderBy("uid")
    ranked = classes.select("gid", "uid", "n", F.lag("uid").over(same).alias("_before")).withColumn(
        "_first", F.min("uid").over(Window.partitionBy("gid"))
    )
    crowded = ranked.where("_before IS NOT NULL OR uid != _first")
    pairs = pairs.unionAll(crowded.select(*_ordered(F.col("uid"), F.col("_before"))))
    pairs = pairs.unionAll(crowded.select(*_ordered(F.col("uid"), F.col("_first"))))
    pairs = written(pairs.distinct(), "pairs")
    member = member.select("gid", "uid", "n")
    lists = found.where("kind = 1").select("list", F.col("a").alias("gid"), "position").join(member, "gid")
    inner = member.join(crowded.select("gid").distinct(), "gid", "left_semi")
    inner = inner.withColumns({"list": F.col("gid"), "position": F.lit(0).cast("long")})
    entry = ["list", "uid", "n", "position"]
    lists = lists.select(*entry).unionAll(inner.select(*entry))

    labels = components(_links(rows, pairs, words, percent, "sparse"))
    more = written(_cross_pairs(lists, labels, classes, percent), "more-pairs")
    stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    labels = components(stars.unionAll(_links(rows, more, words, percent, "crossed")))

    # Classes of a component, then documents of a class; both may hold a third of all rows. A class that has no copies and
    # no links stands for itself.
    named = classes.join(labels, F.col("uid") == F.col("node"), "left").where("rows > 1 OR component IS NOT NULL")
    named = written(named.select("gid", "set_hash", "n", "rows", "first_doc", "uid", "component"), "named")
    first = named.where("component IS NOT NULL").groupBy("component").agg(F.min("first_doc").alias("component_id"))
    ids = named.join(first, "component", "left").select(
        "gid", "set_hash", "n", "rows", F.coalesce("component", "uid").alias("component"),
        F.when(F.col("component").isNull(), F.col("first_doc")).otherwise(F.col("component_id")).alias("component_id"),
    )
    # Only classes of very many documents are dealt over tasks; repeating every class would make a table that Spark takes
    # for as small as the classes' files, and broadcasts through the driver.
    many = F.col("rows") > max(MANY_COPIES, profiles.count() // 10_000)
    salts = F.when(many, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    ids = ids.withColumn("_salt", F.explode(salts)).drop("rows")
    dealt = classes.where(many).select("gid", "set_hash", "n", F.lit(SALTS).alias("_salts"))  # at most 10,000
    salt = F.pmod(F.xxhash64("uid"), F.coalesce("_salts", F.lit(1))).cast("int")
    salted = profiles.select("uid", "doc_id", "text_hash", "n", "gid", "set_hash")
    salted = salted.join(F.broadcast(dealt), ["gid", "set_hash", "n"], "left").withColumn("_salt", salt)
    return salted.join(ids.hint("merge"), ["gid", "set_hash", "n", "_salt"], "left").select(
        "uid", "doc_id", "text_hash", F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("component", "uid").alias("component"),
    )
