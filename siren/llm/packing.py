"""Packing of token sequences: best fit, longest first, over all pieces of all documents.

Documents are cut into full windows and a rest. Windows with equal room left are interchangeable, so best fit needs
only how many pieces have each length: the plan works on groups of equal windows, found through a segment tree over
the room left, and Spark then gives every piece its place by its rank among the pieces of its length. The plan equals
placing the pieces one by one. A group is used at most 12 times, for the room left more than halves each time, and a
length leaves at most two new groups, so a plan has under 150,000 steps at any size of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siren.llm.rows import id_and_text, slices, written
from siren.llm.word_bpe import chunk_encoder

WINDOW = 4096
SHARDS = 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = f"{PIECES}, sequence_id long, offset long"


class RoomTree:
    """Which amounts of room left (0 to ``size``) some open window has: smallest one of at least a given amount."""

    def __init__(self, size: int):
        self._leaves = 1 << size.bit_length()
        self._any = bytearray(2 * self._leaves)

    def put(self, room: int, present: bool) -> None:
        node = room + self._leaves
        self._any[node] = present
        while node > 1:
            node //= 2
            self._any[node] = self._any[2 * node] | self._any[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        node = least + self._leaves
        while not self._any[node]:
            while node & 1:  # a right child: nothing larger below its parent
                node //= 2
            if node <= 1:
                return None
            node += 1
        while node < self._leaves:
            node = 2 * node if self._any[2 * node] else 2 * node + 1
        return node - self._leaves


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, first rank, first window, offset, pieces in each window), for pieces of each length.

    From ``first rank`` on, pieces of that length go to consecutive windows, so many in each.
    """
    tree, groups, steps, opened = RoomTree(window), {}, [], 0

    def add(room: int, first: int, count: int) -> None:
        if room and count:
            groups.setdefault(room, []).append((first, count))
            tree.put(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, count = window, opened, -(-left // (window // length))
                opened += count
            else:
                first, count = groups[room].pop()
                if not groups[room]:
                    tree.put(room, False)
            each = room // length
            steps.append((length, rank, first, window - room, each))
            full, rest = divmod(min(left, count * each), each)
            add(room - each * length, first, full)
            if rest:
                add(room - rest * length, first + full, 1)
            add(room, first + full + bool(rest), count - full - bool(rest))
            rank += full * each + rest
            left -= full * each + rest
    return steps


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Full windows and the rest of each document's ids; a NULL text counts as empty, which leaves the end id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text", 8_000_000):
                rows: list[tuple] = []
                texts = part.column("text").to_pylist()
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return id_and_text(docs).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, shards: int = SHARDS) -> DataFrame:
    """One row per piece with its sequence and its offset there.

    A length that a third of all pieces share is ranked in ``shards`` parts, each after the pieces before it. Repeated
    rows are pieces of their own; a NULL id stays NULL. An empty table gives no rows.
    """
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    cut = written(pieces(docs, tokenizer, end_id, window), "pieces")
    cut = cut.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)).cast("int"))
    counts = cut.groupBy("length", "_shard").agg(F.count(F.lit(1)).alias("_n"))
    per_length = counts.groupBy("length").agg(F.sum("_n").alias("n"))  # at most ``window`` rows
    steps = np.array(plan({r.length: r.n for r in per_length.collect()}, window), np.int64).reshape(-1, 5)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_shard").orderBy(*[c for c in columns if c != "length"])
    ranked = (
        cut.withColumn("_row", F.row_number().over(within) - 1)
        .join(offsets, ["length", "_shard"])
        .select(*columns, (F.col("_before") + F.col("_row")).alias("_rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, first_ranks, windows, offset, each = steps.T
        key = lengths * (1 << 48) + first_ranks
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            step = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            past = rank - first_ranks[step]
            sequence = windows[step] + past // each[step]
            place = offset[step] + past % each[step] * length
            arrays = [batch.column(c) for c in columns] + [pa.array(sequence), pa.array(place)]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(place, PLACED)
