"""Token ids in files of one wavelet matrix each.

A file holds consecutive documents, in ascending id order, with at most about ``SHARD_TOKENS`` tokens: a header, the
documents' ids and lengths, and one bit plane per bit of the largest token, from the highest. A plane is packed bits
behind a directory of the ones before every 512 bits, compressed by itself. ``WaveletFile`` reads single tokens,
counts a token in a range and finds its k-th occurrence from the planes, without unpacking the sequence.

A file: ``SIRENWM1``, header length (8 bytes, little-endian), header in JSON, then the parts it lists. Bytes behind
the last part are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siren.llm.files import read_binary, write_binary
from siren.llm.rows import id_and_text, slices, written
from siren.llm.word_bpe import chunk_encoder
from siren.session import new_path

MAGIC = b"SIRENWM1"
SHARD_TOKENS = 1_000_000
BLOCK = 512
TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def build(tokens: np.ndarray, doc_ids: list[int | None], lengths: list[int], part: int, start: int) -> bytes:
    """One file's bytes. ``start`` counts the tokens of the same partition before it."""
    width = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
    left = tokens.astype(np.uint16 if width <= 16 else np.uint32)
    packed, zeros = [], []
    for bit in range(width - 1, -1, -1):
        ones = (left & left.dtype.type(1 << bit)) != 0
        bits = np.packbits(ones)
        bits = np.pad(bits, (0, -len(bits) % (BLOCK // 8)))
        directory = np.concatenate([[0], np.cumsum(np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(1))])
        packed.append(directory.astype("<u4").tobytes() + bits.tobytes())
        left = np.concatenate([left.compress(~ones), left.compress(ones)])
        zeros.append(int(len(ones) - ones.sum()))
    known = np.array([i is not None for i in doc_ids], bool)
    ids = np.array([i or 0 for i in doc_ids], "<i8")
    parts = [np.packbits(known).tobytes(), ids.tobytes(), np.array(lengths, "<i8").tobytes(), *packed]
    parts = [zstandard.compress(p, 1) for p in parts]
    header = {"n": len(tokens), "docs": len(doc_ids), "part": part, "start": start, "zeros": zeros}
    head = json.dumps(header | {"sizes": [len(p) for p in parts]}).encode()
    return MAGIC + len(head).to_bytes(8, "little") + head + b"".join(parts)


class WaveletFile:
    """A file's documents and tokens; planes are unpacked when first used."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = int.from_bytes(content[8:16], "little")
        head = json.loads(content[16 : 16 + size])
        ends = np.cumsum([16 + size, *head["sizes"]]).tolist()
        if ends[-1] > len(content):
            raise ValueError("the file is cut off")
        self._parts = [content[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        self._planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.n, self.part, self.start, self._zeros = head["n"], head["part"], head["start"], head["zeros"]
        known = np.unpackbits(np.frombuffer(zstandard.decompress(self._parts[0]), np.uint8), count=head["docs"])
        ids = np.frombuffer(zstandard.decompress(self._parts[1]), "<i8").tolist()
        self.doc_ids = [i if k else None for i, k in zip(ids, known, strict=True)]
        self.lengths = np.frombuffer(zstandard.decompress(self._parts[2]), "<i8")

    def _plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in self._planes:
            raw = zstandard.decompress(self._parts[3 + level])
            blocks = -(-self.n // BLOCK)
            directory = np.frombuffer(raw, "<u4", blocks + 1)
            self._planes[level] = directory, np.frombuffer(raw, np.uint8, offset=4 * (blocks + 1))
        return self._planes[level]

    def _ones(self, level: int, end: int) -> int:
        """Ones among the first ``end`` bits."""
        directory, bits = self._plane(level)
        block = end // BLOCK
        inside = bits[block * BLOCK // 8 : -(-end // 8)]
        count = int(directory[block]) + int(np.bitwise_count(inside).sum())
        return count - int(inside[-1] & ((1 << (8 - end % 8)) - 1)).bit_count() if end % 8 else count

    def _find(self, level: int, bit: int, k: int) -> int:
        """Where the k-th (from 0) bit of that value is."""
        directory, bits = self._plane(level)
        before = directory if bit else np.arange(len(directory)) * BLOCK - directory.astype(np.int64)
        block = int(np.searchsorted(before, k, side="right")) - 1
        inside = np.unpackbits(bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(inside == bit)[k - int(before[block])])

    def access(self, position: int) -> int:
        """The token at a position."""
        if not 0 <= position < self.n:
            raise IndexError(position)
        token = 0
        for level, zeros in enumerate(self._zeros):
            bit = self._ones(level, position + 1) - (ones := self._ones(level, position))
            position = zeros + ones if bit else position - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for level, zeros in enumerate(self._zeros):
            first, last = self._ones(level, start), self._ones(level, end)
            if token >> (len(self._zeros) - 1 - level) & 1:
                start, end = zeros + first, zeros + last
            else:
                start, end = start - first, end - last
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often a token occurs in [start, end)."""
        if token < 0 or token >> len(self._zeros):
            return 0
        end = self.n if end is None else min(end, self.n)
        first, last = self._range(token, min(start, end), end)
        return last - first

    def occurrence(self, token: int, k: int) -> int:
        """The position of a token's k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        position = self._range(token, 0, 0)[0] + k
        for level in range(len(self._zeros) - 1, -1, -1):
            bit = token >> (len(self._zeros) - 1 - level) & 1
            position = self._find(level, bit, position - self._zeros[level] * bit)
        return position

    def tokens(self) -> np.ndarray:
        """The whole sequence, by undoing the planes from the lowest."""
        out = np.zeros(self.n, np.uint16 if len(self._zeros) <= 16 else np.uint32)
        for level in range(len(self._zeros) - 1, -1, -1):
            ones = np.unpackbits(self._plane(level)[1], count=self.n).view(bool)
            before = np.empty_like(out)
            # Places instead of masks: half the time.
            before[np.flatnonzero(~ones)] = out[: self._zeros[level]]
            before[np.flatnonzero(ones)] = out[self._zeros[level] :] | out.dtype.type(1 << (len(self._zeros) - 1 - level))
            out = before
        return out.astype("<u4")


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_tokens: int = SHARD_TOKENS
) -> None:
    """Encode every whole text, append ``end_id`` to each, and write the files in ascending ``doc_id`` order.

    NULL texts count as empty; NULL ids come first; rows of one id are ordered by their texts' hashes, so that a
    repeated id can be split. A document with more tokens than a shard gets a file of its own. No rows, no files.
    """

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        ids, held, size, start = [], [], 0, 0

        def shard() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(held), "<u4")
            content = build(tokens, ids, [len(h) // 4 for h in held], part, start)
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

        for batch in batches:
            for rows in slices(batch, "text", 8_000_000):
                texts = rows.column("text").to_pylist()
                for doc_id, encoded in zip(rows.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                    if held and size + len(encoded) // 4 + 1 > shard_tokens:
                        yield shard()
                        ids, held, size, start = [], [], 0, start + size
                    ids.append(doc_id)
                    held.append(encoded + end)
                    size += len(encoded) // 4 + 1
        if held:
            yield shard()

    key = ["doc_id", "_text_hash"]
    ordered = id_and_text(docs).withColumn("_text_hash", F.xxhash64("text")).repartitionByRange(*key)
    ordered = ordered.sortWithinPartitions(*key).select("doc_id", "text")
    write_binary(ordered.mapInArrow(files, "content binary"), "content", path, rows_per_file=1)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document: its id, the tokens of all documents before it, its own tokens and their crc32."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                file = WaveletFile(content.as_py())
                raw = file.tokens().tobytes()
                ends = np.cumsum(file.lengths)
                starts = ends - file.lengths
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                arrays = [
                    pa.array(np.full(len(ends), file.part)),
                    pa.array(file.doc_ids, pa.int64()),
                    pa.array(starts + file.start),
                    pa.array(file.lengths),
                    pa.array(crcs, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    # Files are opened once; how many tokens each partition wrote follows from its documents.
    read = written(read_binary(spark, path).select("content").mapInArrow(documents, f"part long, {TOKENS}"), "token-rows")
    per_part = read.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("n"))
    before, total = [], 0
    for row in per_part.orderBy("part").collect():  # one row for each partition of the writing job
        before.append((row.part, total))
        total += row.n
    before = spark.createDataFrame(before, "part long, _before long")
    return read.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
