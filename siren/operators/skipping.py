"""Pattern searches that leave files out: an index of the trigrams that each file of a stored table holds.

A file's entry is a table of bits of fixed size, one for each hash of three characters that stand together in a text, folded
as the case-insensitive search folds them. A pattern whose every alternative has three literal characters in a row can only
match in files that have all bits of an alternative. Other patterns, and files that the index does not know, are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siren.operators.search import filter_matches
from siren.sources.versioned import Version, VersionedTable

#: Bits of a file's entry: 32 KB.
INDEX_BITS = 18
_ENTRIES = "file string, modified long, bits binary"
_fold: dict[int, str] = {}


def folded(text: str) -> str:
    """Each character as a case-insensitive search compares it: the lower case of its upper case."""
    if text.isascii():
        return text.lower()
    for char in set(text):
        if ord(char) not in _fold:
            upper = char.upper() if len(char.upper()) == 1 else char
            _fold[ord(char)] = upper.lower() if len(upper.lower()) == 1 else upper.lower()[:1]
    return text.translate(_fold)


def trigram_cells(text: str) -> np.ndarray:
    """The cells of all trigrams of a text."""
    codes = np.frombuffer(folded(text).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:]
    mixed ^= mixed >> np.uint64(29)
    return np.unique((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - INDEX_BITS)).astype(np.int64)


def literal_runs(pattern: str) -> list[list[str]] | None:
    """Of each alternative of a pattern, the runs of three and more characters that every match holds; None if one has none.

    Only plain characters outside of groups and classes count, and not those before ``?``, ``*`` or ``{``.
    """
    out: list[list[str]] = []
    runs, run, depth, at = [], "", 0, 0

    def end() -> None:
        nonlocal run
        if len(run) >= 3:
            runs.append(run)
        run = ""

    while at < len(pattern):
        char = pattern[at]
        if char == "\\":
            escaped = pattern[at + 1 : at + 2]
            if escaped == "" or escaped.isalnum():  # classes, quotes and codes: no literal is read behind \Q
                if escaped in ("Q", "x", "u", "N", "p", "P", "c", "0", "k"):
                    return None
                end()
            elif depth == 0:
                run += escaped
            at += 2
            continue
        if char == "[":
            end()
            close = pattern.find("]", at + 1)
            if close < at + 2 or pattern[at + 1 : close] == "^" or "[" in pattern[at + 1 : close] or "\\" in pattern[at:close]:
                return None
            at = close
        elif char == "(":
            if pattern[at + 1 : at + 2] == "?":
                return None  # flags and look-around
            end()
            depth += 1
        elif char == ")":
            depth -= 1
        elif char in "?*{":
            run = run[:-1]
            end()
            if char == "{":
                at = pattern.find("}", at)
                if at < 0:
                    return None
        elif char == "|" and depth == 0:
            end()
            out.append(runs)
            runs = []
        elif char in "^$.+|":
            end()
        elif depth == 0:
            run += char
        at += 1
    end()
    out.append(runs)
    return out if all(out) else None


class TrigramIndex:
    """The index of one text column of a Parquet table, kept beside it."""

    def __init__(self, spark: SparkSession, table: str, path: str, column: str = "content"):
        self.spark, self.table, self.column = spark, table, column
        self.entries = VersionedTable(spark, path, _ENTRIES)

    def _files(self) -> DataFrame:
        """(file, modified) of the table's files."""
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
            "pathGlobFilter", "*.parquet"
        ).load(self.table).select(F.col("path").alias("file"), F.unix_millis("modificationTime").alias("modified"))

    def refresh(self) -> int:
        """Index the files that are new or changed; how many those were. Only they are read."""
        found = 0

        def change(version: Version) -> tuple[list[str], dict] | None:
            nonlocal found
            known = self.entries.read(version).drop("_at")
            files = self._files()
            missing = files.join(known, ["file", "modified"], "left_anti").collect()  # names of files
            found = len(missing)
            if not missing:
                return None
            rows = self.spark.read.parquet(*[row.file for row in missing]).select(
                F.col("_metadata.file_path").alias("file"), F.unix_millis("_metadata.file_modification_time").alias("modified"),
                F.coalesce(self.column, F.lit("")).alias("text"),
            )
            kept = known.join(files, ["file", "modified"], "left_semi")
            return [self.entries.stage(kept.unionByName(_bits(rows)))], {}

        self.entries.update(change)
        return found

    def files(self, pattern: str) -> list[str] | None:
        """The files that may hold a match; None where the pattern has no literal to look for."""
        runs = literal_runs(pattern)
        if runs is None:
            return None
        wanted = [np.unique(np.concatenate([trigram_cells(run) for run in alternative])) for alternative in runs]

        def may_match(bits: bytes) -> bool:
            table = np.frombuffer(bits, np.uint8)
            return any(bool(((table[cells >> 3] >> (7 - (cells & 7))) & 1).all()) for cells in wanted)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = [bits.as_py() is None or may_match(bits.as_py()) for bits in batch.column("bits")]
                yield batch.select(["file"]).filter(pa.array(hit, pa.bool_()))

        every = self._files().join(self.entries.read().drop("_at"), ["file", "modified"], "left")
        return sorted(row.file for row in every.select("file", "bits").mapInArrow(ask, "file string").collect())

    def search(self, pattern: str) -> DataFrame:
        """The table's rows whose text matches, as ``filter_matches`` finds them; other files are not opened."""
        files = self.files(pattern) if pattern else None
        whole = self.spark.read.parquet(self.table)
        if files is None:
            return filter_matches(whole, self.column, pattern)
        if not files:
            return whole.where(F.lit(False))
        rows = self.spark.read.schema(whole.schema).option("basePath", self.table).parquet(*files)
        return filter_matches(rows, self.column, pattern)


def _bits(rows: DataFrame) -> DataFrame:
    """(file, modified, bits): each task marks what it reads of a file; the tables of a file's parts are joined."""
    size = 1 << INDEX_BITS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bits = None, np.zeros(size, bool)
        for batch in batches:
            for file, modified, text in zip(*[batch.column(c) for c in ("file", "modified", "text")], strict=True):
                here = (file.as_py(), modified.as_py())
                if here != key:
                    if key is not None:
                        yield packed(key, bits)
                    key, bits = here, np.zeros(size, bool)
                bits[trigram_cells(text.as_py())] = True
        if key is not None:
            yield packed(key, bits)

    def packed(key: tuple[str, int], bits: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["file", "modified", "bits"])

    def join(key: tuple, parts: pa.Table) -> pa.Table:
        every = np.bitwise_or.reduce([np.frombuffer(b.as_py(), np.uint8) for b in parts.column("bits")])
        return pa.table({"file": [key[0].as_py()], "modified": pa.array([key[1].as_py()], pa.int64()), "bits": [every.tobytes()]})

    return rows.mapInArrow(mark, _ENTRIES).groupBy("file", "modified").applyInArrow(join, _ENTRIES)
