"""Exact dedup by naming: equal texts, and only they, end with one integer name.

Normalised texts are cut into fixed-size blocks. Sorting all blocks gives equal ones the same integer name; then
adjacent names are paired and the pairs named in the same way, until each text has one name. Nothing rests on a hash
being free of collisions: hashes only spread the rows, values are always compared.

Every sort is one range shuffle over (hash of the value, row, position), so a value that a third of all rows hold is
spread over many tasks. A task names its values by rank, and the values at its two edges, which a neighbour may hold
too, get one name in a second, small step. The sampled keys are integers of fixed size, whatever the blocks are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siren.llm.rows import id_and_text, release, slices, written

BLOCK_BYTES = 4096
#: Names of one task; the task's number stands above them.
NAMES_PER_TASK = 1 << 40
SALTS = 32

_BLOCKS = "_row long, _pos long, _n long, doc_id long, _sha binary, _value binary"


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """The blocks of each row's text, A-Z in lower case. Id and sha256 go with the first block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                out: list[tuple] = []
                texts = part.column("text").cast(pa.binary()).to_pylist()
                ids = part.column("doc_id").to_pylist()
                for row, doc_id, text in zip(part.column("_row").to_pylist(), ids, texts, strict=True):
                    text = (text or b"").lower()  # of bytes: A-Z only
                    n = max(1, -(-len(text) // block_bytes))
                    out.append((row, 0, n, doc_id, hashlib.sha256(text).digest(), text[:block_bytes]))
                    for k in range(1, n):
                        out.append((row, k, n, None, None, text[k * block_bytes : (k + 1) * block_bytes]))
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                types = [pa.int64()] * 4 + [pa.binary()] * 2
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["_row", "_pos", "_n", "doc_id", "_sha", "_value"])

    return id_and_text(docs).withColumn("_row", F.monotonically_increasing_id()).mapInArrow(cut, _BLOCKS)


def _named(rows: DataFrame, carried: list[str], level: str) -> DataFrame:
    """Replace ``_value`` (binary) by ``_name``: equal for equal values, different for different ones.

    ``carried`` are the columns that stay, besides ``_row`` and ``_pos``.
    """
    types = dict(rows.dtypes)
    kept = ["_row", "_pos", *carried]
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", _name long, _edge binary"

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number the sorted values; those with the first or the last hash are given out once, beside their name."""
        name = TaskContext.get().partitionId() * NAMES_PER_TASK
        last, first_hash, held = None, None, None
        for batch in batches:
            hashes = batch.column("_hash").to_pylist()
            names, new = [], []
            for value in batch.column("_value").to_pylist():
                new.append(value if value != last else None)
                if value != last:
                    name += 1
                    last = value
                names.append(name)
            if not names:
                continue
            first_hash = hashes[0] if held is None else first_hash
            if held is not None:
                yield with_edges(*held, {first_hash, hashes[0]})
            held = ([batch.column(c) for c in kept] + [pa.array(names, pa.int64())], hashes, new)
        if held is not None:
            yield with_edges(*held, {first_hash, held[1][-1]})

    def with_edges(columns: list, hashes: list[int], new: list[bytes | None], edges: set[int]) -> pa.RecordBatch:
        edge = [value if hashed in edges else None for hashed, value in zip(hashes, new, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(edge, pa.binary())], [*kept, "_name", "_edge"])

    spread = rows.withColumn("_hash", F.xxhash64("_value")).repartitionByRange("_hash", "_row", "_pos")
    ordered = spread.sortWithinPartitions("_hash", "_value").select(*kept, "_value", "_hash")
    ranked = written(ordered.mapInArrow(rank, schema), f"names-{level}")
    edges = ranked.where("_edge IS NOT NULL").select("_edge", "_name")
    same = edges.withColumn("_as", F.min("_name").over(Window.partitionBy("_edge")))
    moved = same.where("_as != _name").select("_name", "_as")
    return _lookup(ranked.select(*kept, "_name"), moved).select(
        *kept, F.coalesce("_as", "_name").alias("_name")
    )


def _lookup(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Left join on ``_name``, salted: one name may be on a third of all rows."""
    salted = names.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(
        salted, ["_name", "_salt"], "left"
    )


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``_row``, ``doc_id``, ``_sha`` (sha256 of the normalised text), ``_level``, ``_name``.

    Two rows have equal (``_level``, ``_name``) exactly if their texts are equal after lower-casing A-Z.
    """
    named = written(_named(_blocks(docs, block_bytes), ["_n", "doc_id", "_sha"], "0"), "named-0")
    heads = named.where("_pos = 0").select("_row", "doc_id", "_sha")
    finished = [named.where("_n = 1").select("_row", F.lit(0).alias("_level"), "_name")]
    rest, level = named.where("_n > 1").select("_row", "_pos", "_n", "_name"), 0
    while not rest.isEmpty():
        level += 1
        pair = rest.groupBy("_row", F.floor(F.col("_pos") / 2).cast("long").alias("_pos"), "_n").agg(
            F.max(F.when(F.col("_pos") % 2 == 0, F.col("_name"))).alias("_left"),
            F.max(F.when(F.col("_pos") % 2 == 1, F.col("_name"))).alias("_right"),
        )
        value = F.encode(F.concat(F.hex("_left"), F.lit(","), F.coalesce(F.hex("_right"), F.lit(""))), "utf-8")
        paired = pair.withColumn("_value", value).withColumn("_n", F.ceil(F.col("_n") / 2).cast("long"))
        named = written(_named(paired.drop("_left", "_right"), ["_n"], str(level)), f"named-{level}")
        finished.append(named.where("_n = 1").select("_row", F.lit(level).alias("_level"), "_name"))
        rest = named.where("_n > 1")
    names = finished[0]
    for part in finished[1:]:
        names = names.unionAll(part)
    return heads.join(names, "_row")


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document, dropped ones too: which document of its group stays, and how many the group has.

    Of equal texts the row with the largest ``doc_id`` stays (NULL ids are smallest; of rows that repeat an id, the
    first stays). NULL counts as an empty text. Other columns are not read. An empty table gives an empty result.
    """
    rows = written(identities(docs, block_bytes), "identities")
    best = F.max(F.struct("doc_id", (-F.col("_row")).alias("_row"))).alias("_best")
    groups = rows.groupBy("_level", "_name").agg(best, F.count(F.lit(1)).alias("group_size"))
    large = groups.where("group_size > 1").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    joined = salted.join(large, ["_level", "_name", "_salt"], "left")
    stays = F.col("_best").isNull() | (F.col("_row") == -F.col("_best._row"))
    return joined.select(
        "doc_id",
        F.when(F.col("_best").isNull(), F.col("doc_id")).otherwise(F.col("_best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        stays.alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
