"""What the operators share about rows: columns taken apart from clashing names, batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siren.operators.lookup import written

__all__ = ["held", "id_and_text", "lots", "release", "slices", "smallest", "up_to_limit", "written"]

_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """The worker's one large object, a coder or scorer, made when first asked for; it takes the place of any other's."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Let go of what an earlier operator's tasks have left in this worker."""
    _held.clear()


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; whatever else the table has cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``max_bytes`` of a string column, or one row."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for k, length in enumerate(lengths.tolist()):
        if size + length > max_bytes and k > start:
            yield batch.slice(start, k - start)
            start, size = k, 0
        size += length
    if start < batch.num_rows:
        yield batch.slice(start)


def lots(texts: list[str | None], max_chars: int) -> Iterator[list[str | None]]:
    """Parts of a list with at most ``max_chars`` characters, or one text."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if size + len(text or "") > max_chars and k > start:
            yield texts[start:k]
            start, size = k, 0
        size += len(text or "")
    if start < len(texts):
        yield texts[start:]


def up_to_limit(rows: DataFrame, group: str, key: str, limit: int | Column) -> DataFrame:
    """Rows that may be among the ``limit`` of their group with the smallest hashes: at most one bucket of hashes more.

    Counts per bucket (at most 65,536 a group) give the bucket with the last row; all rows beyond it stay where they are.
    """
    bucket = F.shiftright(key, 48)
    counts = rows.groupBy(group, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("_bucket")) - F.col("n")
    cuts = counts.withColumn("_before", before).where(F.col("_before") < limit)
    cuts = cuts.groupBy(F.col(group).alias("_group")).agg(F.max("_bucket").alias("_cut"))
    within = (F.col(group) == F.col("_group")) & (bucket <= F.col("_cut"))
    return rows.join(F.broadcast(cuts), within, "left_semi")


def smallest(rows: DataFrame, group: str, key: str, limit: int | Column, *ties: str) -> DataFrame:
    """The ``limit`` rows of each group with the smallest hashes; only about so many are ranked in one task.

    ``key`` is a long that spreads over its whole range. Rows without a group are left out. ``rows`` is read twice.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(key, *ties))
    return up_to_limit(rows, group, key, limit).withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")
