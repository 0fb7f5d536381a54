"""Records whose separator may also stand inside them, read by as many tasks as the files have splits.

Whether a line break of a CSV file ends a record depends on how many quotes stand before it in the file; whether ``</item>``
ends an item of a feed, on the CDATA marks before it. One pass counts such marks in each split; prefix sums of the counts'
parities tell which splits begin inside a field. In the second pass each task knows how its split begins, and puts records
together where they stand. Only the parts of records that lie across splits are shuffled, at most two for each split.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a row of the second pass is: a record, or the part of one that ends, goes through or begins in the split.
WHOLE, END, MIDDLE, BEGIN = range(4)
_PARTS = "kind int, file long, start long, header boolean, text string"
QUOTE = ('"',)
CDATA = ("<![CDATA[", "]]>")


def _lines(spark: SparkSession, path: str | list[str], separator: str, partitions: T.StructType) -> DataFrame:
    """What stands between separators, in the order of each split, with a hash of the file's path, the split's first byte,
    and the partition columns of its folder."""
    schema = T.StructType([T.StructField("value", T.StringType()), *partitions.fields])
    rows = spark.read.schema(schema).text(path, lineSep=separator)
    return rows.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value",
        *partitions.names,
    )


def _begin_inside(lines: DataFrame, marks: Sequence[str]) -> set[tuple[int, int]]:
    """The splits that begin inside a field: two numbers for each such split of the table."""
    count = F.lit(0)
    for mark in marks:
        without = F.length(F.replace("value", F.lit(mark), F.lit("")))
        count = count + (F.length("value") - without) / len(mark)
    counts = lines.groupBy("file", "start").agg(F.sum(count.cast("long")).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n")
    inside = counts.select("file", "start", (before % 2).alias("odd")).where("odd = 1")
    return {(row.file, row.start) for row in inside.collect()}


class _Split:
    """A split that is being read: what is open, and whether its first record was seen."""

    def __init__(self, file: int, start: int, inside: bool, separator: str, marks: Sequence[str], folder: dict):
        self.key, self.inside, self.separator, self.marks, self.folder = (file, start), inside, separator, marks, folder
        # The first record of a file is its header.
        self.header, self.open = start == 0, [] if not inside else [""]
        self.kind = END if inside else BEGIN
        self.rows: list[tuple] = []

    def add(self, kind: int, text: str) -> None:
        if kind != WHOLE or text.strip("\r"):  # blank lines are no records
            self.rows.append((kind, *self.key, self.header and kind in (WHOLE, BEGIN), text))
            if kind in (WHOLE, BEGIN):
                self.header = False

    def read(self, lines: pa.Array) -> None:
        count = sum(pc.count_substring(lines, mark).to_numpy(zero_copy_only=False) for mark in self.marks)
        after = (np.cumsum(count) + self.inside) % 2
        texts, last = lines.to_pylist(), 0
        for at in np.flatnonzero(after == 0).tolist():
            if not self.open and at == last:
                self.add(WHOLE, texts[at])
            else:
                self.add(self.kind if self.kind == END else WHOLE, self.separator.join([*self.open, *texts[last : at + 1]]))
                self.open, self.kind = [], BEGIN
            last = at + 1
        self.open += texts[last:]
        self.inside = bool(after[-1]) if len(after) else self.inside

    def close(self) -> None:
        if self.open and (self.kind == BEGIN or len(self.open) > 1):
            self.add(BEGIN if self.kind == BEGIN else MIDDLE, self.separator.join(self.open))

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * 5
        columns += [[value] * len(self.rows) for value in self.folder.values()]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read_records(
    spark: SparkSession,
    path: str | list[str],
    header: bool = True,
    separator: str = "\n",
    marks: Sequence[str] = QUOTE,
    partitions: T.StructType | None = None,
) -> DataFrame:
    """(text, *partitions) of each record of the files, as it stands there, without the headers.

    ``marks`` begin and end what separators do not count in, by turns. Blank records are left out.
    """
    partitions = T.StructType([]) if partitions is None else partitions
    lines = _lines(spark, path, separator, partitions)
    inside = spark.sparkContext.broadcast(_begin_inside(lines, marks))
    names = partitions.names
    schema = T.StructType([*T.StructType.fromDDL(_PARTS).fields, *partitions.fields])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: _Split | None = None
        parts = None
        for batch in batches:
            if parts is None:
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
                fields = list(zip(["kind", "file", "start", "header", "text"], kinds, strict=True))
                parts = pa.schema([*fields, *[(name, batch.schema.field(name).type) for name in names]])
            files, starts = batch.column("file").to_numpy(), batch.column("start").to_numpy()
            edges = np.flatnonzero((np.diff(files) != 0) | (np.diff(starts) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(files)], strict=True):
                if a == b:
                    continue
                key = (int(files[a]), int(starts[a]))
                if split is None or split.key != key:
                    if split is not None:
                        split.close()
                        yield split.batch(parts)
                    folder = {name: batch.column(name)[a].as_py() for name in names}
                    split = _Split(*key, key in inside.value, separator, marks, folder)
                split.read(batch.column("value").slice(a, b - a))
                yield split.batch(parts)
        if split is not None:
            split.close()
            yield split.batch(parts)

    found = lines.mapInArrow(records, schema)
    whole = found.where(F.col("kind") == WHOLE).select("header", "text", *names)
    in_file = Window.partitionBy("file").orderBy("start", "kind")
    number = F.sum((F.col("kind") == BEGIN).cast("int")).over(in_file)
    across = found.where(F.col("kind") != WHOLE).withColumn("_record", number).groupBy("file", "_record").agg(
        F.max("header").alias("header"), F.array_sort(F.collect_list(F.struct("start", "kind", "text"))).alias("_parts"),
        *[F.first(name).alias(name) for name in names],
    )
    # The parts behind the first begin with the separator.
    text = F.array_join(F.transform("_parts", lambda part: part["text"]), "").alias("text")
    every = whole.unionAll(across.select("header", text, *names))
    return (every.where("NOT header") if header else every).select("text", *names)
