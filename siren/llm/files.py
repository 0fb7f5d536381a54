"""Binary files through Spark's own writers and readers, so that any store Spark reaches will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_binary(df: DataFrame, column: str, path: str, separator: str = "\n", rows_per_file: int = 0) -> None:
    """Append the bytes of each row, then ``separator``, to its partition's file; formats must allow for it.

    The text writer puts out a string's bytes as they are. With ``rows_per_file``, a partition gets several files.
    """
    writer = df.select(F.col(column).cast("string").alias("value")).write.option("lineSep", separator)
    writer.option("compression", "none").option("maxRecordsPerFile", rows_per_file).text(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its path and whole content. Files must be of bounded size."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
