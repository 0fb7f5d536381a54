"""Stored reports: CSV readers, writers, JSON records, file freshness."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siren.operators.lookup import row_hash, written
from siren.sources.quoted import read_records
from siren.schemas import ENRICHED, ENRICHED_COLUMNS, LABELLED, LEGACY, RAW, RAW_COLUMNS, STORED_COLUMNS, ensure_columns

FRESH_MINUTES = 5
#: What stands for line breaks, and for the sign that begins these, in files that are written as one row per line.
ESCAPES = (("%", "%25"), ("\n", "%0A"), ("\r", "%0D"))


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, escaped: bool = False, lenient: bool = False
) -> DataFrame:
    """CSV with a header, doubled quotes and line breaks inside quotes (RFC 4180); tasks split large files.

    ``escaped`` reads what ``write_csv`` wrote with it. ``lenient`` is for files with quotes outside quoted fields, where
    counting quotes tells nothing: a file is then read by one task.
    """
    options = {"escape": '"', "multiLine": lenient}
    if escaped or lenient:
        rows = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, **options)
        return _escaped(rows, [(code, plain) for plain, code in reversed(ESCAPES)]) if escaped else rows
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    # Line breaks inside quotes stay as they are.
    row = F.from_csv("text", ddl, {"escape": '"', "multiLine": "true", "lineSep": "\x00"})
    records = read_records(spark, path).select(F.regexp_replace("text", "\r$", "").alias("text"))
    return records.select(row.alias("_row")).select("_row.*")


def write_csv(df: DataFrame, path: str, escaped: bool = False) -> None:
    """CSV with a header and line breaks inside quotes; ``escaped`` writes one row per line, with codes for line breaks."""
    rows = _escaped(df, ESCAPES) if escaped else df
    options = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.mode("overwrite").csv(path, header=True, escape='"', **options)


def _escaped(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    texts = [name for name, kind in df.dtypes if kind == "string"]
    return df.withColumns({
        name: reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), pairs, F.col(name)) for name in texts
    })


def read_raw_csv(spark: SparkSession, path: str, **options: bool) -> DataFrame:
    """Raw reports; an absent text is the empty string."""
    return read_csv(spark, path, RAW, **options).na.fill("")


def read_enriched_csv(spark: SparkSession, path: str, **options: bool) -> DataFrame:
    """Enriched reports in the columns of the CSV form; absent texts are empty, absent coordinates stay NULL."""
    return read_csv(spark, path, ENRICHED, **options).na.fill("")


def read_legacy_csv(spark: SparkSession, path: str, **options: bool) -> DataFrame:
    """The older layout, renamed to the raw one."""
    renamed = read_csv(spark, path, LEGACY, **options).withColumnsRenamed(
        {"text": "content", "bio": "user_bio", "location": "user_location"}
    )
    return ensure_columns(renamed.na.fill(""))


def read_labelled(spark: SparkSession, path: str, **options: bool) -> DataFrame:
    return read_csv(spark, path, LABELLED, **options)


def raw_rows(df: DataFrame, max_field_chars: int | None = None) -> DataFrame:
    """The stored raw columns in order, as text; ``max_field_chars`` cuts each."""

    def field(name: str) -> Column:
        text = F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")
        return text if max_field_chars is None else F.substring(text, 1, max_field_chars)

    return df.select(*[field(name).alias(name) for name in RAW_COLUMNS])


def write_raw(df: DataFrame, path: str, format: str = "parquet", max_field_chars: int | None = None) -> None:
    rows = raw_rows(df, max_field_chars)
    if format == "csv":
        write_csv(rows, path)
    else:
        rows.write.mode("overwrite").format(format).save(path)


def enriched_rows(df: DataFrame, columns: Sequence[str] = STORED_COLUMNS) -> DataFrame:
    """Those of the stored columns that exist, most urgent first.

    Equal scores are ordered by id, or by a hash of the row without one, so they never form one range of a sort.
    """
    tie = F.col("tweet_id") if "tweet_id" in df.columns else F.lit("")
    ordered = df.orderBy(F.col("urgency_score").desc(), tie, row_hash(df))
    return ordered.select(*[name for name in columns if name in df.columns])


def write_enriched(df: DataFrame, path: str, format: str = "parquet", staged: bool = True) -> None:
    """The stored table: id, time, probabilities and all other enriched columns, which searches, counters, display and
    map read back, and which can be written again. CSV has the fixed columns of that form only.

    Sorted by range over all files, so scans for urgent reports skip most of them by their statistics. A range sort
    reads its input twice, once to sample the ranges. ``staged`` writes the unsorted rows to the shared folder first,
    so that the enrichment itself runs once; leave it out for a table that is stored already.
    """
    wanted = [name for name in STORED_COLUMNS if name in df.columns]
    rows = written(df.select(*wanted), "enriched-unsorted") if staged else df
    if format == "csv":
        write_csv(enriched_rows(rows, ENRICHED_COLUMNS), path)
    else:
        enriched_rows(rows).write.mode("overwrite").format(format).save(path)


def write_enriched_by_day(df: DataFrame, path: str) -> None:
    """All enriched columns by day of the report, each file sorted by urgency.

    ``rebalance`` lets adaptive execution cut a busy day into many files and join quiet days into few.
    """
    dated = df.withColumn("event_date", F.to_date("event_ts")).hint("rebalance", "event_date")
    (
        dated.sortWithinPartitions("event_date", F.col("urgency_score").desc())
        .write.mode("overwrite")
        .partitionBy("event_date")
        .parquet(path)
    )


def to_json_records(df: DataFrame) -> DataFrame:
    """Each row as a JSON object; absent values as null."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def age_label(seconds: Column) -> Column:
    """An age as "12s ago", "4m ago", "3h ago"."""
    return (
        F.when(seconds < 60, F.concat(F.floor(seconds).cast("string"), F.lit("s ago")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
        .otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))
    )


def source_freshness(files: DataFrame, as_of: Column | None = None, minutes: float = FRESH_MINUTES) -> DataFrame:
    """Per file of a file-backed table: rows, age, whether it is still fresh.

    ``_metadata`` comes from the scan, so no data column is read.
    """
    modified = F.col("_metadata.file_modification_time")
    per_file = files.select(F.col("_metadata.file_name").alias("file_name"), modified.alias("modified")).groupBy(
        "file_name", "modified"
    ).agg(F.count(F.lit(1)).alias("n_rows"))
    now = F.current_timestamp() if as_of is None else as_of
    seconds = F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros("modified") / 1e6
    return per_file.select(
        "file_name", "n_rows", age_label(seconds).alias("age"), (seconds / 60 < minutes).alias("fresh")
    )
