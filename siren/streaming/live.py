"""The live feed: the batch column functions on a stream of landed files.

``stream_enrich`` runs the batch function on every micro-batch, whatever the gazetteer's size, and appends to a table;
counters and alerts are streams over that table (``read_enriched``). Counters are kept by Spark's own keyed state, one row
a window, and what changes goes to a versioned table of a bounded number of folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from siren.functions.scoring import is_critical
from siren.operators.enrich import enrich_repeated
from siren.operators.gazetteer import Places, prepare
from siren.sources.versioned import Version, VersionedTable
from siren import lexicons as L

#: Folders of changed windows before they are made one.
MAX_FOLDERS = 8
_COUNTERS = (
    "window_start timestamp, window_end timestamp, total long, high_urgency long, unknown_location long, critical_review long"
)


def read_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    format: str = "parquet",
    max_files: int | None = None,
    **options: str,
) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.format(format).schema(schema).options(**options)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_dedup(stream: DataFrame, delay: str = "1 day", key: str = "tweet_id", time: str = "event_ts") -> DataFrame:
    """First-seen reports across refreshes. State is dropped once ``delay`` has passed."""
    return stream.where(F.col(key) != "").withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def window_counters(reports: DataFrame, window: str = "1 hour", time: str = "event_ts") -> DataFrame:
    """Counters of enriched reports per window of event time."""
    return (
        reports.groupBy(F.window(time, window))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("urgency_score") > L.HIGH_URGENCY).alias("high_urgency"),
            F.count_if(F.col("location") == "unknown").alias("unknown_location"),
            F.count_if(is_critical()).alias("critical_review"),
        )
        .select(
            F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
            "total", "high_urgency", "unknown_location", "critical_review",
        )
    )


def start(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append the stream to a Parquet table: what is there now, or every ``interval`` from now on."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return writer.trigger(**trigger).start(path)


def read_enriched(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The table that ``stream_enrich`` appends to, as a stream; at least one batch must have been written."""
    return read_stream(spark, path, spark.read.parquet(path).schema, max_files=max_files)


def stream_enrich(
    stream: DataFrame, path: str, checkpoint: str, gazetteer: DataFrame | Places | None = None, interval: str | None = None
) -> StreamingQuery:
    """Enrich every new report and append it to a Parquet table. The gazetteer is made ready once, before the first batch.

    Enriching works row by row while the gazetteer is short enough to be part of the expressions, and always within
    a micro-batch; so each micro-batch goes through the batch function, whatever the gazetteer's size. A batch that
    is run again after a failure writes the same folder again.
    """

    places = None if gazetteer is None else prepare(gazetteer)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        enrich_repeated(batch, places).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _each_batch(stream, write_batch, checkpoint, interval)


def stream_counters(
    stream: DataFrame, path: str, checkpoint: str, window: str = "1 hour", interval: str | None = None, time: str = "event_ts"
) -> StreamingQuery:
    """Keep counters per window of enriched reports.

    The counters of every window are keyed state of the stream, without a watermark: a report counts however late it
    comes, and the state has one row a window. Each batch stores the windows it changed, as they are then, in a versioned
    table; after ``MAX_FOLDERS`` such changes they are made one folder again. A batch that is run again after a failure is
    known by its number and stores nothing. A new checkpoint counts from the start and takes the table's place.
    """
    table = VersionedTable(stream.sparkSession, path, _COUNTERS)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint

        def change(version: Version) -> tuple[list[str], dict] | None:
            same = version.notes.get("query") == query
            if same and version.notes["batch"] >= batch_id:
                return None
            folders = [*(version.folders if same else []), table.stage(batch)]
            if len(folders) > MAX_FOLDERS:
                folders = [table.stage(_newest(table.read(Version(-1, folders))))]
            return folders, {"query": query, "batch": batch_id}

        table.update(change)
        if batch_id % MAX_FOLDERS == 0:
            table.clean()

    counted = window_counters(stream, window, time)
    return _each_batch(counted, write_batch, checkpoint, interval, "update")


def _newest(rows: DataFrame) -> DataFrame:
    """The newest row of each window."""
    names = ("total", "high_urgency", "unknown_location", "critical_review")
    newest = F.max_by(F.struct(*names), "_at").alias("_newest")
    return rows.groupBy("window_start", "window_end").agg(newest).select("window_start", "window_end", "_newest.*")


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """The counters of all windows so far."""
    return _newest(VersionedTable(spark, path, _COUNTERS).read())


def stream_alerts(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append enriched reports that are urgent and without a place to an alerts table, once each.

    The sink's own log names the files of each batch, so a batch that is run again adds nothing twice.
    """
    return start(stream.where(F.col("priority") == "CRITICAL_REVIEW"), path, checkpoint, interval)


def _each_batch(
    stream: DataFrame, write_batch, checkpoint: str, interval: str | None, mode: str = "append"
) -> StreamingQuery:
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return (
        stream.writeStream.foreachBatch(write_batch)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
