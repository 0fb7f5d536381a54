from pyspark.sql import functions as F

from siren.operators.enrich import enrich
from siren.plans import relations as R
from siren.plans.catalog import _stream_reports
from siren.schemas import RAW
from siren.streaming import live

COLUMNS = "event_ts timestamp, tweet_id string, content string, user_bio string, user_location string"
FOUND = ["tweet_id", "category", "urgency_score", "location", "priority", "lat"]


def land(spark, folder, rows):
    spark.createDataFrame(rows, COLUMNS).withColumn("event_ts", F.col("event_ts").cast("timestamp")).coalesce(1).write.mode(
        "append"
    ).parquet(str(folder))


def reports(spark, ids, hour=1):
    import datetime as dt

    return [(dt.datetime(2024, 1, 1, hour, i % 60), f"t{i}", *R.TEMPLATES[i % len(R.TEMPLATES)]) for i in ids]


def stream(spark, folder):
    return live.read_stream(spark, str(folder), spark.read.parquet(str(folder)).schema, max_files=1)


def test_refreshes_equal_the_batch_result(spark, tmp_path):
    places = R.gazetteer(spark)
    run = lambda: live.stream_enrich(
        stream(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), places
    ).awaitTermination()
    land(spark, tmp_path / "in", reports(spark, range(20)))
    run()
    land(spark, tmp_path / "in", reports(spark, range(20, 50)))
    run()  # picks up from the checkpoint
    run()  # nothing new
    found = spark.read.parquet(str(tmp_path / "out")).select(*FOUND)
    wanted = enrich(spark.read.parquet(str(tmp_path / "in")), places).select(*FOUND)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))
    assert found.count() == 50


def test_dedup_across_refreshes(spark, tmp_path):
    run = lambda: live.start(
        live.stream_dedup(stream(spark, tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")
    ).awaitTermination()
    land(spark, tmp_path / "in", reports(spark, [1, 2, 2, 3]))
    run()
    land(spark, tmp_path / "in", reports(spark, [3, 4, 1], hour=2) + [(None, "", "x", "", "")])
    run()
    ids = [r.tweet_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(ids) == ["t1", "t2", "t3", "t4"]


def test_counters_of_all_windows(spark, tmp_path):
    """Over several refreshes, a late file, and a table of places too large to be part of the expressions."""
    more = spark.range(2000).selectExpr("concat('zzplace', id) place", "'x' display", "0D lat", "0D lon")
    places = R.gazetteer(spark).unionAll(more)

    def run():
        live.stream_enrich(stream(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), places).awaitTermination()
        enriched = live.read_enriched(spark, str(tmp_path / "out"), max_files=1)
        live.stream_counters(enriched, str(tmp_path / "counts"), str(tmp_path / "ck2")).awaitTermination()

    land(spark, tmp_path / "in", reports(spark, range(14), 2))
    run()
    land(spark, tmp_path / "in", reports(spark, range(14), 9))
    land(spark, tmp_path / "in", reports(spark, range(14), 2))
    run()
    run()  # nothing new
    rows = live.read_counters(spark, str(tmp_path / "counts")).orderBy("window_start").collect()
    assert [(r.window_start.hour, r.total, r.high_urgency, r.unknown_location, r.critical_review) for r in rows] == [
        (2, 28, 10, 6, 2), (9, 14, 5, 3, 1),
    ]


def test_alerts(spark, tmp_path):
    land(spark, tmp_path / "in", reports(spark, range(28)))
    live.stream_enrich(
        stream(spark, tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "ck1"), R.gazetteer(spark)
    ).awaitTermination()
    enriched = live.read_enriched(spark, str(tmp_path / "table"))
    live.stream_alerts(enriched, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.tweet_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["t18", "t4"]


def test_more_reports_are_landed_in_more_files_not_longer_ones(spark, tmp_path, monkeypatch):
    """A batch is a third of the files, however many there are."""
    sf_dir = "/root/testdata/sf0.001"
    n = R.table(spark, sf_dir, "events").count()
    assert len(spark.read.parquet(R.landed_reports(spark, sf_dir)).inputFiles()) == 6
    monkeypatch.setattr(R, "ROWS_PER_FILE", -(-n // 24))
    landed = spark.read.parquet(R.landed_reports(spark, sf_dir))
    assert len(landed.inputFiles()) == 24 and landed.distinct().count() == n
    batches = []
    live._each_batch(
        _stream_reports(spark, sf_dir), lambda batch, _: batches.append(batch.count()), str(tmp_path / "ck"), None
    ).awaitTermination()
    assert len(batches) == 3 and sum(batches) == n


def test_pieces_a_little_long_are_not_moved(spark, monkeypatch):
    """All rows of a batch are moved only if its pieces are more than twice as long as wanted."""
    from siren.operators import enrich as E

    rows = spark.range(0, 1000, numPartitions=2).selectExpr("id", "'Sun' AS content")
    for wanted, pieces in ((400, 2), (250, 2), (200, 5)):
        monkeypatch.setattr(E, "ROWS_PER_JOIN_TASK", wanted)
        assert E.enrich_repeated(rows).rdd.getNumPartitions() == pieces


def test_raw_schema_covers_the_csv_columns():
    assert RAW.names[0] == "date" and len(RAW.names) == 9
