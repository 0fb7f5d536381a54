import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siren.sources import feeds, tables

ROOT = '<?xml version="1.0"?>\n<rss xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:geo="http://www.w3.org/2003/01/geo/wgs84_pos#"><channel><title>feed</title>%s</channel></rss>'


def item(**fields):
    names = {"creator": "dc:creator", "lat": "geo:lat", "long": "geo:long"}
    return "<item>" + "".join(f"<{names.get(k, k)}>{v}</{names.get(k, k)}>" for k, v in fields.items()) + "</item>"


def land(folder, name, content):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as file:
        file.write(content)
    return str(folder)


def test_rss_documents_with_mirrors(spark, tmp_path):
    first = item(title="T", description="&lt;b&gt;Flood&lt;/b&gt;  in&#10;Lima today", pubDate="Sat, 18 Apr 2026 10:47:54 +0000", link="l1", creator="@@ana")
    second = item(title="Only a title here", link="l2", pubDate="yesterday")
    short = item(title="short", link="l3", creator="x")
    land(tmp_path / "query_used=flood help" / "mirror_rank=1", "a.xml", ROOT % (first + second + short))
    land(tmp_path / "query_used=flood help" / "mirror_rank=2", "a.xml", ROOT % first)
    rows = feeds.read_rss_reports(spark, str(tmp_path)).orderBy("mirror_rank", "content").collect()
    assert [(r.content, r.username, r.date, r.query_used, r.mirror_rank) for r in rows] == [
        ("Flood in Lima today", "ana", "2026-04-18T10:47:54+00:00", "flood help", 1),
        ("Only a title here", "unknown", "", "flood help", 1),
        ("Flood in Lima today", "ana", "2026-04-18T10:47:54+00:00", "flood help", 2),
    ]
    assert all(len(r.tweet_id) == 16 for r in rows) and rows[0].tweet_id == rows[2].tweet_id
    ingest = F.lit("2026-05-01 00:00:00").cast("timestamp")
    dated = feeds.read_rss_reports(spark, str(tmp_path), ingest_ts=ingest).where("content LIKE 'Only%'").first()
    assert dated.date == "2026-05-01T00:00:00+00:00"


def test_rss_cap_keeps_the_newest(spark, tmp_path):
    items = [item(title=f"report number {i}", link=f"l{i}", pubDate=f"Sat, 18 Apr 2026 10:{i:02d}:00 GMT") for i in range(30)]
    land(tmp_path / "query_used=q" / "mirror_rank=0", "a.xml", ROOT % "".join(items))
    assert feeds.read_rss_reports(spark, str(tmp_path)).count() == 30
    kept = feeds.read_rss_reports(spark, str(tmp_path), max_per_query=20)
    assert kept.count() == 20 and kept.agg(F.min("date")).first()[0] == "2026-04-18T10:10:00+00:00"


def test_alerts(spark, tmp_path):
    both = item(title="Quake", description="near &lt;i&gt;coast&lt;/i&gt;", link="l1", lat="1.5", long="-2.5", pubDate="Sat, 18 Apr 2026 10:47:54 GMT")
    half = item(title="Fire", description="x" * 600, link="l2", lat="1.5")
    path = land(tmp_path, "a.xml", ROOT % (both + half))
    assert max(len(r.content) for r in feeds.read_alert_feed(spark, path, max_chars=500).collect()) == 500
    rows = feeds.read_alert_feed(spark, path).orderBy("content").collect()
    assert [(r.content[:17], len(r.content), r.user_location) for r in rows] == [
        ("Fire. xxxxxxxxxxx", 606, ""), ("Quake. near coast", 17, "1.5,-2.5"),
    ]


def test_situation_reports(spark, tmp_path):
    def record(**fields):
        return {"fields": fields}

    answer = {"data": [
        record(title="A  b", body="x" * 400, date={"created": "2026-04-02T00:00:00+00:00"}, country=[{"name": "Peru"}, {"name": "Chile"}], source=[{"name": "Office for the Coordination of Aid"}], type=[{"name": "Situation Report"}]),
        record(title="C", date={"created": "2026-04-03T00:00:00+00:00"}, country=[], type=[{"name": "Map"}]),
        record(title="D", body="short"),
    ]}
    path = land(tmp_path, "a.json", json.dumps(answer))
    rows = feeds.read_situation_reports(spark, path).collect()
    assert [(r.content[:6], r.user_location, r.username) for r in rows] == [
        ("A b. x", "Peru", "Office_for_the_Coordination_of"), ("D. sho", "", "ReliefWeb"),
    ]
    assert len(rows[0].content) == 405
    cut = feeds.read_situation_reports(spark, path, max_body_chars=300, max_chars=302).collect()
    assert [len(r.content) for r in cut] == [302, 8]
    assert feeds.read_situation_reports(spark, path, limit=1).first().content.startswith("A b")


def test_social_posts(spark, tmp_path):
    posts = [
        {"date": "2026-04-10T00:00:01+00:00", "id": 1, "rawContent": "new", "user": {"username": "u", "description": None, "location": "L"}, "likeCount": None, "lang": "en", "query": "q"},
        {"date": "2026-04-09T23:59:59+00:00", "id": 2, "rawContent": "old", "lang": "en", "query": "q"},
        {"date": "2026-04-12T00:00:00+00:00", "id": 3, "rawContent": "otra", "lang": "es", "query": "q"},
        {"date": "2026-04-12T00:00:00+00:00", "id": 4, "content": "plain", "retweetCount": 5, "lang": "en", "query": "q"},
    ]
    path = land(tmp_path, "a.json", "\n".join(map(json.dumps, posts)))
    as_of = F.lit("2026-04-13 15:00:00").cast("timestamp")
    rows = feeds.read_social_posts(spark, path, as_of=as_of).orderBy("tweet_id").collect()
    assert [(r.tweet_id, r.content, r.username, r.user_bio, r.like_count, r.retweet_count) for r in rows] == [
        ("1", "new", "u", "", 0, 0), ("4", "plain", "", "", 0, 5),
    ]


@pytest.mark.parametrize("size", [48, 200, 4096])
def test_feed_document_split_anywhere(spark, tmp_path, size):
    """A document is cut at ends of items, not at ends inside CDATA, whatever the splits are."""
    items = [
        item(title=f"<![CDATA[report {k} </item> & <item> {'x' * (k % 50)}]]>", description=f"number &lt;{k}&gt; of the day", link=f"l{k}", creator="a")
        if k % 3 == 0 else item(description=f"number {k} of the\nday", link=f"l{k}", pubDate="Sat, 18 Apr 2026 10:47:54 GMT")
        for k in range(60)
    ]
    land(tmp_path / "query_used=q 1" / "mirror_rank=2", "a.xml", ROOT % "\n".join(items))
    land(tmp_path / "query_used=q 2" / "mirror_rank=0", "b.xml", ROOT % items[0])
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = feeds.read_items(spark, str(tmp_path), feeds._with_partitions(feeds.FEED_ITEM))
        assert found.rdd.getNumPartitions() > 2
        rows = sorted((r.query_used, r.mirror_rank, int(r.link[1:]), r.title, r.description) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    title = lambda k: f"report {k} </item> & <item> {'x' * (k % 50)}".strip()
    wanted = [("q 1", 2, k, title(k), f"number <{k}> of the day") if k % 3 == 0 else ("q 1", 2, k, None, f"number {k} of the\nday") for k in range(60)]
    assert rows == [*wanted, ("q 2", 0, 0, title(0), "number <0> of the day")]


AWKWARD = ['say "help", now', "line one\nline two", " padded ", "back\\slash", "", 'ends with "', '"\n"', '"",""\r\n,x', "100%25 %0A", "\n\n"]


@pytest.mark.parametrize("escaped", [False, True])
def test_csv_round_trip(spark, tmp_path, escaped):
    rows = [("2026", f"t{i}", text, "u", None, "", i, 0, "q") for i, text in enumerate(AWKWARD)]
    df = spark.createDataFrame(rows, tables.RAW)
    tables.write_csv(df, str(tmp_path / "raw"), escaped=escaped)
    read = tables.read_raw_csv(spark, str(tmp_path / "raw"), escaped=escaped).orderBy("tweet_id").collect()
    assert [r.content for r in read] == AWKWARD
    assert [r.user_bio for r in read] == [""] * len(AWKWARD)
    assert read[3].like_count == 3


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 4096])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_split_anywhere(spark, tmp_path, size, end):
    """Splits of any size give what a reader of the whole file gives: records over many splits, splits within one field."""
    import csv
    import io
    import random

    draw = random.Random(size)
    rows = [["id", "text"]] + [[str(k), "".join(draw.choices('ab",\n \r', k=draw.randint(0, 30))).strip("\r")] for k in range(60)]
    rows[5][1] = "long\n" * 40
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_NONNUMERIC).writerows(rows)
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_bytes(out.getvalue().encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size * 16))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = tables.read_csv(spark, str(tmp_path), T.StructType.fromDDL("id string, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.id, r.text or "") for r in found) == sorted(map(tuple, rows[1:] * 2))


def test_csv_is_read_by_many_tasks(spark, tmp_path):
    df = spark.range(40000).select(F.concat(F.lit("line one\nline two %0A "), F.col("id").cast("string")).alias("content"))
    tables.write_raw(df.coalesce(1), str(tmp_path / "raw"), format="csv")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        read = tables.read_raw_csv(spark, str(tmp_path / "raw"))
        assert read.rdd.getNumPartitions() > 4
        assert read.select("content").exceptAll(df).count() == 0 and read.count() == 40000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_of_other_programs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeff" + ",".join(tables.RAW_COLUMNS) + '\n2026,t1,"two\nlines, 100%25",u,,,1,2,q\n\n')
    for lenient in (False, True):
        assert tables.read_raw_csv(spark, str(tmp_path), lenient=lenient).first().content == "two\nlines, 100%25"


def test_raw_fields(spark):
    df = spark.createDataFrame([("x" * 1500, 7)], "content string, like_count long")
    row = tables.raw_rows(df).first()
    assert (len(row.content), row.like_count, row.tweet_id) == (1500, "7", "")
    assert len(tables.raw_rows(df, max_field_chars=1000).first().content) == 1000
    assert tables.raw_rows(df).columns == tables.RAW_COLUMNS


def test_enriched_csv_keeps_absent_coordinates(spark, tmp_path):
    rows = [("d", "c", "Information", 4.0, "unknown", "none", "none", "LOW", None, None, "u", None, "q")]
    tables.write_csv(spark.createDataFrame(rows, tables.ENRICHED), str(tmp_path / "e"))
    row = tables.read_enriched_csv(spark, str(tmp_path / "e")).first()
    assert (row.lat, row.user_location, row.urgency_score) == (None, "", 4.0)


def test_legacy_csv(spark, tmp_path):
    path = land(tmp_path, "a.csv", 'date,text,username,bio,location\n2026-04-07,"Help, flood","u1","medic","Pune"\n')
    row = tables.read_legacy_csv(spark, path).first()
    assert (row.content, row.user_bio, row.user_location) == ("Help, flood", "medic", "Pune")


@pytest.mark.parametrize("seconds, label, fresh", [(59, "59s ago", True), (299, "4m ago", True), (300, "5m ago", False), (7300, "2h ago", False)])
def test_freshness(spark, tmp_path, seconds, label, fresh):
    path = land(tmp_path, "a.json", '{"a": 1}\n{"a": 2}')
    os.utime(os.path.join(path, "a.json"), (1_700_000_000, 1_700_000_000))
    as_of = F.timestamp_seconds(F.lit(1_700_000_000 + seconds))
    row = tables.source_freshness(spark.read.schema("a int").json(path), as_of).first()
    assert (row.n_rows, row.age, row.fresh) == (2, label, fresh)


def test_json_records_keep_nulls(spark):
    record = tables.to_json_records(spark.createDataFrame([("a", None)], "x string, lat double")).first().record
    assert json.loads(record) == {"x": "a", "lat": None}


def test_csv_with_line_breaks_is_landed_by_many_tasks(spark, tmp_path, monkeypatch):
    """No task writes the whole table: as many files as the documents have pieces."""
    from siren.plans import catalog

    spark.range(0, 400, numPartitions=4).selectExpr("id AS doc_id", "CONCAT('a \"b\"\n', id) AS text").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(catalog, "new_path", lambda spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 30)
    try:
        found = catalog.QUERIES["read_csv_line_breaks"](spark, str(tmp_path))
        assert sorted(r.content for r in found.collect()) == sorted(f'a "b"\n{i}' for i in range(400))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(list((tmp_path / "quoted-csv").glob("*.csv"))) == 4
