"""Readers over landed feed files. Each returns the raw report columns plus ``event_ts``.

A fetcher outside this package lands the files. Feed files of a query go to ``query_used=<query>/mirror_rank=<n>/``
folders, which Spark reads as partition columns, so a search for one query opens only its folders.

An unreadable date gives a NULL ``event_ts`` and an empty ``date``, unless ``ingest_ts`` is given to stand in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siren.functions.text import (
    author_handle, author_name, iso_date, parse_pub_date, report_id, squeeze, strip_tags, text_or_empty,
)
from siren.operators.collect import cap_per_query
from siren.sources.quoted import CDATA, read_records
from siren.schemas import ALERT_ITEM, FEED_ITEM, RAW_COLUMNS, SITUATION_REPORTS, SOCIAL_POST

# Fixed values of the feeds.
MIN_CHARS = 10
POST_DAYS = 3
ALERT_USER = "GDACS_Alert"
ALERT_BIO = "Global Disaster Alert and Coordination System (UN)"
ALERT_QUERY = "gdacs_feed"
SITUATION_TYPES = ["Situation Report", "News and Press Release"]
SITUATION_USER = "ReliefWeb"
SITUATION_BIO = "UN ReliefWeb disaster report"
SITUATION_QUERY = "reliefweb_api"

#: Folders that feed files of a query are landed in.
PARTITIONS = ("query_used", "mirror_rank")


def read_items(spark: SparkSession, path: str, schema: T.StructType, item_lines: bool = False) -> DataFrame:
    """The ``<item>`` elements of XML feed files, with the partition columns among ``schema``.

    Files are cut at the ends of items, so a large document is read by many tasks, and an end that stands inside CDATA is
    none. Feeds landed in bulk as one self-contained item per line (``item_lines``) are read by lines.
    """
    if item_lines:
        return spark.read.format("xml").options(rowTag="item", multiLine=False).schema(schema).load(path)
    folder = [f for f in schema.fields if f.name in PARTITIONS]
    element = T.StructType([f for f in schema.fields if f.name not in PARTITIONS])
    parts = read_records(
        spark, path, header=False, separator="</item>", marks=CDATA, partitions=T.StructType(folder)
    )
    item = F.regexp_extract("text", r"(?s)<item(?=[\s>]).*", 0)
    items = parts.withColumn("_item", item).where("_item != ''")
    row = F.from_xml(F.concat("_item", F.lit("</item>")), element)
    return items.select(row.alias("_row"), *[f.name for f in folder]).select("_row.*", *[f.name for f in folder])


def read_rss_reports(
    spark: SparkSession,
    path: str,
    max_per_query: int | None = None,
    ingest_ts: Column | None = None,
    item_lines: bool = False,
    max_chars: int | None = None,
) -> DataFrame:
    """Post feeds: description, or the title without one; texts under 10 characters are skipped.

    All items and whole texts, unless ``max_per_query`` keeps the newest of each query (counted behind the skipping) or
    ``max_chars`` cuts texts. Only partition folders carry ``query_used`` and ``mirror_rank``.
    """
    items = read_items(spark, path, _with_partitions(FEED_ITEM), item_lines)
    text = strip_tags(
        F.when(text_or_empty("description") != "", F.col("description")).otherwise(F.col("title")), max_chars=None
    )
    reports = items.withColumn("_text", text).where(F.char_length("_text") >= MIN_CHARS)
    reports = reports.select(
        _time(parse_pub_date("pubDate"), ingest_ts),
        report_id("link", F.substring("_text", 1, 30)).alias("tweet_id"),
        _cut(F.col("_text"), max_chars).alias("content"),
        author_handle(F.col("`dc:creator`")).alias("username"),
        F.lit("").alias("user_bio"),
        F.lit("").alias("user_location"),
        F.lit(0).cast("long").alias("like_count"),
        F.lit(0).cast("long").alias("retweet_count"),
        text_or_empty("query_used").alias("query_used"),
        F.coalesce("mirror_rank", F.lit(0)).alias("mirror_rank"),
    )
    return cap_per_query(_dated(reports, "mirror_rank"), max_per_query)


def read_alert_feed(
    spark: SparkSession,
    path: str,
    limit: int | None = None,
    ingest_ts: Column | None = None,
    item_lines: bool = False,
    max_chars: int | None = None,
) -> DataFrame:
    """Hazard alerts with coordinates: all of them, or the newest ``limit``."""
    items = read_items(spark, path, ALERT_ITEM, item_lines)
    lat, lon = text_or_empty("`geo:lat`"), text_or_empty("`geo:long`")
    text = F.concat(text_or_empty("title"), F.lit(". "), text_or_empty("description"))
    alerts = items.select(
        _time(parse_pub_date("pubDate"), ingest_ts),
        report_id("link").alias("tweet_id"),
        strip_tags(text, max_chars).alias("content"),
        F.lit(ALERT_USER).alias("username"),
        F.lit(ALERT_BIO).alias("user_bio"),
        F.when((lat != "") & (lon != ""), F.concat(lat, F.lit(","), lon)).otherwise("").alias("user_location"),
        F.lit(0).cast("long").alias("like_count"),
        F.lit(0).cast("long").alias("retweet_count"),
        F.lit(ALERT_QUERY).alias("query_used"),
    )
    return _newest(_dated(alerts), limit)


def read_situation_reports(
    spark: SparkSession,
    path: str,
    limit: int | None = None,
    types: Sequence[str] = tuple(SITUATION_TYPES),
    ingest_ts: Column | None = None,
    max_body_chars: int | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """Situation reports, one JSON document per line or file: all of them, or the newest ``limit``.

    Texts are whole unless ``max_body_chars`` cuts the body or ``max_chars`` what is made of title and body. A record that
    carries a type must have one of ``types``; records without were filtered by the request.
    """
    documents = spark.read.schema(SITUATION_REPORTS).option("multiLine", False).json(path)
    fields = documents.select(F.inline("data")).select("fields.*")
    wanted = F.col("type").isNull() | F.exists("type", lambda kind: kind["name"].isin(list(types)))
    first_country = F.try_element_at("country", F.lit(1))["name"]
    first_source = F.try_element_at("source", F.lit(1))["name"]
    text = F.concat(text_or_empty("title"), F.lit(". "), _cut(text_or_empty("body"), max_body_chars))
    reports = fields.where(wanted).select(
        _time(F.try_to_timestamp("date.created"), ingest_ts),
        report_id("title", "date.created").alias("tweet_id"),
        _cut(squeeze(text), max_chars).alias("content"),
        author_name(first_source, SITUATION_USER).alias("username"),
        F.lit(SITUATION_BIO).alias("user_bio"),
        text_or_empty(first_country).alias("user_location"),
        F.lit(0).cast("long").alias("like_count"),
        F.lit(0).cast("long").alias("retweet_count"),
        F.lit(SITUATION_QUERY).alias("query_used"),
    )
    return _newest(_dated(reports), limit)


def read_social_posts(
    spark: SparkSession,
    path: str,
    as_of: Column | None = None,
    days: int = POST_DAYS,
    lang: str = "en",
    max_per_query: int | None = None,
) -> DataFrame:
    """Native posts, JSON lines: of one language, from the day ``days`` before ``as_of`` on."""
    posts = spark.read.schema(SOCIAL_POST).json(path)
    event_ts = F.try_to_timestamp("date")
    since = F.date_trunc("day", (F.current_timestamp() if as_of is None else as_of) - F.expr(f"INTERVAL {days} DAYS"))
    recent = posts.where((F.col("lang") == lang) & (event_ts >= since))
    reports = recent.select(
        event_ts.alias("event_ts"),
        F.col("id").alias("tweet_id"),
        F.coalesce("rawContent", "content", F.lit("")).alias("content"),
        text_or_empty("user.username").alias("username"),
        text_or_empty("user.description").alias("user_bio"),
        text_or_empty("user.location").alias("user_location"),
        F.coalesce("likeCount", F.lit(0)).cast("long").alias("like_count"),
        F.coalesce("retweetCount", F.lit(0)).cast("long").alias("retweet_count"),
        F.col("query").alias("query_used"),
    )
    return cap_per_query(_dated(reports), max_per_query)


def _cut(text: Column, max_chars: int | None) -> Column:
    return text if max_chars is None else F.substring(text, 1, max_chars)


def _with_partitions(schema: T.StructType) -> T.StructType:
    return T.StructType([
        *schema.fields,
        T.StructField("query_used", T.StringType()),
        T.StructField("mirror_rank", T.IntegerType()),
    ])


def _time(event_ts: Column, ingest_ts: Column | None) -> Column:
    return (event_ts if ingest_ts is None else F.coalesce(event_ts, ingest_ts)).alias("event_ts")


def _dated(reports: DataFrame, *extra: str) -> DataFrame:
    return reports.withColumn("date", iso_date("event_ts")).select("event_ts", *RAW_COLUMNS, *extra)


def _newest(reports: DataFrame, limit: int | None) -> DataFrame:
    if limit is None:
        return reports
    return reports.orderBy(F.col("event_ts").desc_nulls_last(), "tweet_id").limit(limit)
