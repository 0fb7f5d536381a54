"""Relations the registered queries read, all derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siren.functions.text import iso_date, report_id
from siren.operators.enrich import enrich, enrich_repeated  # noqa: F401
from siren.operators.lookup import spread
from siren.schemas import GAZETTEER
from siren.session import new_path
from siren.sources.tables import write_enriched

# Texts given to the events: content, bio, profile location. Together they reach every branch of the rules.
TEMPLATES = [
    (
        "Urgent!! SOS from the Houston clinic: two people dying, emergency rescue asked to help https://ex.am/1 "
        "#HoustonClinic",
        "boat owner",
        "Houston, TX",
    ),
    ("SOS emergency: we are trapped and need rescue, urgent #TampaStorm", "retired nurse", "worldwide"),
    ("SOS emergency: we are trapped and need rescue, urgent", "field medic", "Ward 7, Riverside"),
    ("SOS emergency: we are trapped and need rescue, urgent", "Driver | Salem, OR", "🌍"),
    ("SOS emergency: we are trapped and need rescue, urgent", "night shift", "global"),
    ("help flood earthquake fire", "", "29.7604,-95.3698"),
    ("Bridge collapsed and homes destroyed near Izmir", "", "Turkey"),
    ("Roads closed, shelter open, volunteers report at 9 in Costa Rica ???", "city desk", "online"),
    ("Snow expected tonight, nothing unusual known", "weather fan", ""),
    ("Damage update: old mill destroyed, report due @desk", "Reporter in Lisbon", "x"),
    ("Please help, my café in Springfield, IL is on fire!!! #Fire", "owner", "Springfield"),
    ("Rescue crews say warehouse burning, storage ruins, damage everywhere #été #Manila", "", ""),
    ("", "", ""),
    ("#NepalEarthquake #rescue teams deployed, hotline open", "NGO", "earth"),
]

PLACES = [
    ("houston", "Houston", 29.7604, -95.3698),
    ("tampa", "Tampa", 27.9506, -82.4572),
    ("izmir", "Izmir", 38.4237, 27.1428),
    ("costa rica", "Costa Rica", 9.7489, -83.7534),
    ("nepal", "Nepal", 28.3949, 84.1240),
    ("manila", "Manila", 14.5995, 120.9842),
    ("lisbon", "Lisbon", 38.7223, -9.1393),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gazetteer(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{place}', '{display}', {lat}D, {lon}D)" for place, display, lat, lon in PLACES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS places({', '.join(GAZETTEER.names)})")


def phrase_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gazetteer that grows with the data: the first two words of every conversation turn."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    phrase = F.array_join(F.slice(words, 1, 2), " ")
    turns = table(spark, sf_dir, "conversations").select(phrase.alias("place")).where("place <> ''").distinct()
    return turns.select(
        "place", F.concat(F.lit("<"), "place", F.lit(">")).alias("display"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")
    )


def reports_of(events: DataFrame) -> DataFrame:
    """Every event as a report. The template array is a constant: no join."""
    names = ("content", "user_bio", "user_location")
    templates = F.array(*[
        F.struct(*[F.lit(value).alias(name) for name, value in zip(names, row)]) for row in TEMPLATES
    ])
    chosen = events.withColumn("_t", F.get(templates, (F.col("event_id") % len(TEMPLATES)).cast("int")))
    event_ts = F.col("ts").cast("timestamp")
    return chosen.select(
        event_ts.alias("event_ts"),
        iso_date(event_ts).alias("date"),
        report_id(F.col("event_id").cast("string")).alias("tweet_id"),
        "_t.content",
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
        "_t.user_bio",
        "_t.user_location",
        F.floor("value").cast("long").alias("like_count"),
        F.col("user_id").alias("retweet_count"),
        F.col("event_type").alias("query_used"),
        (F.col("event_id") % 4).cast("int").alias("source_rank"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports_of(spread(table(spark, sf_dir, "events"), "event_id"))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_repeated(reports(spark, sf_dir), gazetteer(spark))


_stored: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched reports as a stored table, which searches and statistics read; written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = new_path(spark, "stored")
        write_enriched(enriched(spark, sf_dir), path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def text_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, conversation turns and page addresses as reports: texts of their own, profiles and bios on some.

    Every other turn has its first word as a hashtag; every fourth has its text as the bio, behind its role.
    """
    documents = spread(table(spark, sf_dir, "documents"), "doc_id").select(
        _key("d", "doc_id"),
        F.col("text").alias("content"),
        F.lit("").alias("user_bio"),
        F.when(F.col("doc_id") % 3 == 0, "")
        .when(F.col("doc_id") % 3 == 1, "Worldwide")
        .otherwise(F.concat("source", F.lit(" harbour")))
        .alias("user_location"),
    )
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    tag = F.concat(F.lit(" #"), F.regexp_extract("text", "^([A-Z][a-z]+)", 1))
    turns = turns.select(
        _key("c", "conv_id", "turn"),
        F.when(F.col("turn") % 4 == 2, F.col("role"))
        .otherwise(F.concat("text", F.when(F.col("turn") % 2 == 1, tag).otherwise("")))
        .alias("content"),
        F.when(F.col("turn") % 4 == 2, F.concat("role", F.lit(" "), "text")).otherwise("").alias("user_bio"),
        F.lit("").alias("user_location"),
    )
    pages = spread(table(spark, sf_dir, "pages"), "page_id").select(
        _key("p", "page_id"), F.col("url").alias("content"), F.lit("").alias("user_bio"),
        F.regexp_extract("url", "^https?://([^/:]*)", 1).alias("user_location"),
    )
    return documents.unionByName(turns).unionByName(pages).withColumnRenamed("text_key", "tweet_id")


def word_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gazetteer of the texts' own words: the long first words of conversation turns."""
    word = F.lower(F.regexp_extract("text", "^([A-Z][a-z]{6,})", 1)).alias("place")
    words = table(spark, sf_dir, "conversations").select(word).where("place != ''").distinct()
    size = F.length("place").cast("double")
    return words.select("place", F.initcap("place").alias("display"), size.alias("lat"), (-size).alias("lon"))


def wide_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short gazetteer among thousands of names that no report holds: long words of the documents behind "zz"."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{10,})"), F.lit(1))
    names = table(spark, sf_dir, "documents").select(F.explode(words).alias("word")).distinct()
    others = names.select(F.concat(F.lit("zz"), "word").alias("place"), "word", F.lit(0.0), F.lit(0.0))
    return gazetteer(spark).unionAll(others)


#: Events beyond which there are more landed files, not longer ones.
ROWS_PER_FILE = 250_000


def landed_reports(spark: SparkSession, sf_dir: str, files: int = 6) -> str:
    """The reports in several files, as a feed would land them: ``files``, or more where these would be long.

    Events are dealt to the files before they are made reports: what moves is short, and moves once.
    """
    path = new_path(spark, "landed")
    events = table(spark, sf_dir, "events")
    files = max(files, -(-events.count() // ROWS_PER_FILE))
    reports_of(events.repartition(files, "event_id")).write.parquet(path)
    return path


def doc_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a report; copies of a text share an id."""
    documents = spread(table(spark, sf_dir, "documents"), "doc_id")
    return documents.select(
        report_id("lang", "text").alias("tweet_id"),
        F.col("text").alias("content"),
        F.col("source").alias("username"),
        F.lit("").alias("user_bio"),
        F.col("lang").alias("user_location"),
        F.col("n_chars").alias("like_count"),
        F.col("source").alias("query_used"),
        F.substr("source", F.lit(4)).cast("int").alias("source_rank"),
        F.col("doc_id").alias("ordinal"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of the given tables and of the reports under one key."""
    parts = [
        spread(table(spark, sf_dir, "documents"), "doc_id").select(_key("d", "doc_id"), "text"),
        spread(table(spark, sf_dir, "pages"), "page_id").select(_key("p", "page_id"), F.col("html").alias("text")),
        spread(table(spark, sf_dir, "conversations"), "conv_id", "turn").select(_key("c", "conv_id", "turn"), "text"),
        table(spark, sf_dir, "benchmark").select(_key("b", "item_id"), "text"),
        reports(spark, sf_dir).select(F.concat(F.lit("r-"), "tweet_id").alias("text_key"), F.col("content").alias("text")),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _key(prefix: str, *columns: str) -> Column:
    return F.concat_ws("-", F.lit(prefix), *[F.col(name).cast("string") for name in columns]).alias("text_key")


# -- feed files, landed by Spark from the given tables -------------------------------------------------

FEED_START = "2024-01-01 00:00:00"


def feed_time(minutes: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(F.lit(FEED_START).cast("timestamp")) + minutes.cast("long") * 60_000_000)


def rfc_date(timestamp: Column) -> Column:
    """An RFC 822 date as feeds write it."""
    return F.concat(F.date_format(timestamp, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def xml_text(column: str | Column) -> Column:
    """Without the control characters XML does not allow."""
    return F.regexp_replace(column, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")


def land_xml(items: DataFrame, name: str, namespaces: str, *partitions: str, document: Column | None = None) -> str:
    """A folder of feed items, one per line; absent values are absent elements.

    With ``document``, the items of each of its values are one feed document, in a file of its own.
    """
    elements = [
        F.when(
            F.col(f"`{tag}`").isNotNull(),
            F.concat(F.lit(f"<{tag}>"), _escaped(F.col(f"`{tag}`")), F.lit(f"</{tag}>")),
        )
        for tag in items.columns
        if tag not in partitions
    ]
    path = new_path(items.sparkSession, name)
    body = F.concat_ws("", *elements)
    if document is None:
        item = F.concat(F.lit(f"<item {namespaces}>"), body, F.lit("</item>"))
        items.select(item.alias("value"), *partitions).write.partitionBy(*partitions).text(path)
        return path
    item = F.concat(F.lit("<item>"), body, F.lit("</item>"))
    listed = items.groupBy(*partitions, document.alias("_document")).agg(F.concat_ws("\n", F.collect_list(item)).alias("_items"))
    feed = F.concat(F.lit(f"<rss {namespaces}>\n<channel>\n"), "_items", F.lit("\n</channel>\n</rss>"))
    writer = listed.select(feed.alias("value"), *partitions).write.option("maxRecordsPerFile", 1)
    writer.partitionBy(*partitions).text(path)
    return path


def _escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return F.regexp_replace(text, r"\r?\n|\r", "&#10;")


def landed_posts_feed(spark: SparkSession, sf_dir: str, items_per_document: int | None = None) -> str:
    """Pages as feed items: the query is the host's first letters, the mirror a function of the page."""
    pages = table(spark, sf_dir, "pages")
    items = pages.select(
        F.col("url").alias("title"),
        xml_text("html").alias("description"),
        rfc_date(feed_time(F.col("page_id"))).alias("pubDate"),
        F.concat(F.lit("https://feeds.example/"), F.col("page_id").cast("string")).alias("link"),
        F.concat(F.lit("@@desk_"), F.col("page_id").cast("string")).alias("dc:creator"),
        _feed_query().alias("query_used"),
        _feed_mirror().alias("mirror_rank"),
    )
    number = F.regexp_extract("link", "([0-9]+)$", 1).cast("long")
    document = None if items_per_document is None else F.floor(number / items_per_document)
    namespace = 'xmlns:dc="http://purl.org/dc/elements/1.1/"'
    return land_xml(items, "posts", namespace, "query_used", "mirror_rank", document=document)


def _feed_query() -> Column:
    """The top-level domain of the page."""
    return F.concat(F.lit("site "), F.regexp_extract("url", r"^https?://[^/:]*\.([a-z]+)", 1))


def _feed_mirror() -> Column:
    return F.when(F.col("url").startswith("https"), 1).otherwise(2)


def landed_alert_feed(spark: SparkSession, sf_dir: str) -> str:
    """Documents as alerts; those in English carry no longitude."""
    documents = table(spark, sf_dir, "documents")
    items = documents.select(
        F.concat(F.lit("Alert "), F.col("source")).alias("title"),
        xml_text("text").alias("description"),
        rfc_date(feed_time(F.col("doc_id"))).alias("pubDate"),
        F.concat(F.lit("https://alerts.example/"), F.col("doc_id").cast("string")).alias("link"),
        F.concat(F.lit("1"), F.substr("source", F.lit(4)), F.lit(".5")).alias("geo:lat"),
        F.when(F.col("lang") != "en", F.concat(F.lit("-2"), F.substr("source", F.lit(4)), F.lit(".25"))).alias("geo:long"),
    )
    return land_xml(items, "alerts", 'xmlns:geo="http://www.w3.org/2003/01/geo/wgs84_pos#"')


def landed_situation_reports(spark: SparkSession, sf_dir: str) -> str:
    """Documents as situation reports, one API answer per line; one type per language, no source for two of them."""
    kind = (
        F.when(F.col("lang") == "en", "Situation Report")
        .when(F.col("lang") == "fr", "News and Press Release")
        .when(F.col("lang") == "de", "Map")
    )
    fields = F.struct(
        F.concat(F.lit("Report  "), F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("body"),
        F.struct(F.date_format(feed_time(F.col("doc_id")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("created")).alias("date"),
        F.when(kind.isNotNull(), F.array(F.struct(kind.alias("name")))).alias("type"),
        F.when(F.col("lang") == "es", F.array()).otherwise(F.array(F.struct(F.upper("lang").alias("name")))).alias("country"),
        F.when(F.col("lang") != "fr", F.array(F.struct(F.concat(F.lit("Office of "), F.col("source"), F.lit(" and the coordination unit")).alias("name")))).alias("source"),
    )
    path = new_path(spark, "situation")
    answers = table(spark, sf_dir, "documents").select(F.array(F.struct(fields.alias("fields"))).alias("data"))
    answers.write.json(path)
    return path


def landed_social_posts(spark: SparkSession, sf_dir: str) -> str:
    """Events as posts; the language follows the event type, some counts and users are absent."""
    source = reports(spark, sf_dir)
    posts = source.select(
        F.col("date"),
        F.col("tweet_id").alias("id"),
        F.when(F.col("source_rank") != 3, F.col("content")).alias("rawContent"),
        F.lower("content").alias("content"),
        F.when(
            F.col("source_rank") != 2,
            F.struct("username", F.nullif(F.col("user_bio"), F.lit("")).alias("description"), F.col("user_location").alias("location")),
        ).alias("user"),
        F.when(F.col("like_count") > 2, F.col("like_count")).alias("likeCount"),
        F.col("retweet_count").alias("retweetCount"),
        F.when(F.col("query_used") == "error", "fr").otherwise("en").alias("lang"),
        F.col("query_used").alias("query"),
    )
    path = new_path(spark, "social")
    posts.write.json(path)
    return path
