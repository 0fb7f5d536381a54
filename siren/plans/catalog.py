"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siren import lexicons as L
from siren.functions import places, scoring
from siren.functions import text as T
from siren.operators import batch, collect, gazetteer, learn, remembered, search, stats
from siren.operators import enrich as E
from siren.operators.lookup import spread, written
from siren.operators.skipping import TrigramIndex
from siren.plans import relations as R
from siren.schemas import ensure_columns, validate_reports
from siren.session import new_path
from siren.sources import feeds, tables
from siren.sources.synthetic import synthetic_reports
from siren.streaming import live

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__.rstrip("_")] = function
    return function


# -- sources and sinks ----------------------------------------------------------------------------------

RAW_VIEW = (
    "tweet_id", "date", "content", "username", "user_bio", "user_location", "like_count", "retweet_count", "query_used",
)


@query
def read_rss_reports(spark, sf_dir):
    reports = feeds.read_rss_reports(spark, R.landed_posts_feed(spark, sf_dir), item_lines=True)
    return reports.select(*RAW_VIEW, "mirror_rank")


@query
def read_rss_documents(spark, sf_dir):
    """The same feeds as whole documents, a task to each."""
    reports = feeds.read_rss_reports(spark, R.landed_posts_feed(spark, sf_dir, items_per_document=50))
    return reports.select(*RAW_VIEW, "mirror_rank")


@query
def cap_per_query(spark, sf_dir):
    return collect.cap_per_query(R.reports(spark, sf_dir), 20).select("tweet_id", "query_used", "date")


@query
def cap_per_query_many(spark, sf_dir):
    """A cap above the rank up to which Spark limits groups by itself."""
    return collect.cap_per_query(R.reports(spark, sf_dir), 1500).select("tweet_id", "query_used", "date")


@query
def source_failover(spark, sf_dir):
    reports = feeds.read_rss_reports(spark, R.landed_posts_feed(spark, sf_dir), item_lines=True)
    return collect.source_failover(reports).select("tweet_id", "query_used", "mirror_rank")


@query
def read_alert_feed(spark, sf_dir):
    return feeds.read_alert_feed(spark, R.landed_alert_feed(spark, sf_dir), item_lines=True).select(*RAW_VIEW)


@query
def read_situation_reports(spark, sf_dir):
    path = R.landed_situation_reports(spark, sf_dir)
    return feeds.read_situation_reports(spark, path).select(*RAW_VIEW)


@query
def read_social_posts(spark, sf_dir):
    as_of = F.lit("2024-01-20 12:00:00").cast("timestamp")
    path = R.landed_social_posts(spark, sf_dir)
    return feeds.read_social_posts(spark, path, as_of=as_of).select(*RAW_VIEW)


@query
def read_raw_csv(spark, sf_dir):
    path = new_path(spark, "raw-csv")
    absent = F.when(F.col("user_bio") != "", F.col("user_bio"))
    tables.write_csv(R.reports(spark, sf_dir).withColumn("user_bio", absent).select(*RAW_VIEW_ORDERED), path)
    return tables.read_raw_csv(spark, path)


RAW_VIEW_ORDERED = tuple(tables.RAW_COLUMNS)


@query
def read_enriched_csv(spark, sf_dir):
    path = new_path(spark, "enriched-csv")
    tables.write_enriched(R.enriched(spark, sf_dir), path, format="csv")
    return tables.read_enriched_csv(spark, path)


@query
def read_csv_line_breaks(spark, sf_dir):
    """Documents with their line breaks, written by as many tasks as read them, read in pieces that begin and end anywhere."""
    path = new_path(spark, "quoted-csv")
    columns = R.table(spark, sf_dir, "documents").select(F.col("text").alias("content"), F.col("doc_id").alias("like_count"))
    tables.write_csv(tables.raw_rows(columns), path)
    return tables.read_raw_csv(spark, path).select("content", "like_count")


@query
def read_legacy_csv(spark, sf_dir):
    path = new_path(spark, "legacy-csv")
    legacy = R.doc_reports(spark, sf_dir).select(
        F.lit("2024-01-01").alias("date"), F.col("content").alias("text"), "username",
        F.col("query_used").alias("bio"), F.col("user_location").alias("location"),
    )
    tables.write_csv(legacy, path)
    return tables.read_legacy_csv(spark, path)


@query
def ensure_columns_(spark, sf_dir):
    documents = R.table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.col("text"), F.lit("")).alias("content"))
    return ensure_columns(documents)


@query
def synthetic_reports_(spark, sf_dir):
    base = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return synthetic_reports(R.table(spark, sf_dir, "events"), "event_id", base).drop("event_ts")


@query
def source_fallback(spark, sf_dir):
    """Both ways: the feed that has no rows is replaced, the full one is kept."""
    reports = R.reports(spark, sf_dir).select("tweet_id", "content")
    base = F.lit("2024-06-01 00:00:00").cast("timestamp")
    substitute = synthetic_reports(R.table(spark, sf_dir, "events"), "event_id", base).select("tweet_id", "content")
    nothing = reports.where(F.col("content") == "no such text")
    kept = collect.source_fallback(reports, substitute).withColumn("feed", F.lit("full"))
    replaced = collect.source_fallback(nothing, substitute).withColumn("feed", F.lit("empty"))
    return kept.unionByName(replaced)


@query
def source_freshness(spark, sf_dir):
    """Several landed files, seen at three times after the last of them landed."""
    files = spark.read.parquet(R.landed_reports(spark, sf_dir))
    newest = files.agg(F.max("_metadata.file_modification_time").alias("t")).first()["t"]
    seen = []
    for label, later in (("soon", "30 MINUTES"), ("today", "5 HOURS"), ("next day", "30 HOURS")):
        as_of = F.lit(newest) + F.expr(f"INTERVAL {later}")
        ages = tables.source_freshness(files, as_of, minutes=60)
        seen.append(ages.groupBy(F.lit(label).alias("seen"), "age", "fresh").agg(F.sum("n_rows").alias("n_rows")))
    return seen[0].unionAll(seen[1]).unionAll(seen[2])


@query
def write_raw(spark, sf_dir):
    path = new_path(spark, "raw")
    tables.write_raw(R.doc_reports(spark, sf_dir), path)
    return spark.read.parquet(path)


@query
def write_enriched(spark, sf_dir):
    path = new_path(spark, "enriched")
    tables.write_enriched(R.enriched(spark, sf_dir), path)
    stored = spark.read.parquet(path)
    return stored.select(
        "tweet_id", *tables.ENRICHED_COLUMNS, "clean_text", "keyword_score", "hashtags_str", "like_count", "model_mode"
    )


@query
def write_enriched_again(spark, sf_dir):
    """A stored table written from a stored table."""
    path = new_path(spark, "enriched")
    tables.write_enriched(R.stored(spark, sf_dir), path, staged=False)
    return spark.read.parquet(path).select("tweet_id", "urgency_score", "location", "lat")


@query
def write_enriched_by_day(spark, sf_dir):
    path = new_path(spark, "by-day")
    tables.write_enriched_by_day(R.enriched(spark, sf_dir), path)
    stored = spark.read.parquet(path)
    return stored.select("tweet_id", F.col("event_date").cast("string").alias("event_date"), "urgency_score")


@query
def to_json_records(spark, sf_dir):
    enriched = R.stored(spark, sf_dir)
    return tables.to_json_records(enriched.select("tweet_id", "content", "urgency_score", "location", "lat"))


# -- union, dedup, relevance ------------------------------------------------------------------------------


@query
def union_sources(spark, sf_dir):
    reports = R.reports(spark, sf_dir).select("tweet_id", "content", "query_used")
    feed = collect.first_queries(reports, 2, ["view", "click", "error"])
    posts = R.doc_reports(spark, sf_dir).select("tweet_id", "content", "query_used")
    return collect.union_sources(feed, posts, reports)


@query
def dedup_first_seen(spark, sf_dir):
    kept = collect.dedup_first_seen(R.doc_reports(spark, sf_dir))
    return kept.select("tweet_id", "username", "source_rank", "ordinal", "like_count")


@query
def relevance_filter(spark, sf_dir):
    docs = R.doc_reports(spark, sf_dir).select("tweet_id", "content", "user_bio")
    reports = R.reports(spark, sf_dir).select("tweet_id", "content", "user_bio")
    return collect.relevance_filter(docs.unionByName(reports)).select("tweet_id", F.md5("content").alias("content_md5"))


@query
def relevance_fallback(spark, sf_dir):
    """Both ways: no document holds the word, so all stay; many reports are relevant, so only those stay."""
    docs = R.doc_reports(spark, sf_dir).select("tweet_id", "content", "user_bio")
    reports = R.reports(spark, sf_dir).select("tweet_id", "content", "user_bio")
    all_docs = collect.relevance_fallback(docs, ["tsunami warning center"])
    some_reports = collect.relevance_fallback(reports)
    return all_docs.unionByName(some_reports).select("tweet_id", F.md5("content").alias("content_md5"))


@query
def collect_reports(spark, sf_dir):
    """Two feeds that share reports, and a third of documents; enough is collected and relevant."""
    reports = R.reports(spark, sf_dir).select("tweet_id", "event_ts", "content", "user_bio")
    documents = R.doc_reports(spark, sf_dir).select("tweet_id", "content", "user_bio")
    base = F.lit("2024-06-01 00:00:00").cast("timestamp")
    substitute = synthetic_reports(R.table(spark, sf_dir, "events"), "event_id", base).select("tweet_id", "content")
    first = reports.where(F.col("tweet_id") < "8")
    collected = collect.collect_reports([first, documents, reports], substitute)
    return collected.select("tweet_id", "source_rank", F.md5("content").alias("content_md5"))


@query
def collect_nothing(spark, sf_dir):
    """Empty feeds: the substitute set goes through dedup and relevance."""
    nothing = R.reports(spark, sf_dir).select("tweet_id", "event_ts", "content", "user_bio").where("content = 'no such text'")
    base = F.lit("2024-06-01 00:00:00").cast("timestamp")
    made = synthetic_reports(R.table(spark, sf_dir, "events"), "event_id", base)
    substitute = made.select("tweet_id", "event_ts", "content", "user_bio")
    return collect.collect_reports([nothing], substitute).select("tweet_id", F.md5("content").alias("content_md5"))


@query
def distinct_ordered(spark, sf_dir):
    enriched = R.stored(spark, sf_dir)
    return collect.distinct_ordered(enriched, "location", F.unix_micros("event_ts"))


# -- text and scalar functions ---------------------------------------------------------------------------


def over_texts(**columns: Callable[[str], Column]) -> Query:
    """A query that keeps the key of every text and adds columns made from it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return R.texts(spark, sf_dir).select("text_key", *[make("text").alias(name) for name, make in columns.items()])

    return run


QUERIES["clean_text"] = over_texts(clean_text=T.clean_text)
QUERIES["extract_hashtags"] = over_texts(
    n_hashtags=lambda text: F.size(T.extract_hashtags(text)).cast("long"),
    hashtags=lambda text: F.array_join(T.extract_hashtags(text), "|"),
)
QUERIES["hashtags_str"] = over_texts(hashtags_str=lambda text: T.hashtags_str(T.extract_hashtags(text)))
QUERIES["keyword_score"] = over_texts(keyword_score=scoring.keyword_score)
QUERIES["coords_in_text"] = over_texts(coords=places.coords_in_text)
QUERIES["loose_hashtag_pattern"] = over_texts(place=places.loose_hashtag_place)
QUERIES["city_state"] = over_texts(city_state=places.city_state)
QUERIES["report_id"] = over_texts(report_id=lambda text: T.report_id("text_key", F.substring(text, 1, 30)))


@query
def strip_tags(spark, sf_dir):
    pages = spread(R.table(spark, sf_dir, "pages"), "page_id")
    return pages.select(
        "page_id", T.strip_tags("html").alias("plain_text"), T.strip_tags("html", 500).alias("content")
    )


@query
def parse_pub_date(spark, sf_dir):
    """Every event's time in three spellings, one of them not a date."""
    stamp = F.date_trunc("second", F.col("ts").cast("timestamp"))
    spelled = (
        F.when(F.col("event_type") == "error", F.lit("yesterday evening"))
        .when(F.col("event_type") == "view", F.concat(F.date_format(stamp, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .otherwise(F.concat(F.date_format(stamp, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0230")))
    )
    events = R.table(spark, sf_dir, "events").select("event_id", spelled.alias("pub_date"))
    return events.select("event_id", T.iso_date(T.parse_pub_date("pub_date")).alias("date"))


@query
def preprocess(spark, sf_dir):
    return E.preprocess(R.reports(spark, sf_dir)).select("tweet_id", "clean_text", "keyword_score", "hashtags_str")


@query
def author_norm(spark, sf_dir):
    events = R.table(spark, sf_dir, "events")
    handle = F.concat(F.lit("@@"), F.col("event_type"), F.lit("@"), F.col("user_id").cast("string"))
    name = F.concat(
        F.lit("Office of "), F.col("event_type"), F.lit(" coordination and aid no "), F.col("user_id").cast("string")
    )
    office = F.when(F.col("event_type") != "error", name)
    return events.select(
        "event_id",
        T.author_handle(F.when(F.col("event_type") != "view", handle)).alias("handle"),
        T.author_name(office, "ReliefWeb").alias("office"),
    )


@query
def display_columns(spark, sf_dir):
    return T.display_columns(R.stored(spark, sf_dir))


@query
def coerce_numeric(spark, sf_dir):
    """Numbers and junk from the event properties."""
    raw = F.when(F.col("event_type") == "view", F.col("props")).otherwise(F.get_json_object("props", "$.k"))
    events = R.table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return events.select(
        "event_id", T.coerce_numeric("raw").alias("number"), T.coerce_numeric("raw", 0).alias("number_or_zero")
    )


@query
def clip_lower(spark, sf_dir):
    return R.stored(spark, sf_dir).select("tweet_id", T.clip_lower("urgency_score", 5).alias("size"))


# -- classification and scoring --------------------------------------------------------------------------


def _clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.texts(spark, sf_dir).withColumn("clean_text", T.clean_text("text")).drop("text")


@query
def urgency_keyword_score(spark, sf_dir):
    return _clean_texts(spark, sf_dir).select(
        "text_key", scoring.urgency_keyword_score("clean_text").alias("keyword_part")
    )


@query
def rule_classify(spark, sf_dir):
    return E.rule_classify(_clean_texts(spark, sf_dir)).select("text_key", "category", "urgency_score")


@query
def rule_probs(spark, sf_dir):
    probs = F.col("all_probs")
    return E.rule_classify(_clean_texts(spark, sf_dir)).select(
        "text_key",
        probs["Information"].alias("p_information"),
        probs["Help Request"].alias("p_help_request"),
        probs["Damage Report"].alias("p_damage_report"),
    )


@query
def urgency_blend(spark, sf_dir):
    """The blend over given probabilities, 0.00 to 1.00 from the like counts, and the keyword part of the text."""
    reports = R.reports(spark, sf_dir)
    probability = (F.col("like_count") % 101) / F.lit(100.0)
    keyword_part = scoring.urgency_keyword_score(T.clean_text("content"))
    return reports.select("tweet_id", scoring.urgency_blend(probability, keyword_part).alias("urgency"))


@query
def classify(spark, sf_dir):
    classified = E.classify(E.preprocess(R.reports(spark, sf_dir)))
    return classified.select("tweet_id", "category", "urgency_score", "model_mode")


@query
def score_fn_classify(spark, sf_dir):
    """The scorer hook, with a scorer of fixed class shares by text length."""

    def scorer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.str.len().map(lambda n: [0.2, 0.5, 0.3] if n > 50 else [0.4, 0.2, 0.4])

    classified = E.classify(E.preprocess(R.reports(spark, sf_dir)), score_fn=scorer)
    return classified.select("tweet_id", "category", "urgency_score", "model_mode")


@query
def classify_texts(spark, sf_dir):
    """Documents, turns and addresses by the rules."""
    classified = E.classify(E.preprocess(R.text_reports(spark, sf_dir)))
    return classified.select("tweet_id", "category", "urgency_score", "keyword_score", "model_mode")


@query
def enrich_batch(spark, sf_dir):
    """Every result of a batch, beside the counts of the batch."""
    rows, counts = batch.enrich_batch(R.reports(spark, sf_dir), R.gazetteer(spark))
    return rows.select("tweet_id", "category", "urgency_score", "location").withColumns({
        name: counts.select(name).scalar() for name in counts.columns
    })


@query
def run_batch(spark, sf_dir):
    """Collect, enrich, store and summarise: the summary, and the counters seen on the way."""
    reports = R.reports(spark, sf_dir)
    counters, summary = batch.run_batch([reports, reports], R.gazetteer(spark), new_path(spark, "run"))
    rows = [("observed", name, str(value)) for name, value in counters.items()]
    return summary.unionByName(spark.createDataFrame(rows, "section string, name string, value string"))


@query
def enrich(spark, sf_dir):
    return R.enriched(spark, sf_dir).select(
        "tweet_id", "date", "category", "urgency_score", "location", "location_source", "location_confidence",
        "priority", "lat", "lon",
    )


# -- locations -------------------------------------------------------------------------------------------


@query
def gazetteer_match(spark, sf_dir):
    """Short gazetteer, part of the expression."""
    matched = gazetteer.gazetteer_match(
        R.reports(spark, sf_dir), R.gazetteer(spark), {"content": "text_place", "user_bio": "bio_place"}
    )
    return matched.select("tweet_id", "text_place", "bio_place")


@query
def gazetteer_match_join(spark, sf_dir):
    """A gazetteer that grows with the data, over whole documents whose ids repeat or are absent, by join."""
    documents = spread(R.table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "text")
    loose = documents.withColumn("tweet_id", F.when(F.col("doc_id") % 5 > 1, F.col("doc_id") % 3))
    matched = gazetteer.gazetteer_match(loose, R.phrase_gazetteer(spark, sf_dir), {"text": "place"}, max_inline=0)
    return matched.select("doc_id", "tweet_id", "place")


@query
def gazetteer_match_shuffled(spark, sf_dir):
    """The same with nothing broadcast."""
    documents = spread(R.table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "text")
    matched = gazetteer.gazetteer_match(
        documents, R.phrase_gazetteer(spark, sf_dir), {"text": "place"}, max_inline=0, max_broadcast_rows=0
    )
    return matched.select("doc_id", "place")


@query
def hashtag_place_texts(spark, sf_dir):
    tags = T.hashtags_str(T.extract_hashtags("content"))
    return R.text_reports(spark, sf_dir).select("tweet_id", places.hashtag_place(tags).alias("place"))


@query
def extract_location_texts(spark, sf_dir):
    """Places in documents, turns and addresses, by a gazetteer of their own words."""
    located = E.extract_location(E.preprocess(R.text_reports(spark, sf_dir)), R.word_gazetteer(spark, sf_dir))
    return located.select("tweet_id", "location", "location_source", "location_confidence")


@query
def entity_fn_location(spark, sf_dir):
    """The entity hook, with a finder of the first word of nine letters or more."""

    def finder(batches):
        for texts in batches:
            yield texts.str.extract(r"\b([A-Za-z]{9,})\b", expand=False).fillna("")

    located = E.extract_location(E.preprocess(R.text_reports(spark, sf_dir)), entity_fn=finder)
    return located.select("tweet_id", "location", "location_source")


@query
def enrich_texts(spark, sf_dir):
    enriched = E.enrich(R.text_reports(spark, sf_dir), R.word_gazetteer(spark, sf_dir))
    return enriched.select("tweet_id", "category", "urgency_score", "location", "location_source", "priority", "lat", "lon")


@query
def hashtag_place(spark, sf_dir):
    reports = R.reports(spark, sf_dir)
    return reports.select(
        "tweet_id", places.hashtag_place(T.hashtags_str(T.extract_hashtags("content"))).alias("place")
    )


@query
def normalize_location(spark, sf_dir):
    """Profiles of the reports, and all texts for their lengths and alphabets."""
    profiles = R.reports(spark, sf_dir).select(
        F.concat(F.lit("r-"), "tweet_id").alias("text_key"), F.col("user_location").alias("raw")
    )
    padded = F.concat(F.lit("  "), F.col("text"), F.lit(" "))
    texts = R.texts(spark, sf_dir).select("text_key", padded.alias("raw"))
    return profiles.unionByName(texts).select("text_key", places.normalize_location("raw").alias("location"))


@query
def extract_location(spark, sf_dir):
    located = E.extract_location(E.preprocess(R.reports(spark, sf_dir)), R.gazetteer(spark))
    return located.select("tweet_id", "location", "location_source", "location_confidence")


@query
def extract_location_patterns(spark, sf_dir):
    """The cascade without a gazetteer."""
    located = E.extract_location(E.preprocess(R.reports(spark, sf_dir)))
    return located.select("tweet_id", "location", "location_source", "location_confidence")


@query
def location_confidence(spark, sf_dir):
    enriched = R.stored(spark, sf_dir)
    return enriched.select("tweet_id", places.location_confidence("location_source").alias("location_confidence"))


@query
def hashtag_first_location(spark, sf_dir):
    reports = R.reports(spark, sf_dir).withColumn("both", F.concat_ws(" ", "content", "user_bio"))
    matched = gazetteer.gazetteer_match(reports, R.gazetteer(spark), {"both": "place"})
    first = places.hashtag_first_location("content", T.extract_hashtags("content"), F.col("place"))
    return matched.select("tweet_id", first.alias("location"))


# -- priority and geocoding ------------------------------------------------------------------------------


@query
def priority_label(spark, sf_dir):
    """Every event's value against every source it could have."""
    events = R.table(spark, sf_dir, "events")
    sources = F.array(*[F.lit(name) for name in (*L.LOCATION_CONFIDENCE, "elsewhere")])
    cases = events.select("event_id", F.col("value").alias("urgency"), F.explode(sources).alias("source"))
    return cases.select(
        "event_id", "source", scoring.priority_label("urgency", "source").alias("priority"),
        scoring.priority_rank(scoring.priority_label("urgency", "source")).cast("long").alias("priority_rank"),
    )


@query
def urgency_band(spark, sf_dir):
    enriched = R.stored(spark, sf_dir)
    return enriched.select(
        "tweet_id", scoring.urgency_band("urgency_score").alias("band"), scoring.is_critical().alias("critical")
    )


@query
def parse_coordinates(spark, sf_dir):
    """Coordinate literals from the event values, some with a word behind them."""
    pair = F.concat(F.lit("-"), F.col("user_id").cast("string"), F.lit(".25, "), F.col("event_id").cast("string"))
    literal = F.when(F.col("event_type") == "view", F.concat(pair, F.lit(" N"))).otherwise(pair)
    events = R.table(spark, sf_dir, "events").select("event_id", places.parse_coordinates(literal).alias("pair"))
    return events.select("event_id", "pair.lat", "pair.lon")


@query
def geocode_lookup(spark, sf_dir):
    return gazetteer.geocode_lookup(R.stored(spark, sf_dir).select("location"), R.gazetteer(spark))


@query
def attach_coordinates(spark, sf_dir):
    return R.enriched(spark, sf_dir).select("tweet_id", "location", "lat", "lon")


@query
def attach_coordinates_shuffled(spark, sf_dir):
    """The same result with a gazetteer over the broadcast bound."""
    located = E.extract_location(E.preprocess(R.reports(spark, sf_dir)), R.gazetteer(spark))
    placed = gazetteer.attach_coordinates(located, R.gazetteer(spark), max_broadcast_rows=0)
    return placed.select("tweet_id", "location", "lat", "lon")


@query
def geocode_report(spark, sf_dir):
    return gazetteer.geocode_report(R.stored(spark, sf_dir).select("location"), R.gazetteer(spark))


def _named_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with a location: the first word of each that begins with a capital."""
    name = F.regexp_extract("text", "^([A-Z][a-z]{4,})", 1)
    return R.table(spark, sf_dir, "conversations").select("conv_id", "text", name.alias("location")).where("location != ''")


@query
def geocode_remembered(spark, sf_dir):
    """Two runs over growing locations, the second with an empty gazetteer: what it knows, it knows from the first."""
    turns, places = _named_turns(spark, sf_dir), R.word_gazetteer(spark, sf_dir)
    memory = remembered.GeocodeMemory(spark, new_path(spark, "geocoded"))
    memory.lookup(turns.where("conv_id % 2 = 0"), remembered.gazetteer_finder(places), now=1.0)
    found = memory.lookup(turns, remembered.gazetteer_finder(places.where("false")), now=2.0)
    return found.join(memory.known().select(F.col("name").alias("location"), "looked_up"), "location")


@query
def first_seen_across_runs(spark, sf_dir):
    """Texts of conversation turns in three runs: each text counts in the first run that has it."""
    index = remembered.SeenIndex(spark, new_path(spark, "seen"))
    turns = R.table(spark, sf_dir, "conversations").select(
        F.md5("text").alias("tweet_id"), F.col("text").alias("content"), "conv_id"
    )
    runs = [
        index.first_seen(turns.where(F.col("conv_id") % 3 == run)).select("tweet_id", F.lit(run).alias("run"))
        for run in range(3)
    ]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


def _collections(spark: SparkSession, sf_dir: str, minutes: float) -> DataFrame:
    """What two collections ten minutes apart give the second time, of the two parities of events."""
    reports, path = R.reports(spark, sf_dir).select("tweet_id", "like_count"), new_path(spark, "collected")
    parity = F.col("like_count") % 2
    remembered.collect_or_reuse(spark, path, lambda: reports.where(parity == 0), minutes, now=0.0)
    rows, reused = remembered.collect_or_reuse(spark, path, lambda: reports.where(parity == 1), minutes, now=600.0)
    return rows.withColumn("reused", F.lit(reused))


@query
def collect_reused(spark, sf_dir):
    """A collection ten minutes old is fresh for a quarter of an hour."""
    return _collections(spark, sf_dir, 15)


@query
def collect_anew(spark, sf_dir):
    """It is not for five minutes."""
    return _collections(spark, sf_dir, 5)


# -- filters, sorts, top lists ---------------------------------------------------------------------------

FOUND = ("tweet_id", "category", "urgency_score", "location", "location_source", "priority")


def over_enriched(operator: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(R.stored(spark, sf_dir)).select(*(columns or FOUND))

    return run


QUERIES["filter_min_urgency"] = over_enriched(lambda df: search.filter_min_urgency(df, 40))
QUERIES["filter_urgency_range"] = over_enriched(lambda df: search.filter_urgency_range(df, 5, 48))
QUERIES["filter_category"] = over_enriched(lambda df: search.filter_category(df, "DAMAGE report"))
QUERIES["filter_category_in"] = over_enriched(
    lambda df: search.filter_category_in(df, ["Help Request", "Damage Report"])
)
QUERIES["filter_source_in"] = over_enriched(lambda df: search.filter_source_in(df, ["bio", "hashtag"]))
QUERIES["filter_content_contains"] = over_enriched(lambda df: search.filter_content_contains(df, "rescue|CAFÉ"))
QUERIES["filter_location_contains"] = over_enriched(lambda df: search.filter_location_contains(df, "ho.st|RIVER"))
QUERIES["filter_has_coords"] = over_enriched(search.filter_has_coords)
QUERIES["filter_critical_review"] = over_enriched(search.filter_critical_review)
QUERIES["filter_known_location"] = over_enriched(search.filter_known_location)
QUERIES["filter_not_geocoded"] = over_enriched(search.filter_not_geocoded, "location")
QUERIES["sort_by"] = over_enriched(lambda df: search.sort_by(df, "priority_rank", ascending=True))
QUERIES["top_urgent"] = over_enriched(lambda df: search.top_urgent(df, 100))
QUERIES["top_high_urgency"] = over_enriched(lambda df: search.top_high_urgency(df, 5))
@query
def search_by_trigrams(spark, sf_dir):
    """Documents that match a pattern, from those files only whose trigrams allow for it."""
    table, index = new_path(spark, "texts"), new_path(spark, "trigrams")
    documents = R.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    documents.repartitionByRange(16, "doc_id").write.parquet(table)
    trigrams = TrigramIndex(spark, table, index)
    trigrams.refresh()
    return trigrams.search(r"licen[cs]e[sd]? UNDER|@mail[0-9]+\.example").select("doc_id", F.length("content").alias("n_chars"))


QUERIES["search_reports"] = over_enriched(
    lambda df: search.search_reports(
        df, content="rescue|help", location="o", min_urgency=20, categories=["Help Request"],
        sources=["tweet", "hashtag", "profile_location"], limit=500,
    )
)
QUERIES["map_points"] = over_enriched(
    search.map_points, "tweet_id", "lat", "lon", "location", "category", "priority", "urgency_score", "size", "text_preview"
)

# -- aggregations ----------------------------------------------------------------------------------------


def over_all_enriched(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(R.stored(spark, sf_dir))


QUERIES["summary_stats"] = over_all_enriched(stats.summary_stats)
QUERIES["headline_counters"] = over_all_enriched(stats.headline_counters)
QUERIES["value_counts"] = over_all_enriched(stats.distributions)
QUERIES["urgency_histogram"] = over_all_enriched(stats.urgency_histogram)
QUERIES["map_counters"] = over_all_enriched(stats.map_counters)
QUERIES["batch_counts"] = over_all_enriched(stats.batch_counts)
QUERIES["run_summary"] = over_all_enriched(stats.run_summary)


@query
def describe_urgency(spark, sf_dir):
    described = stats.describe_urgency(R.stored(spark, sf_dir))
    return described.select("count", *[F.round(name, 6).alias(name) for name in described.columns if name != "count"])


@query
def label_distribution(spark, sf_dir):
    return stats.label_distribution(R.table(spark, sf_dir, "labels"), "quality")


# -- learning --------------------------------------------------------------------------------------------


def _labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = R.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return R.table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")


@query
def labelled_set(spark, sf_dir):
    documents, labels = R.table(spark, sf_dir, "documents"), R.table(spark, sf_dir, "labels")
    parts = [
        documents.join(labels.where(condition), "doc_id", "left_semi").select("text")
        for condition in ("quality = 0", "toxic = 1", "quality = 1 AND toxic = 0")
    ]
    return learn.labelled_set(*parts).select("label", F.md5("text").alias("text_md5"))


@query
def weak_labels(spark, sf_dir):
    labelled = learn.weak_labels(R.texts(spark, sf_dir), "text")
    return labelled.select("text_key", "label")


@query
def stratified_split(spark, sf_dir):
    labels = R.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return learn.stratified_split(labels, "doc_id")


@query
def tokenize(spark, sf_dir):
    tokens = learn.tokenize("text")
    return R.texts(spark, sf_dir).select(
        "text_key",
        F.size(tokens).cast("long").alias("n_tokens"),
        F.array_join(tokens, " ").alias("model_input"),
    )


@query
def train_classifier(spark, sf_dir):
    """A classifier of the documents' languages, on a fifth of each language that it has not seen."""
    languages = F.array(*[F.lit(lang) for lang in ("de", "en", "es", "fr")])
    label = (F.array_position(languages, F.col("lang")) - 1).alias("label")
    documents = spread(R.table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "text", label)
    split = learn.stratified_split(documents, "doc_id")
    model = learn.train_classifier(split.where("split = 'train'"), reg_params=(0.001, 0.1), features=1 << 12, max_iter=10)
    metrics = learn.eval_metrics(model.transform(split.where("split = 'test'")))
    return metrics.select("n", (F.col("f1") > 0.9).alias("good_f1"), (F.col("accuracy") > 0.9).alias("good_accuracy"))


@query
def model_classify(spark, sf_dir):
    """A model taught by the rules gives the rules' categories."""
    reports = R.reports(spark, sf_dir)
    labelled = E.once_each(reports, lambda texts: E.rule_classify(E.preprocess(texts))).select(
        F.col("clean_text").alias("text"), learn.label_id("category").cast("double").alias("label")
    )
    model = learn.fit_repeated(learn.build_pipeline(features=1 << 12, max_iter=50), labelled)
    classified = E.once_each(reports, lambda texts: E.classify(E.preprocess(texts), model=model))
    return classified.select("tweet_id", "category", "model_mode")


@query
def save_load_model(spark, sf_dir):
    """Predictions of a model before saving and after loading, compared row by row."""
    labelled = _labelled_documents(spark, sf_dir)
    model = learn.train_classifier(labelled, reg_params=(0.1,), features=1 << 12, max_iter=5)
    path = new_path(spark, "model")
    learn.save_model(model, path)
    # Predictions are written while their model is at hand.
    before = written(model.transform(labelled).select("doc_id", F.col("prediction").alias("before")), "before")
    after = learn.load_model(path).transform(labelled).select("doc_id", F.col("prediction").alias("after"))
    after = written(after, "after")
    same = (F.col("before") == F.col("after")).alias("same")
    return before.join(after, "doc_id").groupBy(same).agg(F.count(F.lit(1)).alias("n"))


def _length_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels against a rule: texts of 500 characters and more are good."""
    documents = R.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = R.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return labels.join(documents, "doc_id").select("label", (F.col("n_chars") >= 500).cast("int").alias("prediction"))


@query
def eval_metrics(spark, sf_dir):
    metrics = learn.eval_metrics(_length_rule(spark, sf_dir))
    return metrics.select("n", *[F.round(name, 8).alias(name) for name in metrics.columns if name != "n"])


@query
def run_log(spark, sf_dir):
    """Two runs appended to one table."""
    path = new_path(spark, "runs")
    metrics = learn.eval_metrics(_length_rule(spark, sf_dir))
    for run in ("first", "second"):
        params = {
            "model_name": "length rule", "epochs": 3, "batch_size": 16, "learning_rate": 2e-5, "train_size": 0,
            "val_size": 0,
        }
        learn.run_log(spark, params, metrics, path, run)
    return spark.read.parquet(path).select(
        "run_id", F.col("params")["epochs"].alias("epochs"), F.round("eval_accuracy", 8).alias("eval_accuracy"),
        F.round("eval_f1", 8).alias("eval_f1"),
    )


# -- streaming -------------------------------------------------------------------------------------------


def _stream_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports as a stream of several files, a third of them to a batch: two of six."""
    path = R.landed_reports(spark, sf_dir)
    landed = spark.read.parquet(path)
    return live.read_stream(spark, path, landed.schema, max_files=max(2, -(-len(landed.inputFiles()) // 3)))


def _enriched_stream(spark: SparkSession, sf_dir: str, places: DataFrame) -> str:
    """Where a stream has enriched all reports."""
    path = new_path(spark, "live")
    live.stream_enrich(_stream_reports(spark, sf_dir), f"{path}/table", f"{path}/checkpoint", places).awaitTermination()
    return f"{path}/table"


@query
def stream_enrich(spark, sf_dir):
    return spark.read.parquet(_enriched_stream(spark, sf_dir, R.gazetteer(spark))).select(*FOUND, "lat", "lon")


@query
def stream_dedup(spark, sf_dir):
    """One row per user and text: the id of a report is made of both, and repeats through the month."""
    path = new_path(spark, "live")
    stream = _stream_reports(spark, sf_dir).withColumn("tweet_id", T.report_id("username", "content"))
    first = live.stream_dedup(stream.select("tweet_id", "event_ts", "username", "content"), delay="60 days")
    live.start(first.drop("event_ts"), f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/table")


@query
def stream_counters(spark, sf_dir):
    """Hourly counters of all windows, over reports enriched with thousands of names."""
    enriched = _enriched_stream(spark, sf_dir, R.wide_gazetteer(spark, sf_dir))
    path = new_path(spark, "counters")
    stream = live.read_enriched(spark, enriched, max_files=4)
    live.stream_counters(stream, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return live.read_counters(spark, f"{path}/table").withColumns({
        name: F.date_format(name, "yyyy-MM-dd HH:mm:ss") for name in ("window_start", "window_end")
    })


@query
def stream_alerts(spark, sf_dir):
    enriched = _enriched_stream(spark, sf_dir, R.wide_gazetteer(spark, sf_dir))
    path = new_path(spark, "alerts")
    stream = live.read_enriched(spark, enriched, max_files=4)
    live.stream_alerts(stream, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/table").select(*FOUND)


# -- validation ------------------------------------------------------------------------------------------


@query
def validate_reports_(spark, sf_dir):
    docs = R.doc_reports(spark, sf_dir).select(
        F.concat(F.lit("d-"), F.col("ordinal").cast("string")).alias("text_key"), "content",
        F.col("content").alias("user_bio"), "user_location",
    )
    reports = R.reports(spark, sf_dir).select(
        F.concat(F.lit("r-"), "tweet_id").alias("text_key"), "content", "user_bio", "user_location"
    )
    return validate_reports(docs.unionByName(reports)).select("text_key", "valid", "reason")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which reports need action first?"""
    top = search.top_urgent(R.enriched(spark, sf_dir), 20)
    return top.select("date", "content", *FOUND, "location_confidence", "lat", "lon")


QUERIES["top_20_urgent"] = flagship
