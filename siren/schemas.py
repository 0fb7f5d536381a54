"""Table schemas, column defaults and input validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns and order of the stored raw reports (fixed values).
RAW_COLUMNS = [
    "date", "tweet_id", "content", "username", "user_bio", "user_location", "like_count", "retweet_count",
    "query_used",
]
# Columns and order of the stored enriched reports (fixed values).
ENRICHED_COLUMNS = [
    "date", "content", "category", "urgency_score", "location", "location_source", "location_confidence",
    "priority", "lat", "lon", "username", "user_location", "query_used",
]

# The stored table: what the CSV form has, and what tells reports apart and explains their scores.
STORED_COLUMNS = [
    "tweet_id", "event_ts", *ENRICHED_COLUMNS, "user_bio", "like_count", "retweet_count", "clean_text", "keyword_score",
    "hashtags_str", "all_probs", "model_mode", "source_rank",
]

RAW = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("tweet_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("user_bio", T.StringType()),
    T.StructField("user_location", T.StringType()),
    T.StructField("like_count", T.LongType()),
    T.StructField("retweet_count", T.LongType()),
    T.StructField("query_used", T.StringType()),
])

ENRICHED = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("urgency_score", T.DoubleType()),
    T.StructField("location", T.StringType()),
    T.StructField("location_source", T.StringType()),
    T.StructField("location_confidence", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("username", T.StringType()),
    T.StructField("user_location", T.StringType()),
    T.StructField("query_used", T.StringType()),
])

LEGACY = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("bio", T.StringType()),
    T.StructField("location", T.StringType()),
])

GAZETTEER = T.StructType([
    T.StructField("place", T.StringType()),
    T.StructField("display", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])

LABELLED = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())])

FEED_ITEM = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("pubDate", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("dc:creator", T.StringType()),
])

ALERT_ITEM = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("pubDate", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("geo:lat", T.StringType()),
    T.StructField("geo:long", T.StringType()),
])

_NAMED = T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))

SITUATION_REPORTS = T.StructType([
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("fields", T.StructType([
            T.StructField("title", T.StringType()),
            T.StructField("body", T.StringType()),
            T.StructField("date", T.StructType([T.StructField("created", T.StringType())])),
            T.StructField("type", _NAMED),
            T.StructField("country", _NAMED),
            T.StructField("source", _NAMED),
        ])),
    ]))),
])

SOCIAL_POST = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("rawContent", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("user", T.StructType([
        T.StructField("username", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("location", T.StringType()),
    ])),
    T.StructField("likeCount", T.LongType()),
    T.StructField("retweetCount", T.LongType()),
    T.StructField("lang", T.StringType()),
    T.StructField("query", T.StringType()),
])


def ensure_columns(df: DataFrame, names: tuple[str, ...] = ("content", "user_bio", "user_location")) -> DataFrame:
    """Add absent text columns as empty strings and turn NULL into the empty string."""
    return df.withColumns({
        name: F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("") for name in names
    })


def violation(text: str = "content", bio: str = "user_bio", profile: str = "user_location") -> Column:
    """The first broken input constraint, or NULL for a valid row."""
    return (
        F.when(F.coalesce(F.char_length(text), F.lit(0)) < 1, "text is empty")
        .when(F.char_length(text) > 1000, "text over 1000 characters")
        .when(F.char_length(bio) > 500, "bio over 500 characters")
        .when(F.char_length(profile) > 200, "profile over 200 characters")
    )


def validate_reports(df: DataFrame, **columns: str) -> DataFrame:
    """Add ``valid`` and ``reason``; no row is dropped."""
    return df.withColumn("reason", violation(**columns)).withColumn("valid", F.col("reason").isNull())


def split_valid(df: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the rest with the reason."""
    checked = validate_reports(df, **columns)
    return checked.where("valid").drop("valid", "reason"), checked.where("NOT valid").drop("valid")
