"""Synthetic reports, for demonstrations and as the substitute when the feeds return next to nothing.

Every value is a hash of the row's key and the seed, not a random draw: a task that runs again makes the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siren.functions.text import iso_date

Template = tuple[str, str, str, str]

# Ranges of the drawn values (fixed values).
STEP_MINUTES = (3, 15)
LIKES = (5, 5000)
RETWEETS = (2, 2000)
USERS = (100, 999)

_EVENTS = ("river over the quay", "gas leak", "power cut", "sand storm", "burst dam")
_TOWNS = ("Aveiro", "Pécs", "Hilo", "Gävle")
_CALLS = (
    ("we need help to move out, please hurry", "resident"),
    ("the east road is closed", "road desk"),
    ("two cellars damaged, nobody hurt", "builder"),
    ("shelter open in the old gym", "volunteer"),
)

#: Content, bio, profile location and query of each made-up report: every event in a town, with every call.
TEMPLATES: list[Template] = [
    (f"{event.capitalize()} in {town}, {call} #{town}", f"{who} of {town}" if k % 3 else "", town if k % 2 else "", event)
    for k, event in enumerate(_EVENTS)
    for town in (_TOWNS[k % len(_TOWNS)],)
    for call, who in _CALLS
]


def draw(key: Column, seed: int, purpose: str, low: int, high: int) -> Column:
    """A whole number in low..high from a hash of key, seed and purpose."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)), F.lit(purpose)))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % (high - low + 1) + low).cast("long")


def synthetic_reports(
    keys: DataFrame, key: str, base: Column, seed: int = 42, templates: Sequence[Template] = tuple(TEMPLATES)
) -> DataFrame:
    """One report per row of ``keys``, whose ``key`` is a whole number 0, 1, 2 ... that numbers the reports.

    Each takes a template; its time lies 3-15 minutes per position before ``base``.
    """
    position = F.col(key).cast("long")
    choices = F.array(*[
        F.struct(*[F.lit(value).alias(name) for name, value in zip(("content", "user_bio", "user_location", "query_used"), row)])
        for row in templates
    ])
    chosen = keys.select(
        position.alias("_position"),
        F.get(choices, draw(position, seed, "template", 0, len(templates) - 1).cast("int")).alias("_template"),
    )
    position = F.col("_position")
    minutes = position * draw(position, seed, "step", *STEP_MINUTES)
    event_ts = F.timestamp_micros(F.unix_micros(base.cast("timestamp")) - minutes * 60_000_000)
    made = chosen.select(
        event_ts.alias("event_ts"),
        F.concat(
            F.lit("synth_"), F.unix_seconds(base.cast("timestamp")).cast("string"), F.lit("_"), position.cast("string")
        ).alias("tweet_id"),
        F.col("_template.content").alias("content"),
        F.concat(F.lit("user_"), draw(position, seed, "user", *USERS).cast("string")).alias("username"),
        F.col("_template.user_bio").alias("user_bio"),
        F.col("_template.user_location").alias("user_location"),
        draw(position, seed, "likes", *LIKES).alias("like_count"),
        draw(position, seed, "retweets", *RETWEETS).alias("retweet_count"),
        F.col("_template.query_used").alias("query_used"),
    )
    return made.withColumn("date", iso_date("event_ts"))
