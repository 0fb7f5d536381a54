"""Text columns: cleaning, tags, hashtags, ids, dates, report projections.

Java's ``\\s`` and ``\\w`` are ASCII only, so the Unicode classes are spelled out. Whitespace is always collapsed
before ``trim``, which removes plain spaces only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Character classes (fixed values).
SPACE_CHARS = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WORD_CHARS = r"\p{L}\p{N}_"

# The same whitespace, character by character.
ALL_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

SPACE = f"[{SPACE_CHARS}]"
NOT_SPACE = f"[^{SPACE_CHARS}]"
WORD = f"[{WORD_CHARS}]"

# Whitespace that is not already one plain space: most texts then need no replacement at all.
LOOSE_SPACE = f"{SPACE}{{2,}}|[{SPACE_CHARS}&&[^ ]]"
LINKS = f"(?:http|www){NOT_SPACE}+"
MENTION = f"@{WORD}+"
HASHTAG = f"#({WORD}+)"
NON_ASCII = r"[^\x00-\x7F]+"
MARKUP = "<[^>]+>"
REPEATED_MARK = r"([!?])\1+"


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(_col(column), F.lit(""))


def squeeze(column: str | Column) -> Column:
    """Collapse whitespace runs to one space and strip."""
    return F.trim(F.regexp_replace(_col(column), LOOSE_SPACE, " "))


def strip_space(column: str | Column) -> Column:
    """Strip whitespace of any alphabet from both ends."""
    return F.btrim(_col(column), F.lit(ALL_SPACE))


def is_ascii(column: str | Column) -> Column:
    return F.octet_length(_col(column)) == F.char_length(_col(column))


def clean_text(column: str | Column) -> Column:
    """Normalised text for classification. The order of the steps is part of the result."""
    text = F.lower(text_or_empty(column))
    linked = F.contains(text, F.lit("@")) | F.contains(text, F.lit("http")) | F.contains(text, F.lit("www"))
    unlinked = F.regexp_replace(F.regexp_replace(text, LINKS, ""), MENTION, "")
    text = squeeze(F.when(linked, unlinked).otherwise(text))
    text = F.replace(text, F.lit("#"), F.lit(""))
    text = F.regexp_replace(text, NON_ASCII, " ")
    text = F.regexp_replace(text, REPEATED_MARK, "$1")
    return F.trim(text)


def strip_tags(column: str | Column, max_chars: int | None = None) -> Column:
    """Markup replaced by spaces, whitespace collapsed; ``max_chars`` cuts the text."""
    text = squeeze(F.regexp_replace(text_or_empty(column), MARKUP, " "))
    return text if max_chars is None else F.substring(text, 1, max_chars)


def extract_hashtags(column: str | Column) -> Column:
    text = text_or_empty(column)
    tags = F.regexp_extract_all(text, F.lit(HASHTAG), F.lit(1))
    return F.when(F.contains(text, F.lit("#")), tags).otherwise(F.array().cast("array<string>"))


def hashtags_str(hashtags: str | Column) -> Column:
    return F.array_join(_col(hashtags), " ")


def report_id(*parts: str | Column) -> Column:
    """First 16 hex digits of the md5 of the parts."""
    return F.substring(F.md5(F.concat(*[text_or_empty(part) for part in parts])), 1, 16)


def parse_pub_date(column: str | Column) -> Column:
    """An RFC 822 date as a timestamp; NULL when it cannot be read.

    The weekday is dropped (Spark's parser does not take it); a zone may be an offset or a name such as GMT.
    """
    text = F.regexp_replace(F.trim(_col(column)), r"^[A-Za-z]{3},\s*", "")
    text = F.regexp_replace(text, r"([+-]\d{2}):(\d{2})$", "$1$2")
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss z")),
    )


def iso_date(timestamp: str | Column) -> Column:
    """ISO 8601 text in UTC, the form of the ``date`` column; empty for NULL."""
    utc = F.to_utc_timestamp(_col(timestamp), F.current_timezone())
    return F.coalesce(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit(""))


def author_handle(column: str | Column, default: str = "unknown") -> Column:
    """A handle without leading at signs."""
    return F.regexp_replace(F.coalesce(_col(column), F.lit(default)), "^@+", "")


def author_name(column: str | Column, default: str) -> Column:
    """An organisation name as a handle: underscores for spaces, 30 characters."""
    return F.substring(F.replace(F.coalesce(_col(column), F.lit(default)), F.lit(" "), F.lit("_")), 1, 30)


def coerce_numeric(column: str | Column, default: float | None = None) -> Column:
    """To double; what is not a number becomes NULL or the default."""
    number = _col(column).try_cast("double")
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def clip_lower(column: str | Column, floor: float) -> Column:
    return F.greatest(_col(column), F.lit(float(floor)))


def display_columns(df: DataFrame) -> DataFrame:
    """Enriched reports as a reader sees them: short texts, minutes, rounded scores, readable labels."""
    return df.select(
        "tweet_id",
        F.substring("content", 1, 80).alias("headline"),
        F.substring("content", 1, 100).alias("text_preview"),
        F.substring("content", 1, 420).alias("card_text"),
        F.replace(F.substring("date", 1, 16), F.lit("T"), F.lit(" ")).alias("date_minutes"),
        F.format_string("%.0f", F.col("urgency_score")).alias("score"),
        F.format_string("%.1f", F.col("urgency_score")).alias("score_1dp"),
        F.when(
            F.col("all_probs").isNotNull(),
            F.format_string("%.1f%%", F.col("all_probs")["Help Request"] * 100),
        ).alias("help_probability"),
        F.when(
            F.col("lat").isNotNull() & F.col("lon").isNotNull(),
            F.format_string("%.4f, %.4f", F.col("lat"), F.col("lon")),
        ).alias("coordinates"),
        F.replace(F.col("priority"), F.lit("_"), F.lit(" ")).alias("priority_label"),
        F.replace(F.col("location_source"), F.lit("_"), F.lit(" ")).alias("source_label"),
    )


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column
