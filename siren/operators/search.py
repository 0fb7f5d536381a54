"""Filters, sorting and top lists over enriched reports.

Every filter is a plain predicate, so on a stored table the comparisons reach the Parquet scan, and a sort with a
limit becomes a distributed top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siren import lexicons as L
from siren.functions.scoring import is_critical, priority_rank
from siren.functions.text import clip_lower, coerce_numeric


def filter_min_urgency(df: DataFrame, threshold: float) -> DataFrame:
    return df.where(F.col("urgency_score") >= threshold) if threshold > 0 else df


def filter_urgency_range(df: DataFrame, low: float, high: float) -> DataFrame:
    """Scores within the range; what is not a number counts as 0."""
    score = F.col("urgency_score")
    if df.schema["urgency_score"].dataType.typeName() == "string":
        score = coerce_numeric(score)
    within = score.between(low, high)
    return df.where(within | score.isNull() if low <= 0 <= high else within)


def filter_category(df: DataFrame, category: str) -> DataFrame:
    return df.where(F.lower("category") == category.lower()) if category else df


def filter_in(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Membership; no values means no filter."""
    return df.where(F.col(column).isin(list(values))) if values else df


def filter_category_in(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    return filter_in(df, "category", categories)


def filter_source_in(df: DataFrame, sources: Sequence[str]) -> DataFrame:
    return filter_in(df, "location_source", sources)


def filter_matches(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Case-insensitive regular expression search; NULL does not match, no pattern means no filter."""
    return df.where(F.col(column).rlike(f"(?iu){pattern}")) if pattern else df


def filter_content_contains(df: DataFrame, pattern: str) -> DataFrame:
    return filter_matches(df, "content", pattern)


def filter_location_contains(df: DataFrame, pattern: str) -> DataFrame:
    return filter_matches(df, "location", pattern)


def filter_has_coords(df: DataFrame) -> DataFrame:
    return df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def filter_critical_review(df: DataFrame) -> DataFrame:
    return df.where(is_critical())


def known_location() -> Column:
    return ~F.col("location").isin("unknown", "")


def filter_known_location(df: DataFrame) -> DataFrame:
    return df.where(known_location())


def filter_not_geocoded(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct known locations without coordinates; the first ``limit`` in name order."""
    names = df.where(known_location() & F.col("lat").isNull()).select("location").distinct()
    return names.orderBy("location").limit(limit) if limit is not None else names


def sort_by(df: DataFrame, column: str = "urgency_score", ascending: bool = False, tie_break: str = "tweet_id") -> DataFrame:
    """Sort by urgency_score, date, priority (as text) or priority_rank (by meaning); ties by id."""
    key = priority_rank("priority") if column == "priority_rank" else F.col(column)
    order = [key.asc() if ascending else key.desc()]
    if tie_break in df.columns:
        order.append(F.col(tie_break).asc())
    return df.orderBy(*order)


def top_urgent(df: DataFrame, n: int = 100) -> DataFrame:
    return sort_by(df).limit(n)


def top_high_urgency(df: DataFrame, n: int = 5) -> DataFrame:
    return top_urgent(df.where(F.col("urgency_score") > L.HIGH_URGENCY), n)


def search_reports(
    df: DataFrame,
    content: str = "",
    location: str = "",
    min_urgency: float = 0,
    urgency_range: tuple[float, float] | None = None,
    category: str = "",
    categories: Sequence[str] = (),
    sources: Sequence[str] = (),
    has_coords: bool = False,
    sort: str = "urgency_score",
    ascending: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """All filters together, sorted; ``limit`` keeps the first rows. Cheap comparisons come before the pattern searches."""
    found = filter_min_urgency(df, min_urgency)
    if urgency_range is not None:
        found = filter_urgency_range(found, *urgency_range)
    found = filter_category(found, category)
    found = filter_category_in(found, categories)
    found = filter_source_in(found, sources)
    if has_coords:
        found = filter_has_coords(found)
    found = filter_content_contains(found, content)
    found = filter_location_contains(found, location)
    found = sort_by(found, sort, ascending)
    return found if limit is None else found.limit(limit)


def map_points(df: DataFrame) -> DataFrame:
    """Reports with coordinates, with marker size and hover texts."""
    score = F.coalesce(F.col("urgency_score"), F.lit(0.0))
    return filter_has_coords(df).select(
        "tweet_id", "lat", "lon", "location", "category", "priority",
        score.alias("urgency_score"),
        clip_lower(score, 5).alias("size"),
        F.substring("content", 1, 100).alias("text_preview"),
    )
