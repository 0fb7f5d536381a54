"""Bringing feeds together: union, caps, failover, first-seen dedup, relevance, fallbacks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siren import lexicons as L
from siren.functions.scoring import any_word
from siren.functions.text import _col, text_or_empty
from siren.operators.lookup import SALTS, computed_once, lookup_join, row_hash, written

MIN_ROWS = 5


def union_sources(*feeds: DataFrame) -> DataFrame:
    """All feeds under one another, duplicates kept, numbered in feed order by ``source_rank``."""
    ranked = [feed.withColumn("source_rank", F.lit(rank)) for rank, feed in enumerate(feeds)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def first_queries(df: DataFrame, n: int, queries: Sequence[str]) -> DataFrame:
    """Rows found by the first ``n`` of the ordered search queries."""
    return df.where(F.col("query_used").isin(list(queries[:n])))


#: Above this rank Spark does not limit groups before the shuffle.
GROUP_LIMIT = 1000


def cap_per_query(df: DataFrame, n: int | None, by: str = "query_used", order: Sequence[Column] | None = None) -> DataFrame:
    """The first ``n`` rows of each query, newest first; all rows for ``n=None``.

    Up to 1,000 rows Spark limits each group before the shuffle (``WindowGroupLimit``), so a hot query sends at most
    ``n`` rows per task. Beyond, a query's rows are first limited in ``SALTS`` parts, so that no task sorts them all.
    """
    if n is None:
        return df
    order = order or [F.col("event_ts").desc_nulls_last(), F.col("tweet_id")]
    capped = df
    if n > GROUP_LIMIT:
        capped = capped.withColumn("_part", F.pmod(row_hash(df), F.lit(SALTS)).cast("int"))
        part_rank = F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order))
        capped = capped.withColumn("_rank", part_rank).where(F.col("_rank") <= n).drop("_rank", "_part")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return capped.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def source_failover(df: DataFrame, by: str = "query_used", rank: str = "mirror_rank", spread_by: str = "tweet_id") -> DataFrame:
    """Per query, the rows of the first mirror that returned any."""
    first = written(df.groupBy(by).agg(F.min(rank).alias("_first")), "failover")
    return lookup_join(df, first, by, spread_by, how="inner").where(F.col(rank) == F.col("_first")).drop("_first")


def first_seen_order(df: DataFrame) -> list[Column]:
    """Feed order, then time, then content: a total order that does not depend on file order."""
    names = [name for name in ("source_rank", "event_ts", "ordinal") if name in df.columns]
    return [F.col(name).asc_nulls_last() for name in names] + [F.md5(text_or_empty("content"))]


def dedup_first_seen(df: DataFrame, key: str = "tweet_id", order: Sequence[Column] | None = None) -> DataFrame:
    """The first row of each id; rows without an id are dropped.

    Each task keeps one row per id before the shuffle, so many copies of one id do not meet in one task.
    """
    order = order or first_seen_order(df)
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.where(F.col(key) != "").withColumn("_first", first).where("_first = 1").drop("_first")


def _searched(df: DataFrame) -> DataFrame:
    """Text and bio in lower case, joined without a space, made once: a filter on them stays above, in generated code."""
    return computed_once(df, {"_searched": F.lower(F.concat(text_or_empty("content"), text_or_empty("user_bio")))})


def relevance_filter(df: DataFrame, words: Sequence[str] = L.RELEVANCE_WORDS) -> DataFrame:
    """Rows whose text or bio holds any of the words."""
    return _searched(df).where(any_word(F.col("_searched"), words)).drop("_searched")


def at_least(df: DataFrame, n: int) -> Column:
    """Whether a table has ``n`` rows, as a scalar subquery: lazy, and no task reads past its first ``n``."""
    return df.limit(n).agg(F.count(F.lit(1))).scalar() >= n


def relevance_fallback(df: DataFrame, words: Sequence[str] = L.RELEVANCE_WORDS, min_rows: int = MIN_ROWS) -> DataFrame:
    """Relevant rows; all rows when fewer than ``min_rows`` are relevant."""
    enough = at_least(relevance_filter(df, words).select(F.lit(1)), min_rows)
    return _searched(df).where(any_word(F.col("_searched"), words) | ~enough).drop("_searched")


def source_fallback(df: DataFrame, substitute: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """The collected rows; the substitute set when there are fewer than ``min_rows``."""
    enough = at_least(df.select(F.lit(1)), min_rows)
    return df.where(enough).unionByName(substitute.where(~enough), allowMissingColumns=True)


def collect_reports(
    feeds: Sequence[DataFrame],
    substitute: DataFrame | None = None,
    words: Sequence[str] = L.RELEVANCE_WORDS,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """What a round of collecting gives: the feeds in order, each report once, the relevant ones.

    With ``substitute``, fewer than ``min_rows`` collected rows are replaced by it before the dedup. Where fewer than
    ``min_rows`` reports are relevant, all stay.
    """
    collected = union_sources(*feeds)
    if substitute is not None:
        collected = source_fallback(collected, substitute, min_rows)
    return relevance_fallback(dedup_first_seen(collected), words, min_rows)


def distinct_ordered(df: DataFrame, value: str, ordinal: str | Column, ignore: Sequence[str] = ("", "unknown")) -> DataFrame:
    """Distinct values with the position they first appear at, in that order."""
    kept = df.where(F.col(value).isNotNull() & ~F.col(value).isin(list(ignore)))
    return kept.groupBy(value).agg(F.min(_col(ordinal)).alias("first_position")).orderBy("first_position", value)
