"""Counters and distributions over enriched reports: one pass each, aggregated before any shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from siren import lexicons as L
from siren.functions.scoring import is_critical
from siren.operators.search import top_high_urgency

#: Accuracy of the sketches that selection goes by: a rank is met to within this share of the values.
SKETCH = 10_000

DISTRIBUTIONS = ("category", "location_source", "priority")


def _high() -> Column:
    return F.col("urgency_score") > L.HIGH_URGENCY


def _unknown() -> Column:
    return F.col("location") == "unknown"


def _geocoded() -> Column:
    return F.col("lat").isNotNull() & F.col("lon").isNotNull()


def summary_stats(df: DataFrame) -> DataFrame:
    score = F.col("urgency_score")
    return df.agg(
        F.count(F.lit(1)).alias("total_tweets"),
        F.count_if(_high()).alias("high_urgency"),
        F.count_if(score.between(L.MEDIUM_URGENCY, L.HIGH_URGENCY)).alias("medium_urgency"),
        F.count_if(score < L.MEDIUM_URGENCY).alias("low_urgency"),
        F.count_if(_unknown()).alias("unknown_locations"),
        F.count_if(_geocoded()).alias("geocoded_tweets"),
        # Scores have two decimals: their sum is exact in decimal, whatever order the partitions arrive in.
        F.round(F.avg(score.cast("decimal(5,2)")), 2).cast("double").alias("avg_urgency"),
    )


def headline_counters(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_high()).alias("high_urgency"),
        F.count_if(_unknown()).alias("unknown_location"),
        F.count_if(is_critical()).alias("critical_review"),
    )


def map_counters(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~_unknown()).alias("known_location"),
        F.count_if(_geocoded()).alias("geocoded"),
        F.count_if(_unknown()).alias("unknown_location"),
    )


def batch_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_high()).alias("high_urgency_count"),
        F.count_if(_unknown()).alias("unknown_location_count"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column)


def distributions(df: DataFrame, columns: Sequence[str] = DISTRIBUTIONS) -> DataFrame:
    """Rows per value of several columns, in one scan: (dimension, value, n)."""
    pairs = [F.struct(F.lit(name).alias("dimension"), F.col(name).alias("value")) for name in columns]
    return (
        df.select(F.inline(F.array(*pairs)))
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("dimension", F.col("n").desc(), "value")
    )


def order_statistics(values: DataFrame, column: str, ranks: Sequence[int], n: int) -> dict[int, float]:
    """The values at the given ranks (from 0) of the ``n`` values of a column, exactly, by selection.

    Sketches of the values that are left give two of them close around each rank; counting what lies below these two leaves
    a few thousandths of the values between them, so the rounds are few whatever the values are, and nothing is sorted or
    collected. NaN is the largest value.
    """
    value = F.col(column)
    found: dict[int, float] = {}
    # Rank: the open interval it lies in, the values below that, and those within.
    left: dict[int, tuple[float | None, float | None, int, int]] = {rank: (None, None, 0, n) for rank in ranks}
    while left:

        def within(rank: int) -> Column:
            low, high, _, _ = left[rank]
            above = F.lit(True) if low is None else value > F.lit(low)
            return above if high is None else above & (value < F.lit(high))

        def share(rank: int, by: float) -> float:
            _, _, below, m = left[rank]
            return min(1.0, max(0.0, (rank - below + 0.5 + by) / m))

        around = {rank: left[rank][3] / SKETCH + 1 for rank in left}
        sketched = values.agg(*[
            F.percentile_approx(F.when(within(rank), value), [share(rank, -around[rank]), share(rank, around[rank])], SKETCH)
            for rank in left
        ]).first()
        bounds = dict(zip(left, sketched, strict=True))
        counted = values.agg(*[
            F.struct(*[F.count_if(within(rank) & test) for bound in bounds[rank] for test in (value < F.lit(bound), value <= F.lit(bound))])
            for rank in left
        ]).first()
        for rank, counts in zip(list(left), counted, strict=True):
            low, high, below, m = left.pop(rank)
            (a, b), (before_a, upto_a, before_b, upto_b), at = bounds[rank], counts, rank - below
            if before_a <= at < upto_a:
                found[rank] = a
            elif before_b <= at < upto_b:
                found[rank] = b
            elif at < before_a:
                left[rank] = (low, a, below, before_a)
            elif at < before_b:
                left[rank] = (a, b, below + upto_a, before_b - upto_a)
            else:
                left[rank] = (b, high, below + upto_b, m - upto_b)
    return found


def describe_urgency(df: DataFrame, column: str = "urgency_score") -> DataFrame:
    """count, mean, std, min, interpolated quartiles, max of any column's values, however many different ones it has.

    Moments are merged by the tasks; quartiles lie between two order statistics, which are selected exactly.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("score"))
    moments = values.agg(
        F.count(F.lit(1)).alias("count"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"),
        F.min("score").alias("min"), F.max("score").alias("max"),
    ).first()
    places = [(moments["count"] - 1) * q for q in (0.25, 0.5, 0.75)] if moments["count"] else []
    ranks = sorted({rank for place in places for rank in (int(place), min(int(place) + 1, moments["count"] - 1))})
    at = order_statistics(values, "score", ranks, moments["count"])
    quartiles = []
    for place in places:
        low, high = at[int(place)], at[min(int(place) + 1, moments["count"] - 1)]
        quartiles.append(low if low == high else (int(place) + 1 - place) * low + (place - int(place)) * high)
    quartiles = quartiles or [None] * 3
    row = (moments["count"], moments["mean"], moments["std"], moments["min"], *quartiles, moments["max"])
    schema = "count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double"
    return df.sparkSession.createDataFrame([row], schema)


def urgency_histogram(df: DataFrame, bins: int = 20, column: str = "urgency_score") -> DataFrame:
    """Reports per score bin over 0-100, empty bins too; the top score belongs to the last bin."""
    bucket = F.least(F.width_bucket(column, F.lit(0.0), F.lit(100.0), F.lit(bins)), F.lit(bins))
    width = 100.0 / bins
    counted = df.where(F.col(column).isNotNull()).groupBy(bucket.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(1, bins + 1, numPartitions=1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin", ((F.col("bin") - 1) * width).alias("bin_start"), (F.col("bin") * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    ).orderBy("bin")


def observed(df: DataFrame, name: str = "run_summary") -> tuple[DataFrame, Observation]:
    """The same rows, counting processed, urgent and unlocated reports while they are written."""
    counters = Observation(name)
    return df.observe(
        counters,
        F.count(F.lit(1)).alias("processed"),
        F.count_if(_high()).alias("high_urgency"),
        F.count_if(_unknown()).alias("unknown_location"),
    ), counters


def run_summary(df: DataFrame) -> DataFrame:
    """The report of a run as rows (section, name, value): counters, two distributions, five most urgent."""
    counters = headline_counters(df).select(F.inline(F.array(*[
        F.struct(F.lit("counter").alias("section"), F.lit(name).alias("name"), F.col(name).cast("string").alias("value"))
        for name in ("total", "high_urgency", "unknown_location")
    ])))
    shares = distributions(df, ("category", "priority")).select(
        F.col("dimension").alias("section"), F.col("value").alias("name"), F.col("n").cast("string").alias("value")
    )
    top = top_high_urgency(df, 5).select(
        F.lit("top").alias("section"),
        F.col("tweet_id").alias("name"),
        F.concat_ws(
            " | ", F.format_string("[%.1f]", "urgency_score"), F.substring("content", 1, 80), "location",
            "location_source", "priority",
        ).alias("value"),
    )
    return counters.unionByName(shares).unionByName(top)


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return value_counts(df, label)
