import statistics

import pytest
from pyspark.sql import functions as F

from siren.operators import search, stats
from siren.plans import relations as R

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark):
    return R.stored(spark, SF)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_comparisons_reach_the_parquet_scan(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(search.search_reports(stored, min_urgency=70, categories=["Help Request"], content="rescue", limit=100))
    assert "GreaterThanOrEqual(urgency_score,70.0)" in plan
    assert "EqualTo(category,Help Request)" in plan
    assert "TakeOrderedAndProject" in plan


def test_unused_columns_are_not_read(stored):
    schema = plan_of(stats.value_counts(stored, "priority")).split("ReadSchema: ")[1].split("\n")[0]
    assert schema.startswith("struct<priority:string>")


def test_search_is_its_filters_together(stored):
    found = search.search_reports(
        stored, content="HELP|rescue", location="o", min_urgency=20, category="help request",
        sources=["tweet", "profile_location"], has_coords=True, limit=None,
    )
    wanted = [
        r for r in stored.collect()
        if any(w in r.content.lower() for w in ("help", "rescue")) and "o" in r.location.lower() and r.urgency_score >= 20
        and r.category == "Help Request" and r.location_source in ("tweet", "profile_location") and r.lat is not None
    ]
    wanted.sort(key=lambda r: (-r.urgency_score, r.tweet_id))
    assert [r.tweet_id for r in found.collect()] == [r.tweet_id for r in wanted] != []


def test_no_filter_means_all(stored):
    assert search.search_reports(stored, limit=None).count() == stored.count()


@pytest.mark.parametrize("ascending", [True, False])
def test_sort_by_priority(stored, ascending):
    by_text = [r.priority for r in search.sort_by(stored, "priority", ascending).collect()]
    assert by_text == sorted(by_text, reverse=not ascending)
    order = ["HIGHEST", "HIGH", "CRITICAL_REVIEW", "MEDIUM", "LOW"]
    by_rank = [order.index(r.priority) for r in search.sort_by(stored, "priority_rank", ascending).collect()]
    assert by_rank == sorted(by_rank, reverse=not ascending)


def test_range_takes_junk_as_zero(spark):
    df = spark.createDataFrame([("50",), ("junk",), (None,), ("0",)], "urgency_score string")
    assert search.filter_urgency_range(df, 0, 10).count() == 3
    assert search.filter_urgency_range(df, 1, 60).count() == 1


def test_regex_search_ignores_case_in_any_alphabet(spark):
    df = spark.createDataFrame([("CAFÉ",), (None,), ("x",)], "content string")
    assert search.filter_content_contains(df, "café").count() == 1


def test_bands_add_up(stored):
    row = stats.summary_stats(stored).first()
    assert row.high_urgency + row.medium_urgency + row.low_urgency == row.total_tweets == stored.count()
    assert row.avg_urgency == round(statistics.fmean(r.urgency_score for r in stored.collect()), 2)
    histogram = stats.urgency_histogram(stored)
    assert histogram.agg(F.sum("n")).first()[0] == row.total_tweets


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (4.99,), (5.0,), (100.0,), (95.0,), (None,)], "urgency_score double")
    counts = {1: 2, 2: 1, 20: 2}
    assert [(r.bin, r.n) for r in stats.urgency_histogram(df).collect()] == [(k, counts.get(k, 0)) for k in range(1, 21)]


def test_describe(spark):
    scores = [4.0, 5.6, 80.0, 40.0, 40.0, 96.0]
    row = stats.describe_urgency(spark.createDataFrame([(s,) for s in scores], "urgency_score double")).first()
    quartiles = statistics.quantiles(scores, n=4, method="inclusive")
    assert [row["count"], row.min, row.max] == [6, 4.0, 96.0]
    assert [row.mean, row.std, row.p25, row.p50, row.p75] == pytest.approx(
        [statistics.fmean(scores), statistics.stdev(scores), *quartiles]
    )
    one = stats.describe_urgency(spark.createDataFrame([(7.0,)], "urgency_score double")).first()
    assert (one.std, one.p50) == (None, 7.0)


def test_observed_counters(stored):
    df, counters = stats.observed(stored)
    df.write.format("noop").mode("overwrite").save()
    row = stats.headline_counters(stored).first()
    assert counters.get == {"processed": row.total, "high_urgency": row.high_urgency, "unknown_location": row.unknown_location}


def test_run_summary(stored):
    rows = stats.run_summary(stored).collect()
    assert sum(int(r.value) for r in rows if r.section == "category") == stored.count()
    assert sum(r.section == "top" for r in rows) == 5


@pytest.mark.parametrize("rows", [1, 2, 3, 1000])
def test_quartiles_of_any_values(spark, rows):
    """Exact whatever the values are: all different, of any size, or a third of them the same."""
    import numpy as np

    draw = np.random.default_rng(rows)
    kinds = [draw.lognormal(0, 40, rows), draw.normal(0, 1, rows).round(1), np.where(draw.random(rows) < 0.4, 7.0, draw.random(rows) * 14)]
    for values in kinds:
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "urgency_score double")
        row = stats.describe_urgency(df).first()
        assert [row.p25, row.p50, row.p75] == pytest.approx(np.percentile(values, [25, 50, 75]).tolist(), rel=1e-12)
        assert (row["count"], row.min, row.max) == (rows, values.min(), values.max())


def test_selection_narrows_down(spark, monkeypatch):
    """With rough sketches it takes more rounds and finds the same."""
    monkeypatch.setattr(stats, "SKETCH", 20)
    df = spark.range(5000).selectExpr("CAST(pmod(xxhash64(id), 100003) AS DOUBLE) AS v")
    values = sorted(r.v for r in df.collect())
    assert stats.order_statistics(df, "v", [0, 17, 2500, 4999], 5000) == {k: values[k] for k in (0, 17, 2500, 4999)}


def test_statistics_of_nothing(spark):
    row = stats.describe_urgency(spark.createDataFrame([(None,)], "urgency_score double")).first()
    assert (row["count"], row.mean, row.p50, row.max) == (0, None, None, None)
