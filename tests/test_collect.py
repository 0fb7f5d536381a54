from pyspark.sql import functions as F

from siren.operators import collect as C
from siren.plans import relations as R
from siren.sources.synthetic import synthetic_reports


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_dedup_keeps_the_first_and_drops_empty_ids(spark):
    rows = [("a", 1, "late"), ("a", 0, "first"), ("", 0, "none"), (None, 0, "none"), ("b", 2, "only")]
    df = spark.createDataFrame(rows, "tweet_id string, source_rank int, content string")
    once = C.dedup_first_seen(df)
    assert sorted((r.tweet_id, r.content) for r in once.collect()) == [("a", "first"), ("b", "only")]
    assert sorted(C.dedup_first_seen(once).collect()) == sorted(once.collect())


def test_dedup_limits_a_hot_id_before_the_shuffle(spark):
    df = spark.range(10000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("tweet_id"),
        F.col("id").alias("source_rank"), F.lit("x").alias("content"),
    )
    deduped = C.dedup_first_seen(df)
    assert deduped.count() == 6667
    assert plan_of(deduped).count("WindowGroupLimit") >= 2


def test_cap_per_query(spark):
    df = spark.range(100).select(
        (F.col("id") % 2).cast("string").alias("query_used"), F.col("id").cast("string").alias("tweet_id"),
        F.timestamp_seconds("id").alias("event_ts"),
    )
    kept = C.cap_per_query(df, 3)
    assert sorted(int(r.tweet_id) for r in kept.collect()) == [94, 95, 96, 97, 98, 99]
    assert C.cap_per_query(df, None) is df
    assert "WindowGroupLimit" in plan_of(kept)


def test_failover(spark):
    rows = [("q1", 2, "a"), ("q1", 3, "b"), ("q2", 0, "c"), ("q2", 0, "d"), ("q2", 1, "e")]
    df = spark.createDataFrame(rows, "query_used string, mirror_rank int, tweet_id string")
    assert sorted(r.tweet_id for r in C.source_failover(df).collect()) == ["a", "c", "d"]


def test_relevance_looks_across_text_and_bio(spark):
    rows = [("a", "FLOOD", ""), ("b", "stor", "m watcher"), ("c", "sunny", "baker"), ("d", "casualties", None)]
    df = spark.createDataFrame(rows, "tweet_id string, content string, user_bio string")
    assert [r.tweet_id for r in C.relevance_filter(df).orderBy("tweet_id").collect()] == ["a", "b", "d"]
    assert C.relevance_fallback(df).count() == 4
    assert C.relevance_fallback(df, min_rows=3).count() == 3


def test_source_fallback(spark):
    some = spark.createDataFrame([(str(i),) for i in range(5)], "tweet_id string")
    substitute = spark.createDataFrame([("s",)], "tweet_id string")
    assert C.source_fallback(some, substitute).count() == 5
    assert [r.tweet_id for r in C.source_fallback(some.limit(4), substitute).collect()] == ["s"]


def test_distinct_ordered(spark):
    rows = [(3, "Lima"), (1, "Oslo"), (2, "unknown"), (0, ""), (5, "Oslo"), (4, None)]
    df = spark.createDataFrame(rows, "n int, location string")
    assert [r.location for r in C.distinct_ordered(df, "location", "n").collect()] == ["Oslo", "Lima"]


def test_union_numbers_the_feeds(spark):
    a = spark.createDataFrame([("q1", "x")], "query_used string, tweet_id string")
    b = spark.createDataFrame([("y",)], "tweet_id string")
    assert sorted((r.tweet_id, r.source_rank) for r in C.union_sources(a, b, a).collect()) == [("x", 0), ("x", 2), ("y", 1)]
    assert C.first_queries(a, 1, ["q1", "q2"]).count() == 1


def test_synthetic_reports_repeat(spark):
    base = F.lit("2024-06-01 00:00:00").cast("timestamp")
    make = lambda parts: synthetic_reports(spark.range(0, 500, 1, parts), "id", base)
    first, again = (sorted(make(n).collect()) for n in (1, 7))
    assert first == again and len({r.tweet_id for r in first}) == 500
    assert all(5 <= r.like_count <= 5000 and 2 <= r.retweet_count <= 2000 for r in first)
    for r in first:
        minutes = (1717200000 - r.event_ts.timestamp()) / 60
        position = int(r.tweet_id.rsplit("_", 1)[1])
        assert 3 * position <= minutes <= 15 * position


def test_filters_on_raw_columns_reach_the_scan(spark):
    enriched = R.enrich(R.reports_of(R.table(spark, "/root/testdata/sf0.001", "events")), R.gazetteer(spark))
    plan = plan_of(enriched.where("retweet_count = 7"))
    assert "EqualTo(user_id,7)" in plan


def test_relevance_stays_above_an_exchange(spark):
    df = spark.range(10).selectExpr("cast(id AS string) AS content", "'' AS user_bio").repartition(4)
    plan = C.relevance_filter(df, ["1"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Filter") < plan.index("Exchange") and "exists(" not in plan


def test_large_caps_are_limited_in_parts(spark):
    df = spark.range(9000).selectExpr("cast(id AS string) AS tweet_id", "timestamp_seconds(id) AS event_ts", "'q' AS query_used")
    capped = C.cap_per_query(df, 1500)
    assert capped.count() == 1500 and capped.agg(F.min("event_ts").cast("long")).first()[0] == 7500
    assert "_part" in capped._jdf.queryExecution().executedPlan().toString()


def test_collect_reports_replaces_next_to_nothing(spark):
    schema = "tweet_id string, content string, user_bio string"
    few = spark.createDataFrame([("a", "flood", "")], schema)
    substitute = spark.createDataFrame([(f"s{k}", "fire rescue", "") for k in range(6)], schema)
    assert C.collect_reports([few, few]).count() == 1
    assert {r.tweet_id for r in C.collect_reports([few], substitute).collect()} == {f"s{k}" for k in range(6)}
