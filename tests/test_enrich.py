from collections.abc import Iterator

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siren import lexicons as L
from siren.functions import scoring
from siren.operators import enrich as E
from siren.plans import relations as R
from siren.schemas import split_valid, validate_reports

# Worked out by hand: keyword score, category, urgency, location, source, priority.
GOLDENS = [
    (48, "Help Request", 85.6, "Houston", "tweet", "HIGHEST"),
    (40, "Help Request", 80.0, "Tampa", "hashtag", "HIGH"),
    (40, "Help Request", 80.0, "Ward 7, Riverside", "profile_location", "HIGH"),
    (40, "Help Request", 80.0, "Salem, OR", "bio", "MEDIUM"),
    (40, "Help Request", 80.0, "unknown", "none", "CRITICAL_REVIEW"),
    (32, "Help Request", 40.0, "29.7604,-95.3698", "profile_location", "LOW"),
    (11, "Damage Report", 9.6, "Izmir", "tweet", "LOW"),
    (9, "Information", 4.0, "Costa Rica", "tweet", "LOW"),
    (8, "Information", 4.0, "unknown", "none", "LOW"),
    (12, "Information", 4.0, "Lisbon", "bio", "LOW"),
    (24, "Help Request", 48.0, "Springfield, IL", "tweet", "MEDIUM"),
    (11, "Damage Report", 9.6, "Manila", "tweet", "LOW"),
    (0, "Information", 4.0, "unknown", "none", "LOW"),
    (16, "Information", 7.2, "Nepal", "hashtag", "LOW"),
]


def templates(spark):
    rows = [(f"t{i:02d}", *row) for i, row in enumerate(R.TEMPLATES)]
    return spark.createDataFrame(rows, "tweet_id string, content string, user_bio string, user_location string")


def test_goldens(spark):
    rows = E.enrich(templates(spark), R.gazetteer(spark)).orderBy("tweet_id").collect()
    found = [(r.keyword_score, r.category, r.urgency_score, r.location, r.location_source, r.priority) for r in rows]
    assert found == [(float(g[0]), *g[1:]) for g in GOLDENS]
    placed = [r.tweet_id for r in rows if r.lat is not None]
    assert placed == ["t00", "t01", "t05", "t06", "t07", "t09", "t11", "t13"]
    assert [r.location_confidence for r in rows] == [L.LOCATION_CONFIDENCE[r.location_source] for r in rows]


def test_feed_style_report(spark):
    text = "Green earthquake (Magnitude 5.9M, Depth:10km) in the southern ocean 18/04/2026 10:47 UTC, [unknown]."
    row = E.enrich(spark.createDataFrame([("a", text)], "tweet_id string, content string")).first()
    assert (row.category, row.urgency_score, row.location, row.priority) == ("Information", 5.6, "unknown", "LOW")


def test_probabilities_of_a_certain_help_request(spark):
    text = "urgent help rescue trapped sos emergency stranded dying please help send help"
    row = E.rule_classify(spark.createDataFrame([(text,)], "clean_text string")).first()
    assert row.all_probs == {"Information": 0.0, "Help Request": 0.95, "Damage Report": 0.1}


@pytest.mark.parametrize("text, score", [("snow is known", 8.0), (None, 0.0), (" ".join(L.URGENT_WORDS), 100.0)])
def test_keyword_score(spark, text, score):
    df = spark.createDataFrame([(text,)], "content string")
    assert df.select(scoring.keyword_score("content").alias("s")).first().s == score


def test_own_word_list(spark):
    from siren.lexicons import lexicon_table, words_of

    table = lexicon_table(spark)
    assert sorted(L.URGENT_WORDS) == words_of(table, "urgent")
    df = spark.createDataFrame([("the dike broke",)], "content string")
    assert df.select(scoring.keyword_score("content", ["dike"], ["broke"]).alias("s")).first().s == 11.0


def test_ties_go_to_the_first_class(spark):
    df = spark.createDataFrame([("x", [0.4, 0.2, 0.4])], "clean_text string, p array<double>")
    row = E.probability_classify(df, F.col("p")).first()
    assert (row.category, row.urgency_score) == ("Information", 16.0)


def test_entity_hook(spark):
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: "Lima" if "lima" in t.lower() else ("web" if "web" in t else None))

    rows = [("a", "help in lima", ""), ("b", "nothing", "from Lima"), ("c", "x", "on the web in Salem, OR")]
    df = spark.createDataFrame(rows, "tweet_id string, content string, user_bio string")
    located = E.extract_location(E.preprocess(df), entity_fn=find).orderBy("tweet_id").collect()
    # A name found in the bio hides the pattern, even if the name is noise.
    assert [(r.location, r.location_source) for r in located] == [("Lima", "tweet"), ("Lima", "bio"), ("unknown", "none")]


def test_default_plan_has_no_python_and_computes_once(spark):
    enriched = E.enrich(R.reports(spark, "/root/testdata/sf0.001"), R.gazetteer(spark))
    plan = enriched.where("urgency_score > 70 AND location = 'unknown'")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "Python" not in physical
    assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical
    filters = [line for line in physical.splitlines() if "Filter" in line and "FileScan" not in line]
    assert not any("contains" in line.lower() or "regexp" in line for line in filters)


def test_invariants(spark):
    enriched = R.enriched(spark, "/root/testdata/sf0.001")
    broken = enriched.where(
        "urgency_score NOT BETWEEN 0 AND 100 OR (location = 'unknown') <> (location_source = 'none') "
        "OR (lat IS NULL) <> (lon IS NULL) OR (priority = 'CRITICAL_REVIEW') <> (urgency_score > 70 AND location = 'unknown')"
    )
    assert broken.count() == 0


def test_validation(spark):
    rows = [("ok", "", ""), ("", "", ""), ("x" * 1001, "", ""), ("ok", "b" * 501, ""), ("ok", "", "p" * 201), (None, "", "")]
    df = spark.createDataFrame(rows, "content string, user_bio string, user_location string")
    assert [r.valid for r in validate_reports(df).collect()] == [True, False, False, False, False, False]
    good, bad = split_valid(df)
    assert (good.count(), bad.count()) == (1, 5)


def test_hooks_without_type_hints(spark):
    """Plain functions and lambdas, and an empty name counts as none."""
    rows = [("Dinner in Quito", "cook, now at Lima, PE", "")]
    df = spark.createDataFrame(rows, "content string, user_bio string, user_location string")

    def scorer(batches):
        for texts in batches:
            yield texts.map(lambda text: [0.1, 0.7, 0.2])

    scored = E.classify(E.preprocess(df), score_fn=scorer)
    assert scored.first().category == "Help Request"
    located = E.extract_location(E.preprocess(df), entity_fn=lambda batches: (b.map(lambda t: "") for b in batches)).first()
    assert (located.location, located.location_source) == ("Lima, PE", "bio")
    plan = scored.where("urgency_score > 1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_real_texts_reach_every_source(spark):
    sf = "/root/testdata/sf0.01"
    located = E.extract_location(E.preprocess(R.text_reports(spark, sf)), R.word_gazetteer(spark, sf))
    assert {r.location_source for r in located.select("location_source").distinct().collect()} == set(L.LOCATION_CONFIDENCE)
    assert located.select("location").distinct().count() > 100


def test_scans_with_many_small_rows_are_spread(spark):
    """As many pieces as there are cores are not enough for many rows; no row is lost on the way."""
    from siren.operators.lookup import spread

    rows = spark.range(0, 4000, numPartitions=spark.sparkContext.defaultParallelism)
    parts = spread(rows, "id", rows_per_task=100)
    assert parts.rdd.getNumPartitions() == 40 and parts.distinct().count() == 4000
    assert spread(rows, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_repeated_texts_are_enriched_once(spark):
    """Few different texts: the scorer sees each once, and every report gets what enriching it alone gives."""
    from siren.operators.enrich import enrich_repeated

    calls = spark.sparkContext.accumulator(0)

    def scorer(batches):
        for texts in batches:
            calls.add(len(texts))
            yield texts.str.len().map(lambda n: [0.2, 0.5, 0.3] if n > 20 else [0.4, 0.2, 0.4])

    content = F.expr("CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Help, flood near Lima' WHEN 2 THEN '' ELSE 'Sun in Oslo #Oslo' END")
    rows = spark.range(0, 400, numPartitions=4).select("id", content.alias("content"), F.lit("x, NY").alias("user_bio"))
    once = enrich_repeated(rows, score_fn=scorer)
    found = sorted(once.collect(), key=lambda r: r.id)
    assert calls.value <= 4
    expected = E.enrich(rows, score_fn=scorer)
    assert once.columns == expected.columns and once.dtypes == expected.dtypes
    assert found == sorted(expected.collect(), key=lambda r: r.id)
    each = rows.withColumn("content", F.col("id").cast("string"))
    assert enrich_repeated(each).count() == 400


def test_few_large_files_make_no_few_long_tasks(spark, monkeypatch):
    """Answers are joined by as many tasks as the rows ask for, and coordinates come back with them."""
    monkeypatch.setattr(E, "ROWS_PER_JOIN_TASK", 100)
    content = F.expr("CASE id % 2 WHEN 0 THEN 'Help, flood near Lisbon' ELSE 'Sun' END")
    rows = spark.range(0, 1000, numPartitions=2).select("id", content.alias("content"))
    more = spark.range(2000).selectExpr("concat('zzplace', id) place", "'x' display", "0D lat", "0D lon")
    places = R.gazetteer(spark).unionAll(more)
    once = E.enrich_repeated(rows, places)
    expected = E.enrich(rows, places)
    assert once.rdd.getNumPartitions() == 10 and once.columns == expected.columns
    assert sorted(once.collect(), key=lambda r: r.id) == sorted(expected.collect(), key=lambda r: r.id)
    monkeypatch.setattr(E, "ROWS_PER_JOIN_TASK", 500)
    assert E.enrich_repeated(rows, places).rdd.getNumPartitions() == 2


def test_a_row_group_cut_by_bytes_is_one_piece(spark, tmp_path):
    """A scan may have as many pieces as wanted with all rows in one of them, as a row group goes to one piece whole."""
    from siren.operators.lookup import spread

    spark.range(20_000).selectExpr("id", "uuid() AS text").coalesce(1).write.parquet(str(tmp_path / "t"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = spark.read.parquet(str(tmp_path / "t"))
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        parts = spread(rows, "id", rows_per_task=5000)
        filled = parts.select(F.spark_partition_id().alias("p")).distinct().count()
        assert filled == spark.sparkContext.defaultParallelism and parts.distinct().count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
