import random
import re

import pytest
from pyspark.sql import functions as F

from siren.operators import gazetteer as G
from siren.operators.lookup import lookup_join
from siren.schemas import GAZETTEER

NAMES = ["york", "new york", "new york city", "port-au-prince", "são paulo", "lima", "st. john's", "c++"]


def make_gazetteer(spark):
    return spark.createDataFrame([(name, name.title(), float(i), -float(i)) for i, name in enumerate(NAMES)], GAZETTEER)


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def brute_force(text):
    tokens, listed = words(text), {tuple(words(name)): name.title() for name in NAMES}
    for start in range(len(tokens)):
        for length in range(len(tokens) - start, 0, -1):
            if tuple(tokens[start : start + length]) in listed:
                return listed[tuple(tokens[start : start + length])]
    return None


def sample_texts():
    draw = random.Random(3)
    vocabulary = ["new", "york", "city", "New-York", "Lima", "lima.", "São", "Paulo", "Port", "au", "prince", "x", "yorks", "St", "John's", "C", "é"]
    return [" ".join(draw.choices(vocabulary, k=draw.randint(0, 8))) for _ in range(400)] + [None, ""]


@pytest.mark.parametrize("sizes", [{}, {"max_inline": 0}, {"max_inline": 0, "max_broadcast_rows": 0}])
def test_every_way_agrees_with_brute_force(spark, sizes):
    texts = sample_texts()
    rows = [(f"k{i}", text, text[::-1] if text else text) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "tweet_id string, content string, user_bio string")
    matched = G.gazetteer_match(df, make_gazetteer(spark), {"content": "a", "user_bio": "b"}, **sizes)
    found = {r.tweet_id: (r.a, r.b) for r in matched.select("tweet_id", "a", "b").collect()}
    assert found == {key: (brute_force(text), brute_force(bio)) for key, text, bio in rows}


def test_place_late_in_a_long_text(spark):
    df = spark.createDataFrame([("k", "word " * 5000 + "Lima")], "tweet_id string, content string")
    for sizes in ({}, {"max_inline": 0}):
        assert G.gazetteer_match(df, make_gazetteer(spark), {"content": "a"}, **sizes).first().a == "Lima"


def skewed(spark, n=20000):
    """A third of the rows unknown, a third in one place."""
    place = F.when(F.col("id") % 3 == 0, "unknown").when(F.col("id") % 3 == 1, "Lima").otherwise(
        F.concat(F.lit("Town "), (F.col("id") % 50).cast("string"))
    )
    return spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("tweet_id"), place.alias("location"))


@pytest.mark.parametrize("sizes", [{}, {"max_broadcast_rows": 0}])
def test_coordinates_on_skewed_places(spark, sizes):
    placed = G.attach_coordinates(skewed(spark), make_gazetteer(spark), **sizes)
    assert placed.count() == 20000
    assert placed.where("lat IS NOT NULL").select("location", "lat").distinct().collect() == [("Lima", 5.0)]
    assert placed.where("lat IS NOT NULL").count() == 6667


def test_large_lookup_spreads_a_hot_key(spark):
    rows = skewed(spark)
    lookup = rows.select("location").distinct().withColumn("n", F.lit(1))
    joined = lookup_join(rows, lookup, "location", "tweet_id", max_broadcast_rows=0)
    plan = joined._jdf.queryExecution().toString()
    assert "_salt" in plan
    assert joined.where("n = 1").count() == 20000


def test_geocode_report(spark):
    rows = [("Lima",), ("Lima",), ("unknown",), ("none",), ("",), (None,), ("Oslo",), ("1.5,2.5",)]
    df = spark.createDataFrame(rows, "location string")
    assert tuple(G.geocode_report(df, make_gazetteer(spark)).first()) == (3, 2)


@pytest.mark.parametrize("sizes", [{}, {"max_inline": 0}, {"max_inline": 0, "max_broadcast_rows": 0}])
def test_ids_do_not_matter(spark, sizes):
    """Repeated, blank and absent ids: a text's place belongs to the text."""
    rows = [("a", "York"), ("a", "no place"), ("", "Lima"), ("", ""), (None, "Port-au-Prince"), (None, None), ("a", "york")]
    df = spark.createDataFrame(rows, "tweet_id string, content string")
    found = G.gazetteer_match(df, make_gazetteer(spark), {"content": "place"}, **sizes).collect()
    assert sorted(((r.tweet_id, r.content, r.place) for r in found), key=str) == sorted(
        ((i, t, brute_force(t)) for i, t in rows), key=str
    )


@pytest.mark.parametrize("sizes, scans", [({"max_inline": 0}, 1), ({"max_inline": 0, "max_broadcast_rows": 50}, 1)])
def test_rows_are_read_once_and_stay(spark, tmp_path, sizes, scans):
    """A trie that fits is walked where the rows are: one scan, no shuffle, no join."""
    spark.createDataFrame([("k", "Lima")] * 50, "tweet_id string, content string").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    matched = G.gazetteer_match(df, make_gazetteer(spark), {"content": "a"}, **sizes)
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == scans and "hashpartitioning" not in plan and "Join" not in plan
    assert matched.where("a = 'Lima'").count() == 50


def test_bit_tables_let_only_names_through(spark):
    paths, ends = (bits.tobytes() for bits in G._filters(G.place_names(make_gazetteer(spark))))
    assert list(G._listed(["in", "new", "york", "city", "lima"], paths, ends)) == [
        (1, "new york"), (1, "new york city"), (2, "york"), (4, "lima"),
    ]


def test_blank_ids_do_not_meet(spark):
    """Rows without an id are dealt over the salts by all they hold."""
    rows = spark.range(4000).selectExpr("CAST(NULL AS STRING) tweet_id", "'unknown' location", "id AS n")
    placed = G.attach_coordinates(rows, make_gazetteer(spark), max_broadcast_rows=0)
    plan = placed._jdf.queryExecution().toString()
    assert "xxhash64(tweet_id" in plan and placed.count() == 4000 and placed.where("lat IS NULL").count() == 4000


def test_sizes_are_summed_where_the_rows_are(spark):
    from siren.operators.lookup import fits

    df = spark.range(1000).selectExpr("id", "repeat('x', 100) AS name")
    assert fits(df, 1000) and not fits(df, 999) and not fits(df, 1000, max_bytes=100_000)


def test_only_hot_keys_repeat_the_lookup(spark, monkeypatch):
    """A large lookup is moved about once: its rows are repeated for keys with many rows alone, and no row is lost."""
    from siren.operators import lookup

    monkeypatch.setattr(lookup, "HOT_ROWS", 1000)
    rows = skewed(spark).union(spark.range(3000).selectExpr("CONCAT('n', id)", "CAST(NULL AS STRING)"))
    table = spark.range(5000).selectExpr("CONCAT('Town ', id) AS location", "id AS n").union(
        spark.sql("SELECT 'Lima', -1L")
    ).repartition(4)
    joined = lookup_join(rows, table, "location", "tweet_id", max_broadcast_rows=0)
    joined.write.format("noop").mode("overwrite").save()
    assert joined.count() == 23000 and joined.where("n = -1").count() == 6667 and joined.where("n >= 0").count() == 6666
    assert "sequence(0, 31" not in joined._jdf.queryExecution().toString()


def test_names_leave_a_worker_in_small_batches(spark, monkeypatch):
    """However many names the texts of a batch hold, a worker holds a bounded number of them."""
    seen = {}

    def caught(df, name):
        if name == "listed-names" and "sizes" not in seen:
            seen["sizes"] = df.mapInArrow(lambda batches: (G.pa.RecordBatch.from_arrays([G.pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
        return written(df, name)

    from siren.operators.lookup import written

    monkeypatch.setattr(G, "written", caught)
    df = spark.createDataFrame([("Lima York " * 3000,)] * 8, "content string").coalesce(1)
    matched = G.gazetteer_match(df, make_gazetteer(spark), {"content": "place"}, max_inline=0, max_broadcast_rows=0)
    assert matched.where("place = 'Lima'").count() == 8
    sizes = [row.n for row in seen["sizes"]]
    assert max(sizes) <= 10_000


def test_chance_hits_of_the_bit_tables_hide_no_place(spark, monkeypatch):
    """Where the first marked name is none, the names behind it still count."""
    everything = lambda names: tuple(G.np.full((1 << G.FILTER_BITS) // 8, 255, G.np.uint8) for _ in range(2))
    monkeypatch.setattr(G, "_filters", everything)
    rows = [(i, text) for i, text in enumerate(sample_texts())]
    df = spark.createDataFrame(rows, "id long, content string")
    found = G.gazetteer_match(df, make_gazetteer(spark), {"content": "place"}, max_inline=0, max_broadcast_rows=0).collect()
    assert sorted((r.id, r.place or "") for r in found) == sorted((i, brute_force(t) or "") for i, t in rows)


def test_few_keys_leave_a_large_lookup_where_it_is(spark):
    """Written rows with few different keys take their rows of the lookup; neither side is shuffled."""
    rows = spark.createDataFrame([("Lima", 1), ("none", 2), (None, 3), ("Lima", 4)], "location string, n int")
    table = spark.range(5000).selectExpr("CONCAT('Town ', id) AS location", "id AS m").union(spark.sql("SELECT 'Lima', -1L"))
    sizes = {"max_broadcast_rows": 100, "rows_are_written": True}
    joined = lookup_join(rows, table, "location", "n", **sizes)
    assert sorted((r.n, r.m) for r in joined.collect()) == sorted([(1, -1), (2, None), (3, None), (4, -1)])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert [r.n for r in lookup_join(rows, table, "location", "n", "inner", **sizes).orderBy("n").collect()] == [1, 4]
    placed = G.attach_coordinates(rows, make_gazetteer(spark), max_broadcast_rows=3, rows_are_written=True)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and placed.where("lat IS NOT NULL").count() == 2


def test_what_a_gazetteer_is_made_of_is_read_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    gazetteer = make_gazetteer(spark)
    n = gazetteer.count()
    for sizes in ({}, {"max_inline": 0}, {"max_inline": 0, "max_broadcast_rows": 0}):
        before = calls.value
        places = G.prepare(gazetteer.mapInArrow(counted, gazetteer.schema), **sizes)
        assert places.entries.count() and calls.value - before == n


def test_names_that_are_places_are_kept_in_one_table(spark, monkeypatch):
    """A gazetteer is moved and written once; only places written otherwise than their names ask for a second table."""
    tables = []

    def noted(df, name):
        tables.append(name)
        return written(df, name)

    from siren.operators.lookup import written

    monkeypatch.setattr(G, "written", noted)
    columns = "place string, display string, lat double, lon double"
    rows = [("Lima", "Lima", -12.0, -77.0), ("LIMA", None, 1.0, 2.0), ("New York", "b", 4.0, 3.0), ("!", "z", 0.0, 0.0), (None, "n", 0.0, 0.0)]
    for sizes in ({"max_inline": 0}, {"max_inline": 0, "max_broadcast_rows": 0}):
        tables.clear()
        places = G.prepare(spark.createDataFrame(rows[:3], columns), **sizes)
        assert tables == ["places"]
        assert sorted(places.names.collect()) == [("lima", "Lima"), ("new york", "b")]
        assert sorted(places.entries.collect()) == [("lima", None, 1.0, 2.0), ("new york", "b", 4.0, 3.0)]
        tables.clear()
        places = G.prepare(spark.createDataFrame([*rows, ("new - york", "a", 5.0, 6.0)], columns), **sizes)
        assert tables == ["places", "place-names"]
        assert sorted(places.names.collect()) == [("lima", "Lima"), ("new york", "a")]
        assert places.entries.where("place = 'new york'").collect() == [("new york", "b", 4.0, 3.0)]
    assert places.filters is not None
