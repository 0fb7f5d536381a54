import pytest

from siren.operators import remembered as M
from siren.schemas import GAZETTEER
from siren.sources.versioned import Conflict, Version, VersionedTable


def ids(df):
    return sorted(r.tweet_id for r in df.collect())


def reports(spark, names, text="x"):
    return spark.createDataFrame([(n, text, k) for k, n in enumerate(names)], "tweet_id string, content string, ordinal int")


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "a long")
    assert table.current() == Version(-1) and table.read().count() == 0
    one = table.commit(table.current(), [table.stage(spark.range(3).toDF("a"))], x=1)
    two = table.commit(one, [*one.folders, table.stage(spark.range(2).toDF("a"))], y=2)
    assert table.read().count() == 5 and table.read(one).count() == 3 and table.current().notes == {"x": 1, "y": 2}
    assert {r["_at"] for r in table.read(two).collect()} == {0, 1}
    with pytest.raises(Conflict):
        table.commit(one, [])
    assert table.current().number == 1


def test_two_writers_lose_nothing(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "a long")
    calls = []

    def slow(version):
        calls.append(version.number)
        if len(calls) == 1:  # the other writer comes first
            table.update(lambda v: ([*v.folders, table.stage(spark.range(10, 12).toDF("a"))], {}))
        return [*version.folders, table.stage(spark.range(2).toDF("a"))], {}

    table.update(slow)
    assert calls == [-1, 0] and sorted(r.a for r in table.read().collect()) == [0, 1, 10, 11]


def test_clean_keeps_what_is_named(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "a long")
    for k in range(8):
        table.update(lambda v, k=k: ([table.stage(spark.range(k).toDF("a"))], {}))
    table.stage(spark.range(1).toDF("a"))  # of a run that failed
    table.clean()
    assert len(table._names("_log")) == 5
    table.clean(older_than_seconds=-10)
    assert len([n for n in table._names("") if n.startswith("data-")]) == 5 and table.read().count() == 7


def test_collections(spark, tmp_path):
    path, calls = str(tmp_path / "c"), []

    def collect(n):
        def run():
            calls.append(n)
            return spark.range(n).withColumnRenamed("id", f"c{n}")

        return run

    def get(n, now, **options):
        rows, reused = M.collect_or_reuse(spark, path, collect(n), now=now, **options)
        return rows.columns, rows.count(), reused

    assert get(3, 0) == (["c3"], 3, False)
    assert get(4, 299) == (["c3"], 3, True)
    assert get(4, 299, force=True) == (["c4"], 4, False)
    assert get(5, 600) == (["c5"], 5, False)
    assert get(6, 1e4, minutes=1e6) == (["c5"], 5, True)
    assert calls == [3, 4, 5]

    def fails():
        raise OSError("no feed")

    with pytest.raises(OSError):
        M.collect_or_reuse(spark, path, fails, now=1e6)
    assert get(7, 601) == (["c5"], 5, True)


def test_a_newer_collection_of_another_run_stays(spark, tmp_path):
    path = str(tmp_path / "c")

    def slow():
        M.collect_or_reuse(spark, path, lambda: spark.range(9), now=50.0)
        return spark.range(2)

    rows, reused = M.collect_or_reuse(spark, path, slow, now=40.0)
    assert reused and rows.count() == 9


def test_geocoding_remembers_hits_and_misses(spark, tmp_path):
    memory, asked = M.GeocodeMemory(spark, str(tmp_path / "g")), []
    gazetteer = spark.createDataFrame([("lima", "Lima", -12.0, -77.0), ("oslo", "Oslo", 59.9, 10.7)], GAZETTEER)
    find = M.gazetteer_finder(gazetteer)

    def watched(names):
        asked.append(sorted(r.name for r in names.collect()))
        return find(names)

    def look(*names, now=0.0, **options):
        df = spark.createDataFrame([(n,) for n in names], "location string")
        return {r.location: (r.lat, r.found) for r in memory.lookup(df, watched, now=now, **options).collect()}

    assert look("Lima", "Lima", "Atlantis", "unknown", "", None, "1.5,2.5") == {
        "Lima": (-12.0, True), "Atlantis": (None, False), "1.5,2.5": (1.5, True),
    }
    assert look("Lima", "Atlantis", "Oslo", now=100.0)["Oslo"] == (59.9, True)
    assert look("Lima", "Atlantis", now=200.0, retry_misses_after=50.0)["Atlantis"] == (None, False)
    assert asked == [["1.5,2.5", "Atlantis", "Lima"], ["Oslo"], ["Atlantis"]]
    for k in range(12):  # folders are made one again
        look(f"Town {k}", now=300.0 + k)
    assert len(memory.table.current().folders) <= M.MAX_FOLDERS
    known = {r.name: r.looked_up for r in memory.known().collect()}
    assert len(known) == 16 and known["Atlantis"] == 200.0 and known["Town 3"] == 303.0


def test_a_lookup_that_fails_leaves_nothing(spark, tmp_path):
    memory = M.GeocodeMemory(spark, str(tmp_path / "g"))
    df = spark.createDataFrame([("Lima",)], "location string")

    def fails(names):
        raise OSError("no answer")

    with pytest.raises(OSError):
        memory.lookup(df, fails)
    assert memory.known().count() == 0


def test_ids_of_earlier_runs(spark, tmp_path):
    index = M.SeenIndex(spark, str(tmp_path / "s"), buckets=8)
    assert ids(index.first_seen(reports(spark, ["a", "b", "a", "", None]))) == ["a", "b"]
    assert ids(index.first_seen(reports(spark, ["b", "c"]))) == ["c"]
    assert ids(index.first_seen(reports(spark, ["a", "b", "c"]))) == []
    for k in range(12):
        index.first_seen(reports(spark, [f"more {k} {j}" for j in range(30)]))
    assert len(index.ids.current().folders) <= M.MAX_FOLDERS
    assert ids(index.first_seen(reports(spark, ["a", "new", "more 0 7"]))) == ["new"]
    assert index.ids.read().count() == 3 + 360 + 1 and index.ids.read().select("key").distinct().count() == 364


def test_only_touched_buckets_are_read(spark, tmp_path):
    index = M.SeenIndex(spark, str(tmp_path / "s"), buckets=16)
    index.first_seen(reports(spark, [f"k{k}" for k in range(500)]))
    assert len({f.split("bucket=")[1].split("/")[0] for f in index.touched_files(reports(spark, ["k7"]))}) == 1
    assert len(index.touched_files(reports(spark, [f"n{k}" for k in range(500)]))) <= 2


def test_first_row_of_an_id_stays(spark, tmp_path):
    index = M.SeenIndex(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("a", "late", 5), ("a", "early", 1)], "tweet_id string, content string, ordinal int")
    assert [r.content for r in index.first_seen(rows).collect()] == ["early"]
