import re

import pytest
from pyspark.sql import functions as F

from siren.operators import skipping as S
from siren.operators.search import filter_matches


@pytest.fixture
def table(spark, tmp_path):
    """Twenty files of a hundred texts; some words stand in one file only."""
    rows = spark.range(2000).select(
        "id", F.concat(F.lit("common words "), F.when(F.col("id") == 707, "Straße zum KÖNIGSWEG ſchloß").when(F.col("id") == 1500, "a.b*c")
                       .otherwise(F.concat(F.lit("town"), F.col("id").cast("string")))).alias("content"),
    )
    rows.repartitionByRange(20, "id").write.parquet(str(tmp_path / "t"))
    return S.TrigramIndex(spark, str(tmp_path / "t"), str(tmp_path / "index"))


PATTERNS = ["königsweg", "SCHLOSS|schloß", "town1234", "town(12|13)\\d4", r"a\.b\*c", "common", "absent", "to.n77", "zum k[öo]nig", "", "town5{2}"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_search_equals_the_scan(spark, table, pattern):
    table.refresh()
    whole = filter_matches(spark.read.parquet(table.table), "content", pattern)
    assert sorted(r.id for r in table.search(pattern).collect()) == sorted(r.id for r in whole.collect())


def test_rare_patterns_read_few_files(table):
    assert table.refresh() == 20 and table.refresh() == 0
    assert len(table.files("königsweg")) == 1 and table.files("absent") == []
    assert len(table.files("königsweg|a\\.b\\*c")) == 2 and len(table.files("common")) == 20
    assert table.files("t.wn") is None and table.files("zz|common") is None


def test_new_files_are_read_until_they_are_indexed(spark, table):
    table.refresh()
    spark.createDataFrame([(9000, "a Königsweg again")], "id long, content string").coalesce(1).write.mode("append").parquet(table.table)
    assert sorted(r.id for r in table.search("königsweg").collect()) == [707, 9000]
    assert len(table.files("absent")) == 1 and table.refresh() == 1 and table.files("absent") == []
    assert table.entries.read().count() == 21


@pytest.mark.parametrize("pattern, wanted", [
    ("rescue", [["rescue"]]), ("abc?def", [["def"]]), ("abcd*efg", [["abc", "efg"]]), ("a|bcd", None), ("(abc|d)efg", [["efg"]]),
    ("abc[de]fgh", [["abc", "fgh"]]), ("abc+d", [["abc"]]), (r"x\.yz", [["x.yz"]]), (r"abc\dxyz", [["abc", "xyz"]]), ("(?s)abc", None),
    (r"\Qabc", None), ("abc{2}def", [["def"]]), ("ab", None), ("abc|def", [["abc"], ["def"]]), ("abc[^]x]def", None), ("^abc$", [["abc"]]),
])
def test_literals_of_patterns(pattern, wanted):
    assert S.literal_runs(pattern) == wanted


def test_folding_covers_case_insensitive_matches():
    for a, b in [("K", "k"), ("ſ", "s"), ("İ", "i"), ("Σ", "ς"), ("É", "é"), ("Ü", "ü")]:
        assert S.folded(a) == S.folded(b) or not re.match(a, b, re.I)
