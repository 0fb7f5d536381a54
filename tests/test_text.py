import random
import re

import pytest
from pyspark.sql import functions as F

from siren.functions import places, text

# Input and cleaned output, worked out by hand.
EDGES = [
    ("Dam at #Orava leaks!!! – see www.dam.sk/2 and ask @mayor_2, OK???", "dam at orava leaks!   see and ask , ok?"),
    ("awwwesome a@b.co x", "a a.co x"),
    ("#", ""),
    ("café #Été ??", "caf   t  ?"),
    ("www", "www"),
    ("@", "@"),
    ("Ünİ", "ni"),
    (None, ""),
]


def one_column(spark, values, function):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [row.out for row in rows.select("i", function("v").alias("out")).orderBy("i").collect()]


def test_clean_text_edges(spark):
    assert one_column(spark, [given for given, _ in EDGES], text.clean_text) == [wanted for _, wanted in EDGES]


def random_texts(n):
    draw = random.Random(7)
    pieces = list("aZ9_!?#@.é İßΣς\t\n\r\x0b\x1c\x85  　🌍中") + [
        "http://a.b/c", "www.x", "https", "!!!", "???", "#Tag", "@user", "  ", "Houston, TX", "<b>", ">",
    ]
    return ["".join(draw.choices(pieces, k=draw.randint(0, 25))) for _ in range(n)]


def test_cleaned_texts_have_no_links_mentions_or_marks(spark):
    """What must hold of any cleaned text, whatever it was made from."""
    values = random_texts(3000)
    cleaned = one_column(spark, values, text.clean_text)
    for given, found in zip(values, cleaned):
        assert found.isascii() and found == found.strip() and "#" not in found
        assert "!!" not in found and "??" not in found
        plain = re.sub(r"[^a-z]", "", given.lower()) if given.isascii() and not re.search("http|www|@", given.lower()) else None
        assert plain is None or re.sub(r"[^a-z]", "", found) == plain
    again = one_column(spark, cleaned, text.clean_text)
    assert all(second in (first, " ".join(first.split())) or "@" in first or "http" in first or "www" in first for first, second in zip(cleaned, again))


def test_hashtags_agree_with_python(spark):
    values = random_texts(1000)
    assert one_column(spark, values, text.extract_hashtags) == [re.findall(r"#(\w+)", value) for value in values]


def test_strip_tags_agrees_with_python(spark):
    values = random_texts(1000)
    wanted = [" ".join(re.sub(r"<[^>]+>", " ", value).split())[:20] for value in values]
    assert one_column(spark, values, lambda v: text.strip_tags(v, 20)) == wanted


def test_strip_space_agrees_with_python(spark):
    values = random_texts(1000)
    assert one_column(spark, values, text.strip_space) == [value.strip() for value in values]


def test_city_state_agrees_with_python(spark):
    values = random_texts(1000) + ["Few clouds, Rain", "éParis, FR", "in Port of Spain , TT", "Abc, Def9", "AB, CD"]
    pattern = re.compile(r"\b([A-Z][a-zA-Z\s]{2,20}),\s*([A-Z]{2}|[A-Z][a-z]+)\b")
    wanted = [f"{m[1]}, {m[2]}" if (m := pattern.search(value)) else "" for value in values]
    assert one_column(spark, values, places.city_state) == wanted


@pytest.mark.parametrize(
    "tags, wanted",
    [
        ("HoustonFlood rescue", "Houston"),
        ("rescue LosAngelesFire", "LosAngeles"),
        ("NepalEarthquake", "Nepal"),
        ("Flood Manila", "Flood"),
        ("LAfireDisaster NYCstorm", ""),
        ("été Manila", "Manila"),
        ("Ab abc", ""),
        ("HoustonFloodFire", "HoustonFlood"),
        ("Abcdefghijklmnop", ""),
        ("#TampaStorm", "Tampa"),
        ("", ""),
    ],
)
def test_hashtag_place(spark, tags, wanted):
    assert one_column(spark, [tags], places.hashtag_place) == [wanted]


def test_normalize_location(spark):
    given = [" Worldwide ", "x", None, "🌍", "São Paulo", "　Lima　", "a" * 100, "é", "Global city"]
    wanted = [None, None, None, None, "So Paulo", "Lima", "a" * 100, None, "Global city"]
    assert one_column(spark, ["b" * 90], lambda v: places.normalize_location(v, 80)) == ["b" * 80]
    assert one_column(spark, given, places.normalize_location) == wanted


def test_pub_dates(spark):
    given = [
        "Sat, 18 Apr 2026 10:47:54 GMT", "Sat, 18 Apr 2026 10:47:54 +0200", "8 Apr 2026 01:02:03 -05:00", "soon", None,
    ]
    wanted = ["2026-04-18T10:47:54+00:00", "2026-04-18T08:47:54+00:00", "2026-04-08T06:02:03+00:00", "", ""]
    assert one_column(spark, given, lambda v: text.iso_date(text.parse_pub_date(v))) == wanted


def test_coordinates(spark):
    given = ["29.76,-95.36", " 1, 2 ", "1,2,3", "north", "", None]
    pairs = one_column(spark, given, places.parse_coordinates)
    assert [pair and (pair.lat, pair.lon) for pair in pairs] == [(29.76, -95.36), (1.0, 2.0), None, None, None, None]


def test_numbers(spark):
    assert one_column(spark, ["1.5", "x", None], lambda v: text.coerce_numeric(v, 0)) == [1.5, 0.0, 0.0]
    assert one_column(spark, ["2", "9"], lambda v: text.clip_lower(F.col(v).cast("double"), 5)) == [5.0, 9.0]
