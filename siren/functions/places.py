"""Location columns: patterns in text, hashtag places, normalisation, the cascade, coordinate literals."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siren import lexicons as L
from siren.functions.text import (
    NON_ASCII, SPACE, SPACE_CHARS, WORD, WORD_CHARS, _col, is_ascii, strip_space, text_or_empty,
)

# Java's word boundary is ASCII only; these are its Unicode form.
START = f"(?<!{WORD})"
END = f"(?!{WORD})"

# Patterns (fixed values). A look at the first letter comes before the look behind it, which costs more.
CITY_STATE = f"(?=[A-Z]){START}[A-Z][a-zA-Z{SPACE_CHARS}]{{2,20}},{SPACE}*(?:[A-Z]{{2}}|[A-Z][a-z]+){END}"
HAZARDS = "|".join(L.HAZARD_SUFFIXES)
PLACE_TAG = rf"(?:^|\s)#*([A-Z][a-z]+(?:[A-Z][a-z]+)?(?:{HAZARDS})|[A-Z][a-z]{{2,14}})(?=\s|$)"
HAZARD_END = f"(?<=[a-z])(?:{HAZARDS})$"
COORDINATE_PAIR = rf"^(-?\d+\.?\d*),{SPACE}*(-?\d+\.?\d*)$"
COORDINATES_IN_TEXT = rf"(-?\d{{1,3}}\.\d+),{SPACE}*(-?\d{{1,3}}\.\d+)"
LOOSE_HASHTAG = (
    r"(?:^|#)([A-Z][a-z]+(?:[A-Z][a-z]+)?(?:flood|quake|fire|storm|hurricane|cyclone|typhoon)?)" + END
)


def city_state(text: str | Column) -> Column:
    """First "City, ST" or "City, State" of a text; empty without one. Texts without a comma are not searched."""
    text = text_or_empty(text)
    pair = F.regexp_extract(text, CITY_STATE, 0)
    return F.when(F.contains(text, F.lit(",")), F.regexp_replace(pair, f",{SPACE}*", ", ")).otherwise("")


def hashtag_place(tags: str | Column) -> Column:
    """First of the space-joined hashtags that looks like a place; empty without one.

    A tag counts as a place if it is a capitalised name before a hazard word (the name is the place), or one
    capitalised word of 3-15 letters. One scan tests both per tag, in that order.
    """
    tags = text_or_empty(tags)
    tag = F.regexp_extract(tags, PLACE_TAG, 1)
    return F.when(tags != "", F.regexp_replace(tag, HAZARD_END, "")).otherwise("")


def normalize_location(place: str | Column, max_chars: int | None = None) -> Column:
    """A usable location name, or NULL for noise and leftovers of under two characters; ``max_chars`` cuts it."""
    usable = _usable(strip_space(place))
    return usable if max_chars is None else F.substring(usable, 1, max_chars)


def _usable(stripped: Column) -> Column:
    ascii_only = F.when(is_ascii(stripped), stripped).otherwise(
        strip_space(F.regexp_replace(stripped, NON_ASCII, ""))
    )
    usable = (F.char_length(ascii_only) >= 2) & ~F.lower(stripped).isin(L.LOCATION_NOISE)
    return F.when(usable, ascii_only)


def first_usable(steps: Sequence[tuple[str, Column]]) -> Column:
    """The first (source, place) whose place normalises, as a struct; NULL when none does."""
    candidates = F.array(*[F.struct(F.lit(source).alias("source"), place.alias("place")) for source, place in steps])

    def each(found: Column, change: Callable[[Column], Column]) -> Column:
        return F.transform(
            found, lambda step: F.struct(step["source"].alias("source"), change(step["place"]).alias("place"))
        )

    named = F.filter(candidates, lambda step: step["place"] != "")
    usable = each(each(named, strip_space), _usable)
    return F.try_element_at(F.filter(usable, lambda step: step["place"].isNotNull()), F.lit(1))


def location_steps(
    text: str | Column,
    hashtags: str | Column,
    profile: str | Column,
    bio: str | Column,
    text_place: Column | None = None,
    bio_place: Column | None = None,
) -> list[tuple[str, Column]]:
    """The candidates of the cascade in order, before normalisation: (source, place)."""
    steps = [] if text_place is None else [("tweet", text_place)]
    # A name found in the bio hides the pattern, even when the name turns out to be noise.
    in_bio = city_state(bio) if bio_place is None else F.coalesce(F.nullif(bio_place, F.lit("")), city_state(bio))
    return steps + [
        ("tweet", city_state(text)),
        ("hashtag", hashtag_place(hashtags)),
        ("profile_location", text_or_empty(profile)),
        ("bio", in_bio),
    ]


def location_columns(found: str | Column) -> dict[str, Column]:
    """location, location_source and location_confidence from a ``first_usable`` column."""
    found = _col(found)
    source = F.coalesce(found["source"], F.lit("none"))
    return {
        "location": F.coalesce(found["place"], F.lit("unknown")),
        "location_source": source,
        "location_confidence": location_confidence(source),
    }


def location_confidence(source: str | Column) -> Column:
    entries = [F.lit(value) for pair in L.LOCATION_CONFIDENCE.items() for value in pair]
    return F.create_map(*entries)[_col(source)]


def first_listed_place(text: str | Column, places: Mapping[str, str]) -> Column:
    """Display name of the first listed place in a text, the longest one where several start.

    ``places`` maps lower-case names to display names. The list is part of the expression, so this is for lists of
    checked size; it needs neither a join nor a shuffle. Names match whole words, whatever stands between them.
    """
    if not places:
        return F.lit(None).cast("string")
    by_first: dict[str, list[str]] = {}
    for place in sorted(places, key=lambda name: (-len(name.split()), -len(name), name)):
        by_first.setdefault(place[0], []).append(place)

    def tail(place: str) -> str:
        return f"[^{WORD_CHARS}]+".join(re.escape(word) for word in place[1:].split(" "))

    heads = [f"{re.escape(first)}(?:{'|'.join(map(tail, names))})" for first, names in sorted(by_first.items())]
    letters = "".join(re.escape(first) for first in sorted(by_first))
    pattern = f"(?=[{letters}]){START}({'|'.join(heads)}){END}"
    match = F.regexp_extract(F.lower(text_or_empty(text)), pattern, 1)
    key = F.regexp_replace(match, f"[^{WORD_CHARS}]+", " ")
    entries = [F.lit(value) for pair in sorted(places.items()) for value in pair]
    return F.when(match != "", F.try_element_at(F.create_map(*entries), key))


def hashtag_first_location(text: str | Column, hashtags: str | Column, place: Column | None = None) -> Column:
    """The simpler extractor: first hashtag, else a listed place of text and bio, else "Unknown"."""
    options = [F.try_element_at(_col(hashtags), F.lit(1))]
    if place is not None:
        options.append(place)
    return F.coalesce(*options, F.lit("Unknown"))


def parse_coordinates(location: str | Column) -> Column:
    """A whole-string "lat,lon" as a struct of doubles; NULL for anything else."""
    location = strip_space(location)
    lat = F.regexp_extract(location, COORDINATE_PAIR, 1)
    lon = F.regexp_extract(location, COORDINATE_PAIR, 2)
    return F.when(F.contains(location, F.lit(",")) & (lat != ""), F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon")))


def coords_in_text(text: str | Column) -> Column:
    """First decimal "lat,lon" pair anywhere in a text, as written; NULL without one."""
    return F.nullif(F.regexp_extract(text_or_empty(text), COORDINATES_IN_TEXT, 0), F.lit(""))


def loose_hashtag_place(text: str | Column) -> Column:
    """First place-like hashtag or opening word of a raw text; NULL without one."""
    return F.nullif(F.regexp_extract(text_or_empty(text), LOOSE_HASHTAG, 1), F.lit(""))
