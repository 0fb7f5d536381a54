"""Places from a gazetteer table (place, display, lat, lon): finding them in texts and giving coordinates.

A gazetteer is made ready once (``prepare``) and serves any number of batches. Up to ``max_inline`` names become part of
the expression. More become a trie of words that is walked once along each text: up to ``max_trie`` names the trie itself
is broadcast, and a text's place is a column like any other. Beyond that only two tables of bits of fixed size travel, one
of the trie's paths and one of its ends; what they let through, (digest, column, position, name), is joined to the names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siren.functions.places import first_listed_place, parse_coordinates
from siren.functions.text import WORD, text_or_empty
from siren.operators.lookup import MAX_BROADCAST_ROWS, SALTS, fits, lookup_join, row_hash, written

MAX_INLINE_PLACES = 1000
#: Names of a broadcast trie: some tens of megabytes in each worker.
MAX_TRIE_NAMES = 200_000
#: Bits of each of the two tables (8 MB); a larger gazetteer only lets more names through to the join.
FILTER_BITS = 26
#: Names that the bit tables let through before they leave a Python worker, so that its memory does not follow the gazetteer.
MAX_LISTED = 10_000
#: Words whose first step a task remembers.
MAX_WORDS = 50_000
NO_PLACE = ["unknown", "", "none"]

#: What JVM and Python agree on as a word of a lower-case text: letters and numbers of any alphabet.
_WORD = re.compile(r"\w+")
_END = ""


@dataclass(frozen=True)
class Places:
    """A gazetteer that is ready for use; exactly one of ``inline``, ``trie`` and ``filters`` finds names in texts."""

    entries: DataFrame
    inline: dict[str, str] | None = None
    trie: Broadcast | None = None
    filters: Broadcast | None = None
    names: DataFrame | None = None
    bounds: dict[str, int] = field(default_factory=dict)
    #: Whether the coordinates, and the names, are few enough to broadcast, measured once.
    entries_fit: bool = True
    names_fit: bool = True


def prepare(
    gazetteer: DataFrame | Places,
    max_inline: int = MAX_INLINE_PLACES,
    max_trie: int = MAX_TRIE_NAMES,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> Places:
    """Make a gazetteer ready. What it is derived from is read once: one row per place is written, and only that table is read.

    Most places are their own names, words with a space between; such names differ as the places do, so the table holds the
    names too. Only where a place is written otherwise ("St. John's") are the names brought together in a table of their own.
    """
    if isinstance(gazetteer, Places):
        return gazetteer
    stored = written(_by_place(gazetteer), "places")
    entries = stored.select("place", "display", "lat", "lon")
    shown = F.coalesce("display", "shown").alias("display")
    inline = inline_places(stored.select("place", shown), max_inline)
    if inline is not None:
        return Places(entries, inline=inline)
    names = stored.select(F.coalesce("name", "place").alias("name"), shown).where("name != ''")
    if not stored.where("name != ''").isEmpty():
        names = written(names.groupBy("name").agg(F.min("display").alias("display")), "place-names")
    # What each batch of a stream looks up is measured here, once.
    entries_fit = fits(entries, max_broadcast_rows)
    context = stored.sparkSession.sparkContext
    if fits(names, min(max_trie, max_broadcast_rows)):
        trie = word_trie((row.name, row.display) for row in names.toLocalIterator())
        return Places(entries, trie=context.broadcast(trie), names=names, entries_fit=entries_fit)
    return Places(
        entries, filters=context.broadcast(_filters(names)), names=names, entries_fit=entries_fit,
        names_fit=fits(names, max_broadcast_rows), bounds={"max_broadcast_rows": max_broadcast_rows},
    )


def distinct_places(gazetteer: DataFrame) -> DataFrame:
    """One row per lower-case place name."""
    return _by_place(gazetteer).select("place", "display", "lat", "lon")


def _by_place(gazetteer: DataFrame) -> DataFrame:
    """One row per lower-case place, with its name where that is not the place itself.

    ``shown`` is the least display, which names take, where ``display`` is absent; both are mostly NULL, and take no room.
    """
    entry = F.struct("display", "lat", "lon")
    grouped = gazetteer.groupBy(F.lower("place").alias("place")).agg(
        F.min(entry).alias("entry"), F.min("display").alias("shown")
    )
    name = F.array_join(_words("place"), " ")
    return grouped.select(
        "place", "entry.display", "entry.lat", "entry.lon",
        F.when(~name.eqNullSafe(F.col("place")), name).alias("name"),
        F.when(F.col("entry.display").isNull(), F.col("shown")).alias("shown"),
    )


def place_names(gazetteer: DataFrame) -> DataFrame:
    """Each name as its words, the way texts are read; a name may come more than once."""
    words = _words("place")
    return gazetteer.select(F.array_join(words, " ").alias("name"), F.size(words).alias("n_words"), "display").where(
        "n_words > 0"
    )


def inline_places(gazetteer: DataFrame, max_places: int = MAX_INLINE_PLACES) -> dict[str, str] | None:
    """Names of a gazetteer small enough to be part of an expression, else None. Reads at most one row more."""
    rows = place_names(gazetteer).limit(max_places + 1).collect()
    if len(rows) > max_places:
        return None
    places: dict[str, str] = {}
    for row in rows:
        places[row.name] = min(row.display, places.get(row.name, row.display))
    return places


def word_trie(names: Iterable[tuple[str, str]]) -> dict:
    """Names as nested dictionaries by word; a name's display stands under the empty word of its node."""
    root: dict = {}
    for name, display in names:
        node = root
        for word in name.split(" "):
            node = node.setdefault(word, {})
        node[_END] = display
    return root


def first_in_trie(trie: dict, text: str) -> str | None:
    """Display name of the first listed place of a lower-case text, the longest one where several start."""
    words = _WORD.findall(text)
    for start, word in enumerate(words):
        node, found = trie.get(word), None
        at = start + 1
        while node is not None:
            found = node.get(_END, found)
            node = node.get(words[at]) if at < len(words) else None
            at += 1
        if found is not None:
            return found
    return None


def gazetteer_match(
    df: DataFrame,
    gazetteer: DataFrame | Places,
    columns: Mapping[str, str],
    max_inline: int = MAX_INLINE_PLACES,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Add the first listed place of each text column: earliest word, longest name.

    ``columns`` maps text columns to the columns to add. Names match case-insensitively, by whole words, over the
    whole text. With a broadcast trie or an inline list the rows stay where they are and nothing is shuffled. A gazetteer
    beyond that is joined to the names that its bit tables let through, and the answers for all columns come back in
    one join by a digest of the texts: equal texts have equal answers, whatever ids their rows have. That join writes its
    answers before the rows are read again, so streams go through ``foreachBatch`` (as in ``streaming.live``).
    """
    places = prepare(gazetteer, max_inline, max_broadcast_rows=max_broadcast_rows)
    if places.inline is not None:
        return df.withColumns({out: first_listed_place(text, places.inline) for text, out in columns.items()})
    if places.trie is not None:
        trie = places.trie

        @F.arrow_udf("string")
        def walk(texts: pa.Array) -> pa.Array:
            return pa.array([first_in_trie(trie.value, text.as_py()) for text in texts], pa.string())

        return df.withColumns({out: walk(F.lower(text_or_empty(text))) for text, out in columns.items()})
    return _match_by_join(df, places, columns)


def _filters(names: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Which cells the paths of all names reach, and which their ends; combined where the names are."""
    size, part = 1 << FILTER_BITS, 1 << 20

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.zeros(size, bool), np.zeros(size, bool)]
        for batch in batches:
            for name in batch.column("name").to_pylist():
                sum_ = 0
                for word in name.split(" "):
                    sum_, cell = _step(word, sum_)
                    bits[0][cell] = True
                bits[1][cell] = True
        yield _packed({(kind, k): np.packbits(bits[kind][k * part : (k + 1) * part])
                       for kind in (0, 1) for k in range(size // part) if bits[kind][k * part : (k + 1) * part].any()})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for kind, k, blob in zip(*[batch.column(c).to_pylist() for c in ("kind", "part", "bits")], strict=True):
                bits = np.frombuffer(blob, np.uint8)
                found[kind, k] = found[kind, k] | bits if (kind, k) in found else bits
        yield _packed(found)

    schema = "kind int, part int, bits binary"
    parts = names.select("name").mapInArrow(mark, schema).repartition("kind", "part").mapInArrow(join, schema)
    out = (np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8))
    for row in parts.toLocalIterator():  # 2 tables of fixed size
        out[row.kind][row.part * part // 8 : (row.part + 1) * part // 8] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def _packed(found: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    arrays = [pa.array([kind for kind, _ in found], pa.int32()), pa.array([k for _, k in found], pa.int32())]
    arrays.append(pa.array([bits.tobytes() for bits in found.values()], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["kind", "part", "bits"])


def _step(word: str, sum_: int) -> tuple[int, int]:
    """The checksum of a path that goes on with a word, and its cell."""
    sum_ = zlib.crc32(word.encode() + b" ", sum_)
    return sum_, (sum_ ^ (sum_ >> 16)) & ((1 << FILTER_BITS) - 1)


def _listed(words: list[str], paths: bytes, ends: bytes, starts: dict[str, int | None] | None = None) -> Iterator[tuple[int, str]]:
    """(position, name) of what may be listed names: each place's path is followed while its cells are marked.

    ``starts`` remembers words from text to text: the checksum of one that may begin a name, None for any other.
    """
    starts = {} if starts is None else starts
    if len(starts) > MAX_WORDS:
        starts.clear()
    for start, word in enumerate(words):
        if word in starts:
            sum_ = starts[word]
        else:
            sum_, cell = _step(word, 0)
            starts[word] = sum_ = sum_ if paths[cell >> 3] >> (7 - (cell & 7)) & 1 else None
        if sum_ is None:
            continue
        at, cell = start, (sum_ ^ (sum_ >> 16)) & ((1 << FILTER_BITS) - 1)
        while True:
            if ends[cell >> 3] >> (7 - (cell & 7)) & 1:
                yield start, " ".join(words[start : at + 1])
            at += 1
            if at == len(words):
                break
            sum_, cell = _step(words[at], sum_)
            if not paths[cell >> 3] >> (7 - (cell & 7)) & 1:
                break


def _match_by_join(df: DataFrame, places: Places, columns: Mapping[str, str]) -> DataFrame:
    filters, outs = places.filters, list(columns.values())
    key = _digest(list(columns))

    def candidates(batches: Iterator[pa.RecordBatch], only_first: bool) -> Iterator[pa.RecordBatch]:
        paths, ends = (bits.tobytes() for bits in filters.value)
        types = [pa.binary(), pa.int32(), pa.int32(), pa.string()]
        out: list[list] = [[], [], [], []]
        starts: dict[str, int | None] = {}

        def listed_so_far() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types, strict=True)], ["text", "part", "pos", "name"]
            )
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            for k in range(len(outs)):
                for row in range(batch.num_rows):
                    text_key, first = batch.column("text")[row].as_py(), None
                    words = _WORD.findall(batch.column(f"part_{k}")[row].as_py())
                    for at, name in _listed(words, paths, ends, starts):
                        if only_first and first not in (None, at):
                            break
                        first = at
                        for column, value in zip(out, (text_key, k, at, name), strict=True):
                            column.append(value)
                        if len(out[0]) >= MAX_LISTED:
                            yield listed_so_far()
        yield listed_so_far()

    def named(rows: DataFrame, only_first: bool, how: str) -> DataFrame:
        """What may be listed names, with the displays of those that are; written, as their names are counted before."""
        schema = "text binary, part int, pos int, name string"
        listed = written(rows.mapInArrow(lambda batches: candidates(batches, only_first), schema), "listed-names")
        return lookup_join(
            listed, places.names.select("name", "display"), "name", F.struct("text", "pos"), how=how,
            known_to_fit=places.names_fit, rows_are_written=True, **places.bounds,
        )

    def answered(found: DataFrame, **more: Column) -> DataFrame:
        """One row per text; copies of a text meet as partial minima."""
        first = F.struct("pos", -F.length("name"))
        of = [(F.col("part") == k) & F.col("display").isNotNull() for k in range(len(outs))]
        return found.groupBy(F.col("text").alias("_text")).agg(
            *[F.min_by(F.when(known, F.col("display")), F.when(known, first)).alias(out) for known, out in zip(of, outs, strict=True)],
            *[column.alias(name) for name, column in more.items()],
        )

    # A place that begins where the first name may begin is the first one. Texts where that was a chance hit of the bit
    # tables are gone through again, over all names they may hold.
    texts = df.select(key.alias("text"), *[F.lower(text_or_empty(t)).alias(f"part_{k}") for k, t in enumerate(columns)])
    texts = texts.where("text IS NOT NULL")
    parts = {f"_part_{k}": F.count_if(F.col("part") == k) for k in range(len(outs))}
    early = written(answered(named(texts, True, "left"), **parts), "first-places")
    missed = reduce(or_, [(F.col(f"_part_{k}") > 0) & F.col(out).isNull() for k, out in enumerate(outs)])
    # The answers are written: the rows are then read once, beside them.
    answers = early.where(~missed).select("_text", *outs)
    again = early.where(missed).select(F.col("_text").alias("text"))
    if not again.isEmpty():
        answers = answers.unionByName(answered(named(texts.join(again, "text", "left_semi"), False, "inner")))
    # Rows without a word name no place; each has a key of its own.
    none = F.concat(F.lit("none-"), row_hash(df).cast("string")).cast("binary")
    keyed = df.withColumn("_text", F.coalesce(key, none))
    joined = lookup_join(keyed, written(answers, "found-places"), "_text", row_hash(df), **places.bounds)
    return joined.select(*df.columns, *outs)


def _digest(texts: Sequence[str]) -> Column:
    """What stands for a row's texts; NULL where none has a word."""
    any_word = F.lit(False)
    for text in texts:
        any_word = any_word | text_or_empty(text).rlike(WORD)
    whole = F.concat(*[
        F.concat(F.octet_length(text_or_empty(t)).cast("string"), F.lit(":"), text_or_empty(t)) for t in texts
    ])
    return F.when(any_word, F.unhex(F.sha2(whole, 256)))


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(f"({WORD}+)"), F.lit(1))


def lookup_name(location: str = "location") -> Column:
    """The gazetteer key of a location; NULL for unknown places."""
    name = F.lower(F.trim(location))
    return F.when(~name.isin(NO_PLACE), name)


def geocode_lookup(locations: DataFrame, gazetteer: DataFrame | Places, location: str = "location") -> DataFrame:
    """Each distinct location once, with coordinates from its own text or the gazetteer; NULL is a miss."""
    names = (
        locations.where(F.col(location).isNotNull() & ~F.lower(location).isin(NO_PLACE)).select(location).distinct()
    )
    return attach_coordinates(names, gazetteer, location, spread_by=location)


def attach_coordinates(
    df: DataFrame,
    gazetteer: DataFrame | Places,
    location: str = "location",
    spread_by: str | None = None,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    salts: int = SALTS,
    rows_are_written: bool = False,
) -> DataFrame:
    """Add ``lat`` and ``lon``: a coordinate literal as it is, a name through the gazetteer, else NULL.

    Rows are spread by a hash of all they hold, or by ``spread_by``. Rows without a name get a key of their own, so that
    unknown places do not meet in one task when the gazetteer is too large to broadcast, whatever their ids are.
    """
    ready = isinstance(gazetteer, Places)
    entries = (gazetteer.entries if ready else distinct_places(gazetteer)).select(
        F.col("place").alias("_place"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")
    )
    fit = gazetteer.entries_fit if ready else None
    if fit is None:
        fit = fits(entries if ready else gazetteer, max_broadcast_rows)
    spread = row_hash(df) if spread_by is None else F.col(spread_by)
    name = F.when(F.col("_pair").isNull(), lookup_name(location))
    # Rows that stay where they are need no key of their own.
    key = name if fit else F.coalesce(name, F.concat(F.lit("\x00"), spread.cast("string")))
    rows = df.withColumn("_pair", parse_coordinates(location)).withColumn("_place", key)
    joined = lookup_join(
        rows, entries, "_place", spread, max_broadcast_rows=max_broadcast_rows, salts=salts, known_to_fit=fit,
        rows_are_written=rows_are_written,
    )
    return joined.withColumns({
        "lat": F.coalesce("_pair.lat", "_lat"),
        "lon": F.coalesce("_pair.lon", "_lon"),
    }).drop("_pair", "_place", "_lat", "_lon")


def geocode_report(locations: DataFrame, gazetteer: DataFrame | Places, location: str = "location") -> DataFrame:
    """How many distinct names there are and how many were found."""
    return geocode_lookup(locations, gazetteer, location).agg(
        F.count(F.lit(1)).alias("total"), F.count("lat").alias("found")
    )
