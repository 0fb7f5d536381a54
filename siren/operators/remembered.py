"""What one run leaves for the next: fresh collections, geocoding results, ids seen before.

All three are versioned tables, so a run that fails half-way leaves what was there, and two runs at once lose nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siren.operators.collect import first_seen_order
from siren.operators.gazetteer import NO_PLACE, Places, attach_coordinates
from siren.operators.lookup import written
from siren.sources.tables import FRESH_MINUTES
from siren.sources.versioned import Version, VersionedTable

#: Folders of a table before they are made one again.
MAX_FOLDERS = 8


# -- fresh collections -----------------------------------------------------------------------------------


def collect_or_reuse(
    spark: SparkSession,
    path: str,
    collect: Callable[[], DataFrame],
    minutes: float = FRESH_MINUTES,
    force: bool = False,
    now: float | None = None,
) -> tuple[DataFrame, bool]:
    """The collection stored at ``path`` if it is younger than ``minutes``, else a new one; and whether it was reused.

    ``collect`` only runs where it is needed, or with ``force``. A new collection takes the place of the old one as a
    whole. If another run stores one meanwhile, that one is newer than what ``collect`` has seen and is kept.
    ``now`` is in seconds since 1970.
    """
    schema = VersionedTable(spark, path, "value string").current().notes.get("schema")
    found = VersionedTable(spark, path, schema or "value string")
    before = found.current()
    clock = time.time() if now is None else now
    if not force and before.number >= 0 and (clock - before.notes["collected"]) / 60 < minutes:
        return found.read(before).drop("_at"), True
    rows = collect()
    # Columns may change from one collection to the next, so each version notes its own.
    table = VersionedTable(spark, path, rows.schema)
    folder = table.stage(rows)

    def change(version: Version) -> tuple[list[str], dict] | None:
        if version.number > before.number:
            return None
        return [folder], {"collected": clock, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)}

    after = table.update(change)
    return VersionedTable(spark, path, after.notes["schema"]).read(after).drop("_at"), after.folders != [folder]


# -- geocoding -------------------------------------------------------------------------------------------

_GEOCODED = "name string, lat double, lon double, found boolean, looked_up double"


class GeocodeMemory:
    """Names that were looked up before, hits and misses alike, in a versioned table."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path, _GEOCODED)

    def known(self, version: Version | None = None) -> DataFrame:
        """(name, lat, lon, found, looked_up), the newest answer of each name."""
        rows = self.table.read(version)
        newest = F.max_by(F.struct("lat", "lon", "found", "looked_up"), F.struct("_at", "looked_up"))
        return rows.groupBy("name").agg(newest.alias("_newest")).select("name", "_newest.*")

    def lookup(
        self,
        locations: DataFrame,
        find: Callable[[DataFrame], DataFrame],
        location: str = "location",
        retry_misses_after: float | None = None,
        now: float | None = None,
    ) -> DataFrame:
        """(location, lat, lon, found) of each distinct location; ``find`` only sees names that are not known yet.

        ``find`` takes (name) and returns (name, lat, lon), with NULL for misses; names it leaves out are misses too.
        Misses are remembered, for ever or for ``retry_misses_after`` seconds. A name whose lookup fails the run is not
        stored, so the next run looks it up again.
        """
        clock = time.time() if now is None else now
        name = F.col(location)
        asked = locations.where(name.isNotNull() & ~F.lower(location).isin(NO_PLACE)).select(name.alias("name")).distinct()
        asked = written(asked, "asked")

        def change(version: Version) -> tuple[list[str], dict] | None:
            known = self.known(version)
            if retry_misses_after is not None:
                known = known.where(F.col("found") | (F.col("looked_up") > clock - retry_misses_after))
            new = written(asked.join(known.select("name"), "name", "left_anti"), "new-names")
            if new.isEmpty():
                return None
            answers = find(new).select("name", "lat", "lon").groupBy("name").agg(F.min(F.struct("lat", "lon")).alias("at"))
            rows = new.join(answers, "name", "left").select(
                "name", "at.lat", "at.lon", F.col("at.lat").isNotNull().alias("found"), F.lit(clock).alias("looked_up")
            )
            folders = [*version.folders, self.table.stage(rows)]
            if len(folders) > MAX_FOLDERS:
                folders = [self.table.stage(self.known(Version(-1, folders)))]
            return folders, {}

        after = self.table.update(change)
        found = asked.join(self.known(after), "name")
        return found.select(F.col("name").alias(location), "lat", "lon", "found")


def gazetteer_finder(gazetteer: DataFrame | Places) -> Callable[[DataFrame], DataFrame]:
    """Look names up in a gazetteer; coordinate literals are their own answer."""

    def find(names: DataFrame) -> DataFrame:
        return attach_coordinates(names, gazetteer, "name")

    return find


# -- ids seen before -------------------------------------------------------------------------------------

#: Bits of a bucket's filter for each id; 8 positions an id make one miss in some thousands.
BITS_PER_ID, POSITIONS = 16, 8
_SEEN = "key string, bucket int"
_FILTER = "bucket int, n long, bits binary"


class SeenIndex:
    """Ids of all earlier runs, by buckets, with a Bloom filter for each bucket.

    An id that its bucket's filter does not know is new without a look at the ids. Only buckets in which the filter
    knows some id are read, and only their files: the bucket is a partition column. ``buckets`` stays that of the first
    run; a bucket's share of ids should fit into a task.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.ids = VersionedTable(spark, f"{path}/ids", _SEEN, ["bucket"])
        self.filters = VersionedTable(spark, f"{path}/filters", _FILTER)

    def first_seen(self, df: DataFrame, key: str = "tweet_id") -> DataFrame:
        """The rows whose id no earlier run has seen, one for each id; their ids are seen from then on.

        Rows without an id are dropped. Of rows that repeat an id the first stays, as in ``dedup_first_seen``. Ids are
        stored before the rows are returned as a written table, so a run that fails before has changed nothing.
        """
        bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(self.buckets)).cast("int")
        first = F.row_number().over(Window.partitionBy(key).orderBy(*first_seen_order(df)))
        rows = df.where(F.col(key) != "").withColumn("_first", first).where("_first = 1").drop("_first")
        rows = written(rows.withColumn("_bucket", bucket), "asked-ids")
        out: list[DataFrame] = []

        def change(version: Version) -> tuple[list[str], dict] | None:
            asked = rows.select(F.col(key).alias("key"), F.col("_bucket").alias("bucket"))
            maybe = written(self._maybe_seen(asked, version), "maybe-seen")
            touched = [row.bucket for row in maybe.select("bucket").distinct().collect()]  # at most ``buckets``
            stored = self.ids.read(version).where(F.col("bucket").isin(touched)).select("key", "bucket")
            seen = written(maybe.join(stored, ["key", "bucket"], "left_semi").select(F.col("key").alias(key)), "seen")
            new = written(rows.join(seen, key, "left_anti"), "new-ids")
            out[:] = [new]
            added = new.select(F.col(key).alias("key"), F.col("_bucket").alias("bucket"))
            if added.isEmpty():
                return None
            folders = [*version.folders, self.ids.stage(added.repartition("bucket"))]
            if len(folders) > MAX_FOLDERS:
                merged = self.ids.read(Version(-1, folders)).drop("_at").repartition("bucket")
                folders = [self.ids.stage(merged)]
            filters = self.filters.stage(self._with(added, version))
            return folders, {"filters": filters}

        self.ids.update(change)
        return out[0].drop("_bucket")

    def touched_files(self, df: DataFrame, key: str = "tweet_id") -> list[str]:
        """Files of stored ids that ``first_seen`` would read for these rows."""
        version = self.ids.current()
        bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(self.buckets)).cast("int").alias("bucket")
        maybe = self._maybe_seen(df.select(F.col(key).alias("key"), bucket).distinct(), version)
        touched = [row.bucket for row in maybe.select("bucket").distinct().collect()]
        stored = self.ids.read(version).where(F.col("bucket").isin(touched))
        return sorted(row[0] for row in stored.select(F.input_file_name()).distinct().collect())

    def _filters_of(self, version: Version) -> DataFrame:
        folder = version.notes.get("filters")
        return self.filters.read(Version(-1, [folder] if folder else [])).drop("_at")

    def _maybe_seen(self, asked: DataFrame, version: Version) -> DataFrame:
        """The ids that their bucket's filter knows; a filter comes to the tasks that ask it."""

        def ask(key: tuple, batches: pa.Table, filters: pa.Table) -> pa.Table:
            if not filters.num_rows or not batches.num_rows:
                return pa.table({"key": pa.array([], pa.string()), "bucket": pa.array([], pa.int32())})
            bits = np.frombuffer(filters.column("bits")[0].as_py(), np.uint8)
            known = [all(bits[p >> 3] >> (p & 7) & 1 for p in row) for row in _positions(batches, len(bits))]
            return batches.select(["key", "bucket"]).filter(pa.array(known))

        hashes = [F.xxhash64("key").alias("_h"), F.xxhash64("key", F.lit(1)).alias("_g")]
        return asked.select("key", "bucket", *hashes).groupBy("bucket").cogroup(
            self._filters_of(version).groupBy("bucket")
        ).applyInArrow(ask, "key string, bucket int")

    def _with(self, added: DataFrame, version: Version) -> DataFrame:
        """The filters with more ids. A filter that gets too full is made anew, twice as large, from all ids."""
        sizes = self._filters_of(version).select("bucket", "n", F.octet_length("bits").alias("size"))
        counts = added.groupBy("bucket").agg(F.count(F.lit(1)).alias("more")).join(sizes, "bucket", "full")
        total = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))
        full = counts.select("bucket", total.alias("n"), (total * BITS_PER_ID > F.coalesce("size", F.lit(0)) * 8).alias("full"))
        full = written(full, "filter-sizes")
        again = [row.bucket for row in full.where("full").select("bucket").collect()]  # at most ``buckets``
        old = self.ids.read(version).where(F.col("bucket").isin(again)).select("key", "bucket")

        def mark(key: tuple, batches: pa.Table, filters: pa.Table) -> pa.Table:
            bits = np.frombuffer(filters.column("bits")[0].as_py(), np.uint8).copy()
            for row in _positions(batches, len(bits)):
                for p in row:
                    bits[p >> 3] |= 1 << (p & 7)
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()),
                             "n": pa.array([filters.column("n")[0].as_py()], pa.int64()), "bits": pa.array([bits.tobytes()])})

        kept = self._filters_of(version).select("bucket", "bits")
        # 2^k bytes with room for twice the ids.
        size = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("n"), F.lit(32)) * BITS_PER_ID / 8)) + 1).cast("int")
        empty = F.unhex(F.repeat(F.lit("00"), size))
        base = full.join(kept, "bucket", "left").select(
            "bucket", "n", F.when(F.col("full"), empty).otherwise(F.col("bits")).alias("bits")
        )
        marked = added.unionByName(old)
        hashes = [F.xxhash64("key").alias("_h"), F.xxhash64("key", F.lit(1)).alias("_g")]
        return marked.select("key", "bucket", *hashes).groupBy("bucket").cogroup(base.groupBy("bucket")).applyInArrow(mark, _FILTER)


def _positions(rows: pa.Table, size: int) -> np.ndarray:
    """Bit positions of each row's id in a filter of ``size`` bytes."""
    one = rows.column("_h").to_numpy().astype(np.int64).view(np.uint64)
    two = rows.column("_g").to_numpy().astype(np.int64).view(np.uint64) | np.uint64(1)
    return ((one[:, None] + np.arange(POSITIONS, dtype=np.uint64) * two[:, None]) % np.uint64(size * 8)).astype(np.int64)
