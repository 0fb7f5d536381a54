"""Plan building blocks: size-checked lookup joins, columns computed once, derived tables written once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siren.session import new_path

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32
#: Rows of one key beyond which it is dealt over several tasks.
HOT_ROWS = 100_000
#: Rows of a piece of a scan, for work that is heavy per row: seconds to a minute of it.
ROWS_PER_TASK = 100_000


def fits(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether a table has at most ``max_rows`` rows and ``max_bytes`` of values, by sums of each task; no row moves."""
    size = sum((_bytes_of(name, kind) for name, kind in df.dtypes), F.lit(8).cast("long"))
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return row["rows"] <= max_rows and row["bytes"] <= max_bytes


def _bytes_of(name: str, kind: str) -> Column:
    """About how many bytes a value takes."""
    column = F.col(f"`{name}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    nested = any(word in kind for word in ("array", "map", "struct", "variant"))
    return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) if nested else F.lit(16)


def _few_keys(rows: DataFrame, on: str, max_keys: int) -> bool:
    """Whether the different keys of some rows can be broadcast, by a sketch; no row moves."""
    size = _bytes_of(on, dict(rows.dtypes)[on])
    seen = rows.agg(F.approx_count_distinct(on, 0.02).alias("keys"), F.coalesce(F.max(size), F.lit(0)).alias("bytes")).first()
    return seen["keys"] <= max_keys and seen["keys"] * seen["bytes"] <= MAX_BROADCAST_BYTES


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's own values, for salts: a task that is run again sends each row to the same place."""
    return F.xxhash64(*[name for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind])


def computed_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns as generated attributes, through an ``inline`` of one element.

    Spark moves a filter on a projected column below the projection by repeating the column's expression; for
    columns that take dozens of text searches that costs more than it saves, and may outgrow generated code. A
    filter on a generated column stays above it, while filters on other columns still move down to the scan. The
    expressions themselves stay in a projection, which evaluates what they share once.
    """
    computed = df.withColumns({f"_once_{name}": column for name, column in columns.items()})
    generated = F.inline(F.array(F.struct(*[F.col(f"_once_{name}").alias(name) for name in columns])))
    return computed.select(*df.columns, generated)


def written(df: DataFrame, name: str) -> DataFrame:
    """A derived table written to the shared folder and read back, so that later uses do not compute it again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Give a scan that has fewer pieces than there are cores, or than its rows ask for, to more tasks; leave any other as it is.

    For tables in a few files, or in a few large row groups, which cannot be split, read by work that is heavy per row.
    Small rows make few pieces however many they are; counting them reads the files' footers only. Only pieces that hold
    rows count: a scan cuts files by bytes, but a row group goes to one of its pieces whole.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    seen = df.select(F.spark_partition_id().alias("piece")).agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("piece", 0.01).alias("pieces")
    ).first()
    wanted = max(min(cores, seen["n"]), -(-seen["n"] // rows_per_task))
    return df if seen["pieces"] >= 0.95 * wanted else df.repartition(max(cores, wanted), *key)


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: str,
    spread_by: str | Column,
    how: str = "left",
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    salts: int = SALTS,
    bounded_by: DataFrame | None = None,
    known_to_fit: bool | None = None,
    rows_are_written: bool = False,
) -> DataFrame:
    """Join rows to a lookup table that has unique values of ``on``.

    A lookup of checked size (rows and bytes) is broadcast and the rows stay where they are. Beyond that both are shuffled, and
    keys of more than ``HOT_ROWS`` rows get up to ``salts`` salt values, so that a key holding a third of the rows is spread
    over as many tasks; only these keys' lookup rows are repeated, so the lookup is moved about once however large it is.
    The salt is a hash of ``spread_by``, not a random number: a task that is run again must send each row to the same place.
    The rows' keys are counted first, so rows that cost much are better written before. ``bounded_by`` is a table the lookup
    has no more rows than, and is cheaper to count; ``known_to_fit`` tells what a check before has found. ``rows_are_written``
    tells that rows are cheap to read: if they have few different keys, only the lookup rows of these are taken, where they are.
    """
    columns = rows.columns + [name for name in lookup.columns if name != on]
    if known_to_fit is None:
        known_to_fit = fits(lookup if bounded_by is None else bounded_by, max_broadcast_rows)
    if not known_to_fit and rows_are_written and _few_keys(rows, on, max_broadcast_rows):
        asked = F.broadcast(rows.select(on).distinct())
        lookup = written(lookup.join(asked, on, "left_semi"), "asked-for")
        known_to_fit = fits(lookup, max_broadcast_rows)
    if known_to_fit:
        return rows.join(F.broadcast(lookup), on, how).select(*columns)
    counted = rows.groupBy(F.col(on).alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS)
    parts = F.least(F.ceil(F.col("_n") / HOT_ROWS), F.lit(salts)).cast("int")
    hot = F.broadcast(counted.select("_hot", parts.alias("_salts")))
    salts_of = F.coalesce("_salts", F.lit(1))
    is_hot = F.col(on).eqNullSafe(F.col("_hot"))
    salted_rows = rows.join(hot, is_hot, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), salts_of).cast("int"))
    salted_lookup = lookup.join(hot, is_hot, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts_of - 1)))
    return salted_rows.drop("_hot", "_salts").join(salted_lookup.drop("_hot", "_salts"), [on, "_salt"], how).select(*columns)
