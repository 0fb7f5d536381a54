"""From raw documents to packed training sequences: five stages, each over all rows that its predecessor kept.

Counted as part of ``siren.llm``. A stage takes (spark, docs, sf_dir) and returns a table that is written and read again
as the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siren.llm import ppm, toxicity
from siren.llm.block_naming import exact_dedup
from siren.llm.jaccard_join import similarity_classes
from siren.llm.packing import pack
from siren.llm.rows import written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _only(docs: DataFrame, kept: DataFrame, text_key: str, key: Column) -> DataFrame:
    """The documents named by (doc_id, ``text_key``), once each: rows that repeat an id with its text are one document.

    Rows without an id have a key of their own, so that they are found too.
    """
    keyed = docs.withColumns({"_id": F.coalesce("doc_id", F.lit(-1)), "_none": F.col("doc_id").isNull(), "_key": key})
    kept = kept.select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_none"),
                       F.col(text_key).alias("_key")).distinct()
    found = keyed.join(kept, ["_id", "_none", "_key"], "left_semi").dropDuplicates(["_id", "_none", "_key"])
    return found.select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models of all languages tell."""
    return ppm.accepted(docs)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    kept = exact_dedup(docs).where("kept").select("doc_id", F.unhex("text_sha256").alias("_sha"))
    lowered = F.translate(F.coalesce("text", F.lit("")), _UPPER, _UPPER.lower())
    return _only(docs, kept, "_sha", F.unhex(F.sha2(lowered, 256)))


def distinct_sets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    classes = written(similarity_classes(docs), "similar")
    first = classes.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "uid", "text_hash")).alias("_first")
    )
    kept = first.select("_first.doc_id", "_first.text_hash")
    return _only(docs, kept, "text_hash", F.xxhash64("text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence and place of each piece of each document."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("harmless", harmless),
    ("distinct_texts", distinct_texts),
    ("distinct_sets", distinct_sets),
    ("packed", packed),
]

#: SQL has neither the models nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
