"""The registered queries of the operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from siren.llm import ppm, toxicity
from siren.llm.block_naming import exact_dedup
from siren.llm.jaccard_join import similarity_classes
from siren.llm.merkle import manifest
from siren.llm.oracles import ORACLES
from siren.llm.packing import pack
from siren.llm.perplexity import quality
from siren.llm.piece_bpe import encode_decode
from siren.llm.preferences import branched, format_preferences
from siren.llm.simhash import fingerprint_classes
from siren.llm.token_files import token_files
from siren.llm.variants import variants
from siren.llm.warc import archived

__all__ = ["ORACLES", "QUERIES"]

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What are each document's piece ids, and do they decode to it?"""
    return encode_decode(_table(spark, sf_dir, "documents"), PIECE_BPE)


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How does each conversation train against the variant that goes on like another one from one of its answers?

    The table has no preference labels. Masks are written as lengths of runs: + trained, - not.
    """

    def runs(name: str) -> Column:
        marked = F.transform(name, lambda r: F.concat(F.when(r["trained"], "+").otherwise("-"), r["chars"].cast("string")))
        return F.array_join(marked, " ").alias(name)

    pairs = format_preferences(branched(_table(spark, sf_dir, "conversations")))
    return pairs.select(
        "conv_id", "prompt_turns", "prompt", "chosen", runs("chosen_mask"), "rejected", runs("rejected_mask")
    )


def op3_perplexity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents pass the plain rules and their language's perplexity band?"""
    return quality(_table(spark, sf_dir, "documents"))


def op4_wavelet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where is each document in the token files, and what is the checksum of its tokens there?"""
    return token_files(_table(spark, sf_dir, "documents"), WORD_BPE, end_id=1)


def op5_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays of each group of equal texts?"""
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op6_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which record does each page have in the archives?"""
    return archived(_table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sequence of 4096 tokens holds each piece of each document?"""
    return pack(_table(spark, sf_dir, "documents"), WORD_BPE, end_id=2)


def op8_swapped_terms_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic is each document?"""
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which language is each document in?"""
    return ppm.identify(_table(spark, sf_dir, "documents"))


def op10_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are linked, over any number of links, by 5-word shingles at a similarity of 0.75?"""
    return similarity_classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which more frequent form does each word lead to, one edit at a time?"""
    return variants(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which leaf, proof and roots does each document have, and does its proof still hold after tampering?"""
    return manifest(_table(spark, sf_dir, "documents"))


def op13_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are linked, over any number of links, by fingerprints that differ in 3 bits at most?"""
    return fingerprint_classes(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_piece_bpe, op2_preference_format, op3_perplexity_bands, op4_wavelet_files, op5_block_naming,
        op6_zstd_warc, op7_best_fit_packing, op8_swapped_terms_toxicity, op9_ppm_language, op10_grouped_prefix_join,
        op11_spelling_variants, op12_merkle_manifest, op13_simhash_pigeonhole,
    )
} | {"pipeline": corpus_pipeline.run}
