"""The queries of the training-data operators, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, chaining, decontaminate, divergence, mixing, packing, pii, quality, simhash, topk, unigram, whitening
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component of every document: 4-word shingles, links within 4 bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, budget=4)
    return found.select(F.col("id").alias("doc_id"), simhash.hexadecimal("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op2_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth embedding against all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds at least 0.8 of the five-word shingles of a benchmark item, with the item."""
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log weight of every document, its sampling key and whether it is kept."""
    return quality.sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed lines of 2048 token ids."""
    return binary.packed(table(spark, sf_dir, "documents"))


def op6_chained_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat across documents, exactly or with edits; a row for either document of a link."""
    return chaining.by_document(chaining.repeats(table(spark, sf_dir, "documents")))


def op7_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes, in sequences of at most 1024 tokens."""
    found = packing.pack(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)
    return found.withColumnRenamed("id", "doc_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the best unigram segmentation of every document."""
    return unigram.count_tokens(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, and all spans."""
    return pii.find(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and subword lattice score of every document."""
    return unigram.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_digit_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every embedding, by an exact covariance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16, scale=64.0, offset=1_000_000)


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words a mix of the sources by weights 3, 1, 2 takes of every document."""
    return mixing.mixed(table(spark, sf_dir, "documents"), weights=(3, 1, 2), budget=1.5, most=2)


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ from each other, and the terms that each has more of."""
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=10, top=10)


QUERIES: dict[str, Query] = {
    "op1_simhash_neardup": op1_simhash_neardup,
    "op2_pivot_topk": op2_pivot_topk,
    "op3_decontamination": op3_decontamination,
    "op4_importance_resampling": op4_importance_resampling,
    "op5_packed_ids": op5_packed_ids,
    "op6_chained_repeats": op6_chained_repeats,
    "op7_lp_packing": op7_lp_packing,
    "op8_token_counts": op8_token_counts,
    "op9_pii_spans": op9_pii_spans,
    "op10_lattice_lm": op10_lattice_lm,
    "op11_digit_whitening": op11_digit_whitening,
    "op12_source_mix": op12_source_mix,
    "op13_divergence_audit": op13_divergence_audit,
}

#: DuckDB SQL where it can express a query; the others are tested against brute force.
ORACLE: dict[str, str] = {
    "op2_pivot_topk": topk.TOP_K_SQL,
    "op3_decontamination": decontaminate.CONTAINED_SQL,
    "op12_source_mix": mixing.MIXED_SQL,
    "op13_divergence_audit": divergence.AUDIT_SQL,
}
