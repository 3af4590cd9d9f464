"""The registered queries of this subpackage: each operator over its whole table, reduced to its digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotelspark.llm import (
    ann, caps, language, manifest, mixing, packing, quality, repair, sharding, simhash, substrings, suffixes, toxicity,
)
from hotelspark.llm.common import table
from hotelspark.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40).withColumns(
        {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select("doc_id", quality.held_out(5, 0).alias("held_out"), "score", "predicted")


def op4_byte_position_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).drop("k0", "k1")


def op6_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_columnwise_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.measure_repeats(table(spark, sf_dir, "documents"))


def op8_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = language.learn(docs)
    found = language.identify(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", quality.held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op9_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.with_repeats(table(spark, sf_dir, "documents"))


def op10_prefix_sum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_incremental_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op12_lightest_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op13_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.learn_and_score(docs, table(spark, sf_dir, "labels")).select("doc_id", quality.held_out(5, 0).alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (
    op1_virtual_slots, op2_learned_partitions, op3_quadratic_discriminant, op4_byte_position_simhash, op5_sum_of_squares_packing,
    op6_spherical_caps, op7_columnwise_suffixes, op8_hyperdimensional_language, op9_fixed_block_anchors, op10_prefix_sum_mixing,
    op11_incremental_witnesses, op12_lightest_derivation, op13_weak_supervision)}
