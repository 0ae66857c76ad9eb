"""Registered queries of the training-data operators, with their SQL twins.

Each query applies its operator, with production parameters, to its whole
table and returns the full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontam, langid, line_dedup, lm_score, merkle, mixing, near_dup, periodic_runs, quality_model, quality_rules,
               token_counts, token_files, toxicity)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "coverage", "n_tiles", F.lit(True).alias("contaminated"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_table(token_counts.length_histogram(table(spark, sf_dir, "documents")))


def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_dups(table(spark, sf_dir, "documents")).drop("text_hash")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered())
    return d.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True, full=False)


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_language_id, op3_quality_rules, op4_quality_classifier, op5_decontaminate,
    op6_token_counts, op7_near_dups, op8_line_dedup, op9_lm_score, op10_toxicity, op11_merkle_manifest,
    op12_token_files, op13_periodic_runs)}
ORACLE: dict[str, str] = {"op3_quality_rules": quality_rules.ORACLE_SQL, "op8_line_dedup": line_dedup.ORACLE_SQL,
                          "op11_merkle_manifest": merkle.ORACLE_SQL}
