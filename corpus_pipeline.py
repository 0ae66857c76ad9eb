"""Corpus pipeline: documents -> cleaned, deduplicated, decontaminated, mixed.

Every stage gets all that its predecessor kept and is written before the next
one reads it.  All stages but the last return the columns of ``documents``.
Null and empty texts fall to the quality rules; an empty table runs through;
further columns of ``documents`` are carried along."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrisk.llm import decontam, line_dedup, mixing, near_dup, quality_rules
from stayrisk.llm.common import scratch
from stayrisk.session import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects (operator 3)."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents repeat (operator 8);
    ``n_chars`` follows the text, other columns stay."""
    d = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return d


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (operator 7)."""
    return near_dup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks (operator 5)."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their copies (operator 1)."""
    return mixing.mix(docs).filter("copies > 0")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dups", near_duplicates),
    ("decontamination", decontaminate),
    ("mix_sources", mix),
]

# The rounding of the last stage is a hash-driven tournament, which SQL cannot
# express; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn.  Each is written to the shared folder; the scratch
    tables of its operator are deleted once it is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
