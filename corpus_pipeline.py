"""A training corpus from raw documents.

Each stage's rows are written as Parquet and read again by the next. The first
four return the columns of ``documents``; the last returns what the mix takes
of each document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm.common import table
from tabloom.llm.decontamination import decontaminate_stage
from tabloom.llm.mixing import mix_sources
from tabloom.llm.pii import pii_stage
from tabloom.llm.quality_rules import quality_stage
from tabloom.llm.simhash import dedup_stage
from tabloom.session import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail are taken out; documents that lose too much of their text go."""
    return quality_stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return dedup_stage(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate_stage(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by marks."""
    return pii_stage(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, and its source's target."""
    return mix_sources(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("pii", redact),
    ("mixing", mix),
]

#: SQL can't express the latent search, the boosted trees and the 64-bit hashes
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
