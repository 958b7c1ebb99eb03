"""Five stages from raw documents to packed sequences, each one table to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postweave.llm import line_rules, mixing, packing, secret_scan, simhash
from postweave.session import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the frequent lines of the others are cut out."""
    return line_rules.clean(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts within two bits of SimHash stays, the smallest id."""
    return simhash.first_of_groups(spark, docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to the weights of their sources, in random order."""
    return mixing.replicate(spark, docs, keep=True).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all copies with their sequence and place."""
    return packing.packed(spark, docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secrets),
    ("source_mix", mix),
    ("packing", pack),
]

# Token ids and shingle hashes have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on all that the one before it kept, each stored in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
