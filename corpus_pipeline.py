"""Documents to token records: quality rules, near-dedup, decontamination, mixing, records.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents; the last returns one row per record written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from specmint.llm.decontaminate import decontamination_stage
from specmint.llm.mixing import mixing_stage
from specmint.llm.quality_rules import quality_stage
from specmint.llm.records import token_records_stage
from specmint.llm.simhash import drop_near_duplicates
from specmint.shipping import ship
from specmint.storage import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules or the likelihood ratio reject go."""
    ship(spark)
    return quality_stage(spark, docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component stays."""
    ship(spark)
    return drop_near_duplicates(spark, docs, sf_dir)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    ship(spark)
    return decontamination_stage(spark, docs, sf_dir)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as many times as the mix takes them."""
    ship(spark)
    return mixing_stage(spark, docs, sf_dir)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row in binary records, read back."""
    ship(spark)
    return token_records_stage(spark, docs, sf_dir)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_records", token_records),
]

#: Fingerprints, template windows and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
