"""A corpus pipeline over ``documents``: each stage works on all rows that the one before it kept.

Quality rejection, exact dedup, near dedup (five-word shingles, similarity 0.8), removal of repeated
substrings, packing. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellframe.llm import exact_dedup, jaccard_join, packing, quality, scratch, substring_dedup
from cellframe.session import ship


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_duplicates(docs, n=5, percent=80)


def remove_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_substrings(docs, length=50)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, with_ids=True)


STAGES = [
    ("quality", reject_low_quality),
    ("exact_dedup", drop_exact_duplicates),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeated_substrings),
    ("packing", pack),
]

#: SQL has no classifier fitted on labels, connected components or tokenizer: stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        table = scratch.Table(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:  # nothing reads a stage's rows once the next one is written
            before.drop()
        docs, before = table.df, table
    return docs
