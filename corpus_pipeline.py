"""Corpus preparation: quality rules, line dedup, near-duplicate removal, mixing, packing.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of
``documents``. A document that a stage drops is not seen by later ones: rejected by the quality rules, not the first of
its group of near duplicates, or not drawn into the mixture. Lines that line dedup drops are gone from the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import jaccard_join, line_dedup, mixing, packing, quality_rules
from tidewatch.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and are no outliers of their language and source."""
    return quality_rules.reject_outliers(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; their length is counted anew.

    The ratio alone decides, on sites of any size; a line on one page only is that page's own text.
    """
    return line_dedup.drop_boilerplate(docs, min_pages=2).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group whose sets of five-word shingles have a similarity of 0.8 or more."""
    return jaccard_join.drop_near_duplicates(docs, shingle=5, pct=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have the target weights."""
    return mixing.sample(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their place in sequences of 1024 tokens."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("mixing", mixture), ("packing", sequences),
]

#: Outlier estimates, near-duplicate groups and packing are not one SQL query; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
