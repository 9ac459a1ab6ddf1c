"""The corpus queries that the driver contract adds to the others."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import (
    centroid_clustering, embedding_dedup, exact_search, jaccard_join, language_id, line_dedup, merkle_manifest, mixing, packing, pii, quality_rules,
    token_counts, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.query,
    "op2_toxicity": toxicity.query,
    "op3_token_counts": token_counts.query,
    "op4_language_id": language_id.query,
    "op5_packing": packing.query,
    "op6_embedding_dedup": embedding_dedup.query,
    "op7_line_dedup": line_dedup.query,
    "op8_quality_rules": quality_rules.query,
    "op9_mixing": mixing.query,
    "op10_jaccard_join": jaccard_join.query,
    "op11_merkle_manifest": merkle_manifest.query,
    "op12_centroid_clustering": centroid_clustering.query,
    "op13_exact_search": exact_search.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str | None] = {
    "op7_line_dedup": line_dedup.ORACLE_SQL,
    "op11_merkle_manifest": merkle_manifest.ORACLE_SQL,
    "op12_centroid_clustering": centroid_clustering.ORACLE_SQL,
    "op13_exact_search": exact_search.ORACLE_SQL,
    "pipeline": corpus_pipeline.ORACLE_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in ORACLES.items() if sql}
