"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import checks, fingerprints, near_dedup, neighbours, packing, pieces, pii, quality, sharding, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.query,
    "op2_quality": quality.query,
    "op3_fingerprints": fingerprints.query,
    "op4_neighbours": neighbours.query,
    "op5_packing": packing.query,
    "op6_near_dedup": near_dedup.query,
    "op7_personal_data": pii.query,
    "op8_toxicity": toxicity.query,
    "op9_sentencepiece": pieces.query,
    "op10_sharding": sharding.query,
}

QUERIES |= checks.QUERIES

ORACLE_SQL: dict[str, str] = dict(checks.SQL)
