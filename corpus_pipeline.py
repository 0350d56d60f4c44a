"""From raw documents to packed sequences.

Documents that are toxic or of poor quality go, one of each class of near
duplicates stays, personal data is replaced by its kind, and what is left is
packed into sequences. Every stage's result is written to the shared folder as
Parquet and read again, so a lost executor repeats one stage's tasks at most.

Every stage takes null and empty texts (they stay, as one document once copies
go), very long ones whole, rows without ids, repeated rows (they are judged
alike, and one stays of those equal in id and text), columns of any names
(carried along by all stages but the last), and tables without rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import near_dedup, packing, pii, quality, toxicity
from loomspark.llm.common import Scratch, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.public_encoder())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_dedup", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: The stages learn from labels and follow links of any length: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that pass, in their sequences. What stages leave for one another goes at the end."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as s:
        for name, stage in STAGES[:-1]:
            docs = s.written(stage(spark, docs, sf_dir), name)
        name, stage = STAGES[-1]
        return written(stage(spark, docs, sf_dir), name)
