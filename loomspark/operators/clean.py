"""Cleaning of extracted records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text
from loomspark.functions.schemas import CLEANING_NA

#: What stands for a missing field.
FILLS = {"Speakers_Raw": "Not_Specified", "Themes": "Uncategorized", "Description": "No description available."}


def null_missing(df: DataFrame, tokens: tuple[str, ...] = CLEANING_NA) -> DataFrame:
    """Strings that stand for a missing value become null, in every string column."""
    kinds = dict(df.dtypes)
    return df.select(*(F.when(~F.col(c).isin(*tokens), F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in df.columns))


def clean_sessions(records: DataFrame, synonyms: Mapping[str, str] | None = None, drop_placeholders: bool = False) -> DataFrame:
    """Records with a year and a title, gaps filled, years whole numbers, and lists of speakers and themes.

    A year that isn't a number ends the query, as it would corrupt every trend.
    """
    kept = null_missing(records).na.drop(subset=["Year", "Title"]).na.fill(FILLS)
    out = kept.withColumn("Year", text.must_be_int(F.col("Year")))
    for source, target in (("Speakers_Raw", "Speakers_List"), ("Themes", "Themes_List")):
        items = text.normalise_list(F.col(source), synonyms)
        out = out.withColumn(target, F.array_remove(items, FILLS[source]) if drop_placeholders else items)
    return out
