"""Record types: raw pages, extracted records, typed records by kind, and what counts as missing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

LIST = T.ArrayType(T.StringType(), False)

# The tokens read as missing. The first set is pandas' documented
# default for CSV files; the second is added to it where cleaning reads a table.
DEFAULT_NA = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
CLEANING_NA = (*DEFAULT_NA, "<null>", "Unknown")
MISSING, UNKNOWN = "N/A", "Unknown"

DOM_RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("Source_File", "Year", "Session_Type", "Title", "Themes", "Speakers_Raw", "Description")])
LLM_RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("Source_File", "Year", "Session_Type", "Title", "Themes", "Speakers", "Organizations", "Keywords", "Description")])


@dataclass(frozen=True)
class Field:
    name: str
    type: str  # str, int or list
    default: str = ""


def _fields(strings: str = "", lists: str = "", ints: str = "") -> list[Field]:
    return [Field(n, t) for names, t in ((strings, "str"), (lists, "list"), (ints, "int")) for n in names.split()]


BASE = [
    *_fields("title session_type organizers key_issues policy_recommendations", "speakers stakeholder_groups themes", "year participant_count"),
    Field("regional_focus", "str", "Global"),
]
#: The fields of every kind of record; each kind has the base fields and its own.
KINDS: dict[str, list[Field]] = {
    "Networking": [*BASE, *_fields("format networking_goals agenda collaboration_outcomes")],
    "DayZero": [*BASE, *_fields("subtheme format description onsite_moderator online_moderator rapporteur preparatory_focus", "sdgs")],
    "LightningTalk": [*BASE, *_fields("format key_takeaways", "talk_topics", "number_of_talks")],
    "LaunchesAwards": [*BASE, *_fields("initiative_or_product_name launch_purpose target_audience stakeholders_involved impact_expectation")],
    "Base": BASE,
}
ALL_FIELDS: list[Field] = list(dict.fromkeys(f for fields in KINDS.values() for f in fields))
_SPARK = {"str": T.StringType(), "int": T.LongType(), "list": LIST}
#: One wide record for all kinds: the fields that a kind lacks are null.
TYPED_RECORD = T.StructType([T.StructField(f.name, _SPARK[f.type]) for f in ALL_FIELDS] + [T.StructField("error", T.StringType())])
SECTION_METADATA = "struct<theme:string,subtheme:string,website:string,speakers:array<string>,sdgs:array<string>,format:string>"
CACHE_ENTRY = "fast_key string, hash string, seq long, result string"
