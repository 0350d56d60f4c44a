"""Replies of a text service: routing, prompts, repair of JSON, and records of a declared shape."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions import schemas

#: Words that route a page to a kind of record; the first kind that matches wins.
ROUTES: dict[str, tuple[str, ...]] = {
    "Networking": ("networking",),
    "DayZero": ("day-0", "day0", "day 0", "preparatory", "pre-conference", "pre conference"),
    "LightningTalk": ("lightning", "lightning talk", "short talk", "flash talk", "5-minute"),
    "LaunchesAwards": ("launch", "award", "release", "unveil", "prize", "ceremony"),
}
#: Characters of a page in the first attempt and in later ones.
ATTEMPT_CHARS = (3500, 1800, 1800)


def route(folder: Column, text: Column, routes: Mapping[str, tuple[str, ...]] = ROUTES, default: str = "Base") -> Column:
    """The kind whose words occur in the folder's name or anywhere in the text."""
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in (folder, text)]
    out = None
    for kind, words in routes.items():
        hit = None
        for c in low:
            for w in words:
                hit = c.contains(w) if hit is None else hit | c.contains(w)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return F.lit(default) if out is None else out.otherwise(default)


def schema_text(kind: str) -> str:
    """The fields of a kind of record, for a request."""
    if kind == FLAT:
        return json.dumps({name: "list of texts" for name in FLAT_FIELDS}, indent=2)
    return json.dumps({f.name: {"str": "text", "int": "whole number or null", "list": "list of texts"}[f.type] for f in schemas.KINDS[kind]}, indent=2)


#: The flat record that is asked for with the whole text: four lists, and what belongs to each.
FLAT = "Flat"
FLAT_FIELDS = ("speakers", "organizations", "themes", "keywords")
RULES = {
    FLAT: "Under speakers name every person who speaks, moderates or gives a statement, without titles and placeholders; under organizations "
    "every company, institution, government or group; under themes one to three main subjects; under keywords the terms of the field, no everyday words.",
    "Networking": "Note how people were brought together, what they hoped for and what came of it.",
    "DayZero": "Note what the session prepares, who moderates and reports, and every goal it names.",
    "LightningTalk": "List each short talk by topic, count the talks, and sum up what was learned over all.",
    "LaunchesAwards": "Give the full name of what is launched or honoured, why, for whom and with whom.",
    "Base": "Give the session's general details.",
}


def head(kind: str) -> str:
    return f"Answer with one JSON object of these fields and nothing else.\n{schema_text(kind)}\n{RULES[kind]}\nText:\n"


def limit(kind: str, attempt: int) -> int | None:
    """Characters of a text that an attempt sends; the flat record's request sends all."""
    return None if kind == FLAT else ATTEMPT_CHARS[min(attempt, len(ATTEMPT_CHARS) - 1)]


def request(kind: str, text: str, attempt: int = 0) -> str:
    """The request for a page: the record's fields, the kind's rule and the text up to the attempt's limit."""
    return head(kind) + text[: limit(kind, attempt)]


def prompt(kind: Column, text: Column, attempt: int = 0) -> Column:
    """``request`` as a Column; null for a kind that isn't known."""
    cut = lambda k: text if limit(k, attempt) is None else F.substring(text, 1, limit(k, attempt))
    return F.coalesce(*(F.when(kind == k, F.concat(F.lit(head(k)), cut(k))) for k in RULES))


def found_in(reply: str | None) -> object:
    """What Python's own reader finds in a reply: the whole, or from its first '{' to its last '}'; ValueError if neither is JSON."""
    whole = (reply or "").strip()
    if not whole:
        raise ValueError("empty reply")
    if whole.startswith("```"):
        whole = re.sub(r"\s*```\Z", "", re.sub(r"\A```(?:json)?\s*", "", whole, flags=re.IGNORECASE)).strip()
    try:
        return json.loads(whole)
    except ValueError:
        part = re.search(r"\{.*\}", whole, re.DOTALL)
        if part is None:
            raise ValueError("no JSON in the reply") from None
        return json.loads(part[0])


def unfenced(reply: Column) -> Column:
    """A reply less the code fence around it; null if nothing is left."""
    c = F.regexp_replace(reply, r"\A(?U)[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    fenced = F.regexp_replace(F.regexp_replace(c, r"\A(?i:```(?:json)?)(?U:[\s\x1c-\x1f])*", ""), r"(?U:[\s\x1c-\x1f])*```\z", "")
    return F.nullif(F.when(c.startswith("```"), F.trim(fenced)).otherwise(c), F.lit(""))


def repaired(reply: Column) -> Column:
    """The JSON in a reply as text: the whole, or else from its first '{' to its last '}'; null if neither is JSON."""
    whole = unfenced(reply)
    part = F.nullif(F.regexp_extract(whole, r"(?s)(\{.*\})", 1), F.lit(""))
    is_json = lambda c: F.expr("true") & F.try_parse_json(c).isNotNull()
    return F.when(is_json(whole), whole).when(is_json(part), part)


def coerce(value, kind: str, default):
    """A value in the field's type as Python converts it, or the default where it can't."""
    try:
        if kind == "str":
            return default if value is None else str(value)
        if value is None or value == "":
            return default
        if kind == "int":
            return int(value)
        return [str(x) for x in value] if isinstance(value, list) else [str(value)]
    except (ValueError, TypeError):
        return default


def defaults(kind: str) -> dict:
    return {f.name: {"str": f.default, "int": None, "list": []}[f.type] for f in schemas.KINDS[kind]}


def normalised(kind: str, reply: str | None) -> dict:
    """A record of the kind: unknown fields dropped, missing ones filled; one that can't be had has its error."""
    base = defaults(kind)
    if reply is None:
        return base | {"error": "no JSON in the reply"}
    try:
        data = json.loads(reply)
        return {f.name: coerce(data.get(f.name, base[f.name]), f.type, base[f.name]) for f in schemas.KINDS[kind]} | {"error": None}
    except (AttributeError, OverflowError) as e:  # not an object; a number without bounds
        return base | {"error": f"Critical: {type(e).__name__}"}


@F.pandas_udf(schemas.TYPED_RECORD)
def normalise(kind: pd.Series, reply: pd.Series) -> pd.DataFrame:
    """The wide typed record of (kind, JSON text); Python's own conversions, which no built-in has."""
    rows = [normalised(k, r) for k, r in zip(kind, reply, strict=True)]
    limit = lambda v: v if v is None or -(1 << 63) <= v < 1 << 63 else None
    cols = {}
    for f in schemas.TYPED_RECORD.fieldNames():
        values = [r.get(f) for r in rows]
        cols[f] = pd.Series([limit(v) for v in values], dtype="Int64") if any(x.name == f and x.type == "int" for x in schemas.ALL_FIELDS) else pd.Series(values, dtype=object)
    return pd.DataFrame(cols)
