import json

import pytest
from pyspark.sql import functions as F

from loomspark.functions import jsonx, schemas


@pytest.mark.parametrize(
    "reply,want",
    [('{"a":1}', 1), ('```json\n{"a":1}\n```', 1), ('```\n{"a":1}```', 1), ('```JSON {"a":1} ```', 1), ('Sure: {"a":1} bye', 1), ("  ", None), ("", None), (None, None), ("no json", None), ('{"a":', None)],
)
def test_repair(spark, reply, want):
    got = spark.createDataFrame([(reply,)], "r string").select(jsonx.repaired(F.col("r")).alias("x")).first().x
    assert (None if got is None else json.loads(got)["a"]) == want


def test_arrays_are_json_but_no_record(spark):
    got = spark.createDataFrame([("[1]",)], "r string").select(jsonx.repaired(F.col("r")).alias("x")).first().x
    assert json.loads(got) == [1]
    assert jsonx.normalised("Base", got)["error"] == "Critical: AttributeError"
    assert jsonx.normalised("Base", '{"year": Infinity}')["error"] == "Critical: OverflowError"


@pytest.mark.parametrize("raw,want", [("12", 12), (" 12 ", 12), ("1_000", 1000), (12.7, 12), (True, 1), ("12.0", None), ("1,000", None), ("", None), ([1], None), (None, None)])
def test_int(raw, want):
    assert jsonx.coerce(raw, "int", None) == want


def test_other_types():
    assert jsonx.coerce(None, "str", "Global") == "Global" and jsonx.coerce(True, "str", "") == "True" and jsonx.coerce(["a"], "str", "") == "['a']"
    assert jsonx.coerce("x", "list", []) == ["x"] and jsonx.coerce([1, "b"], "list", []) == ["1", "b"] and jsonx.coerce("", "list", []) == []


def test_records(spark):
    rows = [("Base", '{"title": "T", "error": "mine", "nope": 1}'), ("LightningTalk", '{"number_of_talks": "3", "talk_topics": "x"}'), ("DayZero", None), ("Base", "[1]"), ("Base", '{"year": 99999999999999999999}')]
    out = spark.createDataFrame(rows, "k string, r string").select(jsonx.normalise("k", "r").alias("t")).select("t.*").collect()
    assert out[0].title == "T" and out[0].error is None and out[0].regional_focus == "Global" and out[0].number_of_talks is None
    assert out[1].number_of_talks == 3 and out[1].talk_topics == ["x"] and out[1].networking_goals is None
    assert out[2].error == "no JSON in the reply" and out[2].sdgs == [] and out[3].error.startswith("Critical") and out[4].year is None


def test_shapes():
    assert {k: len(v) for k, v in schemas.KINDS.items()} == {"Networking": 15, "DayZero": 19, "LightningTalk": 15, "LaunchesAwards": 16, "Base": 11}
    assert len(schemas.ALL_FIELDS) == 30


@pytest.mark.parametrize(
    "folder,text,kind",
    [("data_networking-2021", "an award", "Networking"), ("x", "Day 0 networking", "Networking"), ("x", "a press release", "LaunchesAwards"), ("x", "y", "Base"), ("Day0", None, "DayZero"), (None, "Flash Talk", "LightningTalk")],
)
def test_routes(spark, folder, text, kind):
    df = spark.createDataFrame([(folder, text)], "f string, t string")
    assert df.select(jsonx.route(F.col("f"), F.col("t")).alias("k")).first().k == kind


def test_prompts_are_cut(spark):
    df = spark.createDataFrame([("DayZero", "z" * 5000)], "k string, t string")
    first, later = (df.select(jsonx.prompt(F.col("k"), F.col("t"), n).alias("p")).first().p for n in (0, 1))
    assert first.count("z") - later.count("z") == 1700 and "preparatory_focus" in first
