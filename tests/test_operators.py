import pytest
from pyspark.sql import functions as F

from loomspark.operators import clean, frequency as fq, incremental as inc


@pytest.fixture(scope="module")
def sessions(spark):
    rows = [(2019, ["B", "A"]), (2019, ["A"]), (2019, ["C"]), (2019, ["D"]), (2021, ["B"]), (None, ["A"])]
    return spark.createDataFrame(rows, "Year int, Orgs array<string>")


def test_yearly_top_and_matrix(sessions):
    dated = sessions.where("Year is not null")
    assert sorted(map(tuple, fq.yearly_top(dated, "Orgs", "Org", 3).collect())) == [(2019, 1, "A", 2), (2019, 2, "B", 1), (2019, 3, "C", 1), (2021, 1, "B", 1)]
    m = {(r.Org, r.Year): r.Frequency for r in fq.matrix(sessions, "Orgs", "Org", 2).collect()}
    assert m == {("A", 2019): 2, ("A", 2020): 0, ("A", 2021): 0, ("B", 2019): 1, ("B", 2020): 0, ("B", 2021): 1}
    line = {r.Year: r.line for r in fq.top_lines(fq.yearly_top(dated, "Orgs", "Org", 3), "Org").collect()}
    assert line[2019] == "No.1 A (2)  |  No.2 B (1)  |  No.3 C (1)"
    assert {r.Org: r.Frequency for r in fq.frequencies(sessions, "Orgs", "Org").collect()}["A"] == 3  # undated rows count here


def test_top_partner(spark):
    df = spark.createDataFrame([(["S1"], ["O1", "O2"]), (["S1", "S2"], ["O1"]), (["S3"], [])], "Speakers array<string>, Orgs array<string>")
    got = sorted((r.Speaker, r.Frequency, r.Top) for r in fq.with_top_partner(df, "Speaker", "Org", "Top").collect())
    assert got == [("S1", 2, "O1"), ("S2", 1, "O1"), ("S3", 1, "(Unknown)")]


def test_rankings_weigh_pairs(spark):
    rows = [(2020, ["X"], ["a", "b", "c"]), (2020, ["Y"], ["a"]), (2021, ["Y"], ["b"])] + [(2020, ["Z"], [])] * 5
    df = spark.createDataFrame(rows, "Year int, Orgs array<string>, Themes array<string>")
    pairs = fq.exploded(df, {"Orgs": "Org", "Themes": "Theme"}, "Year")
    assert {r.Org: r.Frequency for r in fq.value_counts(pairs, "Org").collect()} == {"X": 3, "Y": 2}
    shift = fq.topic_shifts(df, "Org", 1, "Theme", 2).collect()
    assert sorted((r.Org, r.Theme, r.Year, r.Frequency) for r in shift) == [("X", "a", 2020, 1), ("X", "a", 2021, 0), ("X", "b", 2020, 1), ("X", "b", 2021, 0)]
    best = fq.primary_by_year(df.withColumnRenamed("Themes", "Topics"), "Org", 2, "Topic").collect()
    assert sorted((r.Year, r.Org, r.Topic, r.Session_Count) for r in best) == [(2020, "X", "a", 1), (2020, "Y", "a", 1), (2021, "Y", "b", 1)]


@pytest.mark.parametrize("labels,want", [({"a": 97, "b": 2, "c": 1}, {"a": 97, "Others": 3}), ({"Others": 50, "a": 50, "b": 1}, {"a": 50, "Others": 51})])
def test_shares(spark, labels, want):
    df = spark.createDataFrame([(k,) for k, n in labels.items() for _ in range(n)] + [(None,)], "t string")
    assert {r.t: r.Frequency for r in fq.shares(df, "t").collect()} == want


def test_clean(spark):
    fields = "Source_File string, Year string, Session_Type string, Title string, Themes string, Speakers_Raw string, Description string"
    rows = [("1", "Unknown", "x", "T", "a", "b", "d"), ("2", "2017", "x", "N/A", "a", "b", "d"), ("3", "2017.0", "Unknown", "T", "", "<null>", None), ("4", "2018", "w", "T", "a | b", "S | S", "d")]
    got = {r.Source_File: r for r in clean.clean_sessions(spark.createDataFrame(rows, fields)).collect()}
    assert set(got) == {"3", "4"}
    a = got["3"]
    assert (a.Year, a.Session_Type, a.Themes, a.Speakers_Raw, a.Description) == (2017, None, "Uncategorized", "Not_Specified", "No description available.")
    assert a.Speakers_List == ["Not_Specified"] and got["4"].Speakers_List == ["S"] and got["4"].Themes_List == ["a", "b"]
    dropped = clean.clean_sessions(spark.createDataFrame(rows, fields), drop_placeholders=True).where("Source_File = '3'").first()
    assert dropped.Speakers_List == []
    with pytest.raises(Exception):
        clean.clean_sessions(spark.createDataFrame([("1", "twenty", "x", "T", "a", "b", "d")], fields)).collect()


def test_cache_and_outcomes(spark):
    """A and D are known by their keys, B is new with A's content, C is new and fails."""
    files = spark.createDataFrame([("A", "ha"), ("B", "ha"), ("C", "hc"), ("D", "hd")], "fast_key string, hash string")
    cache = spark.createDataFrame([("A", "ha"), ("D", "hd")], "fast_key string, hash string")
    hits, aliases, rest = inc.split_by_cache(files, cache)
    assert sorted(r.fast_key for r in hits.collect()) == ["A", "B", "D"]
    assert [r.fast_key for r in aliases.collect()] == ["B"] and [r.fast_key for r in rest.collect()] == ["C"]
    results = hits.select("fast_key", F.lit(None).cast("string").alias("error")).unionByName(rest.select("fast_key", F.lit("bad").alias("error")))
    r = inc.outcomes(files, results, ["fast_key"], F.col("error").isNotNull()).first()
    assert (r.scanned, r.succeeded, r.failed, r.missing, r.success_rate) == (4, 3, 1, 0, 75.0)
    none = inc.outcomes(files.limit(0), results, ["fast_key"], F.col("error").isNotNull()).first()
    assert none.scanned == 0 and none.success_rate == 0.0


def test_latest_outcome(spark):
    old = spark.createDataFrame([("k", 1, "old1"), ("k", 2, "old2"), ("m", 1, "m1"), ("m", 2, "m2")], "key string, seq int, v string")
    new = spark.createDataFrame([("k", 1, "new1"), ("k", 2, "new2")], "key string, seq int, v string")
    assert {r.key: r.v for r in inc.latest(old, new, ["key"]).collect()} == {"k": "new2", "m": "m1"}


def test_pending_by_two_keys(spark):
    files = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], "name string, hash string")
    known = spark.createDataFrame([("a", None), (None, "h2")], "name string, hash string")
    assert [r.name for r in inc.pending(files, known, "name", "hash").collect()] == ["c"]
