import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions import schemas
from loomspark.sources import boundary, files, sinks
from loomspark.streaming import resume


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write('Source_File,Year,Session_Type,Title,Themes,Speakers_Raw,Description\na,2017,Unknown,"x, ""y""\nz",N/A,<null>,null\n')
    r = files.csv_table(spark, path, schemas.DOM_RECORD).first()
    assert (r.Source_File, r.Session_Type, r.Title, r.Themes, r.Speakers_Raw, r.Description) == ("a", "Unknown", 'x, "y"\nz', None, "<null>", None)
    assert files.csv_table(spark, path, schemas.DOM_RECORD, schemas.CLEANING_NA).first().Speakers_Raw is None
    assert files.csv_or_none(spark, str(tmp_path / "none.csv"), schemas.DOM_RECORD) is None
    assert [r.Source_File for r in files.processed_names(spark, path, schemas.DOM_RECORD).collect()] == ["a"]
    assert files.processed_names(spark, str(tmp_path / "none"), schemas.DOM_RECORD).count() == 0


@pytest.fixture()
def site(tmp_path):
    for folder, name in (("data_x-2020_1", "a.html"), ("data_x-2020_1", "b.HTM"), ("igf_raw", "c.html.bak"), ("other", "d.html"), (".venv/data_y", "e.html"), ("data_x-2020_1", "f.txt")):
        os.makedirs(tmp_path / "site" / folder, exist_ok=True)
        (tmp_path / "site" / folder / name).write_bytes(f"<h1>{name}</h1>".encode() + b"\xff")
    return str(tmp_path / "site")


def test_page_scan(spark, site):
    rows = files.pages(spark, site).select("folder", "file", files.decoded(F.col("content")).alias("t")).collect()
    assert sorted((r.folder, r.file) for r in rows) == [("data_x-2020_1", "a.html"), ("data_x-2020_1", "b.HTM"), ("igf_raw", "c.html.bak")]
    assert all("�" not in r.t and r.t.endswith("</h1>") for r in rows)
    assert files.pages(spark, site, glob="*.html", folders=(), skip=()).count() == 2  # Spark passes hidden folders by


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert files.cache(spark, path).count() == 0
    sinks.swap(spark.createDataFrame([("k", "h", 1, "{}")], schemas.CACHE_ENTRY), path)
    more = files.cache(spark, path).unionByName(spark.createDataFrame([("k2", "h2", 2, "{}")], schemas.CACHE_ENTRY))
    sinks.swap(more, path)
    assert files.cache(spark, path).count() == 2
    (tmp_path / "bad").write_text("not json at all\n")
    assert files.cache(spark, str(tmp_path / "bad")).count() == 0
    assert [r.line for r in files.cache_faults(spark, str(tmp_path / "bad")).collect()] == ["not json at all"]
    os.rename(path, path + sinks.ASIDE)  # a swap that broke off in the middle
    assert files.cache(spark, path).count() == 2
    sinks.swap(files.cache(spark, path), path)
    assert files.cache(spark, path).count() == 2 and not os.path.exists(path + sinks.ASIDE)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", ["x", "y"], 1), ("a", [], 2)], T.StructType([T.StructField("n", T.StringType()), T.StructField("l", T.ArrayType(T.StringType())), T.StructField("i", T.IntegerType())]))
    sinks.csv_table(df, str(tmp_path / "c"), "n")
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True).orderBy("n").collect()] == [("a", "N/A", "2"), ("b", "x | y", "1")]
    assert sinks.csv_file(df, str(tmp_path / "c.csv"), "n") == 2
    assert (tmp_path / "c.csv").read_bytes().startswith(b"\xef\xbb\xbfn,l,i")
    assert sinks.json_file(df.withColumn("e", F.lit("é")), str(tmp_path / "c.json")) == 2
    assert "é" in (tmp_path / "c.json").read_text(encoding="utf-8") and json.loads((tmp_path / "c.json").read_text())[0]["l"] == ["x", "y"]
    sinks.json_table(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    for _ in range(2):
        sinks.checkpoint(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    with pytest.raises(ValueError):
        sinks.csv_file(df, str(tmp_path / "d.csv"), limit=1)


def test_fetching(spark, tmp_path):
    urls = spark.createDataFrame([("u1", "a.html"), ("u2", "b.html"), ("bad", "c.html")], "url string, file string")

    def fetch(url):
        if url == "bad":
            raise OSError("gone")
        return f"<p>{url}</p>"

    got = boundary.fetched(urls, fetch, at_once=2)
    existing = spark.createDataFrame([("a.html",)], "file string")
    fresh = sinks.new_pages(got, existing)
    sinks.page_files(fresh, str(tmp_path / "pages"))
    assert os.listdir(tmp_path / "pages") == ["b.html"] and (tmp_path / "pages" / "b.html").read_text() == "<p>u2</p>"
    assert [tuple(r) for r in sinks.quarantine(got).collect()] == [("bad", "OSError: gone")]


def test_extraction(spark):
    """A service that answers well, in fences, in prose, with an array, with nothing, and with an error."""
    rows = [(k, "Base", k) for k in ("good", "fenced", "prose", "array", "empty", "words", "status", "raise", "odd")]
    pages = spark.createDataFrame(rows, "key string, kind string, text string")

    def service(prompt):
        word = prompt.rsplit("\n", 1)[-1]
        if word == "raise":
            raise TimeoutError("late")
        if word == "odd":
            raise KeyError("odd")
        body = '{"title": "T"}'
        return (500 if word == "status" else 200), {"good": body, "fenced": f"```json\n{body}\n```", "prose": f"Sure: {body}.", "array": "[1]", "empty": " ", "words": "sorry, no json"}.get(word, body)

    got = {r.key: r for r in boundary.records(boundary.extracted(pages, service, at_once=2, pause=0.0)).collect()}
    assert all(got[k].title == "T" and got[k].error is None for k in ("good", "fenced", "prose"))
    assert got["array"].error == "Critical: AttributeError" and got["empty"].error == got["words"].error == "failed after retries: ValueError"
    assert got["status"].error == "status 500" and got["raise"].error == "failed after retries: TimeoutError" and got["raise"].regional_focus == "Global"
    assert got["odd"].error == "Critical: KeyError"
    calls = {r.key: r.calls for r in boundary.extracted(pages, service, pause=0.0).collect()}
    assert calls == {"good": 1, "fenced": 1, "prose": 1, "array": 1, "empty": 3, "words": 3, "status": 3, "raise": 3, "odd": 1}


def test_stream_resumes_by_content(spark, site, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    process = lambda df: df.select("hash", F.length("content").alias("n"))
    run = lambda: resume.extract_stream(resume.page_stream(spark, site, per_batch=2), process, out, check).awaitTermination()
    run()
    n = spark.read.parquet(out).count()
    assert n == spark.read.parquet(out).select("hash").distinct().count() == 4
    (tmp_path / "site" / "other" / "g.html").write_bytes((tmp_path / "site" / "other" / "d.html").read_bytes())
    (tmp_path / "site" / "other" / "h.html").write_bytes(b"new")
    run()
    assert spark.read.parquet(out).count() == n + 1


def test_stream_deals_a_small_batch_to_few_tasks(spark, site, tmp_path):
    """Each task commits a part of the state in every batch, so that their number makes the cost of a batch; the session keeps its settings."""
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.minPartitionNum")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        resume.extract_stream(resume.page_stream(spark, site, per_batch=2), lambda df: df.select("hash"), out, check).awaitTermination()
        assert (spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.files.minPartitionNum", None)) == ("9", held["spark.sql.files.minPartitionNum"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held["spark.sql.shuffle.partitions"])
    assert len([d for d in os.listdir(f"{check}/state/0") if d.isdigit()]) == 4
    assert spark.read.parquet(out).distinct().count() == spark.read.parquet(out).count() == 4
