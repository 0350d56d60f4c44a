import pytest
from pyspark.sql import functions as F

from loomspark.functions import schemas
from loomspark.plans import extraction
from loomspark.sources import files

PAGE = "<h1>{}</h1><div class='field-name-field-speakers'><a>Jane Doe</a></div><p>Theme: Access</p>"


@pytest.fixture()
def pages(spark, tmp_path):
    def put(folder, name, html):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(html)

    put("data_networking-2021_x", "a-2021-workshop.html", PAGE.format("A"))
    put("data_networking-2021_x", "b.html", PAGE.format("A"))
    put("igf_x", "c.html", PAGE.format("C"))
    return lambda: files.pages(spark, str(tmp_path))


def test_dom_records(pages):
    r = {r.Source_File: r for r in extraction.dom_records(pages()).collect()}
    a = r["a-2021-workshop.html"]
    assert (a.Year, a.Session_Type, a.Title, a.Themes, a.Speakers_Raw) == ("2021", "Workshop", "A", "Access", "Jane Doe")
    assert r["c.html"].Year == "Unknown"


def test_section_records(spark):
    page = "<nav>x</nav><p>Head</p><p>Theme</p><p>Access</p><p>SDGs</p><p>Goal 1</p><p>Format</p><p>Panel</p>"
    df = spark.createDataFrame([("igf_raw_data_2026", "a.html", page)], "folder string, file string, content string")
    r = extraction.section_records(df).first()
    assert (r.year, r.session_type, r.metadata.theme, r.metadata.sdgs, r.metadata.format) == ("2026", "Workshop", "Access", ["Goal 1"], "Panel")


def test_service_records(spark, pages):
    def service(prompt):
        return (200, '{"themes": ["a", "b"], "speakers": "S", "keywords": []}') if "C" in prompt.rsplit("\n", 1)[-1] else (500, "")

    done = spark.createDataFrame([("b.html",)], "Source_File string")
    r = {r.Source_File: r for r in extraction.service_records(pages(), service, done, key="name").collect()}
    assert set(r) == {"a-2021-workshop.html", "c.html"}
    c = r["c.html"]
    assert (c.Themes, c.Speakers, c.Organizations, c.Keywords, c.llm_failed) == ("a | b", "S", "N/A", "N/A", False)
    assert r["a-2021-workshop.html"].llm_failed and r["a-2021-workshop.html"].Themes == "N/A"


def test_typed_run_asks_once_per_content(spark, pages, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def service(prompt):
        calls.add(1)
        return 200, '```json\n{"title": "T", "agenda": "x"}\n```'

    cache = spark.createDataFrame([], schemas.CACHE_ENTRY)
    run = extraction.typed_run(pages(), cache, service, str(tmp_path / "store1"))
    s = run.summary.first()
    assert (s.scanned, s.succeeded, s.failed, s.missing, s.success_rate) == (3, 3, 0, 0, 100.0)
    assert calls.value == 2 and run.records.count() == 2 and run.entries.count() == 3
    kinds = {r._meta_file: r.result for r in run.records.collect()}
    assert '"kind":"Networking"' in kinds["a-2021-workshop.html"] and '"kind":"Base"' in kinds["c.html"]
    cache = spark.createDataFrame(run.entries.collect(), schemas.CACHE_ENTRY)
    again = extraction.typed_run(pages(), cache, service, str(tmp_path / "store2"))
    assert again.summary.first().succeeded == 3 and calls.value == 2 and again.entries.count() == 0


def test_pages_named_alike_are_told_apart(spark):
    rows = [(f"/{d}/a.html", "a.html", f"<h1>{d}</h1><p>text of {d}</p>") for d in ("x", "y")]
    pages = spark.createDataFrame(rows, "path string, file string, content string")
    service = lambda prompt: (200, '{"themes": ["%s"]}' % prompt.strip()[-1])
    got = extraction.service_records(pages, service, spark.createDataFrame([], "path string")).collect()
    assert sorted((r.path, r.Title, r.Themes) for r in got) == [("/x/a.html", "x", "x"), ("/y/a.html", "y", "y")]
    done = spark.createDataFrame([("/x/a.html",)], "path string")
    assert [r.path for r in extraction.service_records(pages, service, done).collect()] == ["/y/a.html"]


def test_failures_are_cached_unless_retried(spark, pages, tmp_path):
    cache = spark.createDataFrame([], schemas.CACHE_ENTRY)
    calls = spark.sparkContext.accumulator(0)

    def bad(prompt):
        calls.add(1)
        return 200, "[1]"

    run = extraction.typed_run(pages(), cache, bad, str(tmp_path / "store"))
    s, r = run.summary.first(), run.report.first()
    assert (s.succeeded, s.failed) == (0, 3) and run.entries.count() == 3 and run.records.where("error is not null").count() == 2
    assert (r.scanned, r.cache_hits, r.processed, r.new_failed, r.total_records, r.total_records_raw, r.unique_failed) == (3, 0, 3, 3, 2, 5, 2)
    cache = spark.createDataFrame(run.entries.collect(), schemas.CACHE_ENTRY)
    again = extraction.typed_run(pages(), cache, bad, str(tmp_path / "store2"))
    assert calls.value == 2 and again.summary.first().failed == 3 and again.report.first().cache_hits == 3
    better = extraction.typed_run(pages(), cache, lambda p: (200, '{"title": "T"}'), str(tmp_path / "store3"), retry_failed=True)
    assert better.summary.first().succeeded == 3 and better.entries.count() == 3


def test_missing_columns_give_empty_lists(spark):
    df = spark.createDataFrame([("a | b",)], "Themes string")
    assert tuple(extraction.with_lists(df, "Themes", "Keywords").first())[1:] == (["a", "b"], [])
