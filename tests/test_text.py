"""Scalar functions, one value at a time, with expected values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text


@pytest.fixture(scope="module")
def val(spark):
    def run(build, *values):
        df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
        return df.select(build(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x

    return run


@pytest.mark.parametrize("cell,want", [("A | B|C ", ["A", "B", "C"]), ("A |  | A", ["A", "A"]), ("\xa0C\xa0", ["C"]), (None, []), ("", []), ("N/A", []), (" N/A ", [])])
def test_split_multi(val, cell, want):
    assert val(text.split_multi, cell) == want


def test_split_multi_once(val):
    assert val(lambda c: text.split_multi(c, dedupe=True), "A |  | A") == ["A"]


def test_normalise_list(val):
    assert val(lambda c: text.normalise_list(c, {"ISOC": "Internet Society"}), "ISOC | Internet Society | x") == ["Internet Society", "x"]
    assert val(text.normalise_list, "b | a | b") == ["b", "a"]


@pytest.mark.parametrize("raw,want", [("2017.0", 2017), ("2017", 2017), (" 12 ", 12), ("twenty", None), ("", None), (None, None), ("12.9", 12)])
def test_to_int(val, raw, want):
    assert val(text.to_int, raw) == want


def test_must_be_int_fails(val):
    with pytest.raises(Exception):
        val(text.must_be_int, "twenty")


@pytest.mark.parametrize("raw,want", [('a\\b/c*d?e:f"g<h>i|j', "abcdefghij"), ("x\ny\r", "x y"), ("a" * 150, "a" * 100), (" a ", "a")])
def test_file_name(val, raw, want):
    assert val(text.file_name, raw) == want


def test_page_name(val):
    assert val(text.page_name, "https://s/en/a:b?x=1") == "ab.html"
    one, two = val(text.page_name, "https://s/en/"), val(text.page_name, "https://s/fr/")
    assert one.startswith("page_") and one != two and one == val(text.page_name, "https://s/en/")
    assert val(text.page_name, "https://s/en/page#top") == "page#top.html"


def test_links(val):
    year = lambda c: text.link_wanted(c, F.lit("2021"), ("ws", "workshop"))
    assert val(year, "/en/news") and val(year, "/en/IGF-2021-x") and not val(year, "about")
    assert val(lambda c: text.absolute(c, "https://h"), "/a") == "https://h/a" and val(lambda c: text.absolute(c, "https://h"), "a/b") == "a/b"
    assert val(text.year_in, "/igf-2019/2021") == "2019" and val(text.year_in, "/1999") is None


@pytest.mark.parametrize(
    "folder,file,want",
    [
        ("data_networking-sessions-2021_20260101_120000", "x", ("2021", "Networking Sessions", "folder")),
        ("data_workshops-2017-2018_x", "x", ("2018", "Workshops 2017", "folder")),
        ("data_2nd-track-2020_x", "x", ("2020", "2Nd Track", "folder")),
        ("igf_raw_data_20260101_120000", "x", ("2026", "Workshop", "crawl")),
        ("other", "igf-2019-workshop-3.html", ("2019", "Workshop", "name")),
        ("other", "x.html", ("Unknown", "Unknown", "name")),
    ],
)
def test_folder_metadata(val, folder, file, want):
    assert tuple(val(text.folder_metadata, folder, file)) == want


def test_titled(val):
    assert val(text.titled, "o'neil 2nd été") == "o'neil 2nd été".title()


PAGE = "Head\nTheme\nAccess\nSpeakers\nJane D.\nJohn E.\nSDGs\nGoal 4\nFormat\nPanel\nDescription\nLong text\nReport\nDone"


def test_sections(val):
    s = val(lambda c: text.sections(text.without_boilerplate(c)), PAGE)
    m = s.metadata
    assert (m.theme, m.subtheme, m.website, m.speakers, m.sdgs, m.format) == ("Access", "N/A", "N/A", ["Jane D.", "John E."], ["Goal 4"], "Panel")
    assert s.description == "Long text" and s.report == "Done" and s.content.startswith("Description:\nLong text")


def test_section_traps(val):
    run = lambda t: val(lambda c: text.sections(text.without_boilerplate(c)), t)
    assert run("Theme\nAccess").metadata.theme == "N/A"
    s = run("Skip to main content\nTheme\nAccess\nSpeakers\nJane D.\n")
    assert s.metadata.theme == "N/A" and s.metadata.speakers == []
    cut = lambda t: val(text.without_boilerplate, t)
    assert cut("aSecretariat of the Internet Governance Forum b UNITED NATIONS\nContact information c") == "aSecretariat of the Internet Governance Forum b "
    assert cut("a Secretariat of the Internet Governance Forum b") == "a "


def test_heading_fallback(val):
    assert val(text.speakers_in, "x\nspeakers: Jane Doe, John Roe and Speaker 1") == "Jane Doe | John Roe"
    assert val(text.speakers_in, "Panelists\n  Ann Bee; TBA") == "Ann Bee"
    assert val(text.speakers_in, "nothing") == "N/A" and val(text.speakers_in, None) == "N/A"
    assert val(text.theme_in, "Theme: <i>Access</i>") == "Access" and val(text.theme_in, "Theme: ab") == "N/A"


def test_clean_field(spark):
    df = spark.createDataFrame([(["A  B:", "A B", "A  B:", "x"],)], "c array<string>")
    run = lambda f: df.select(text.clean_field(F.col("c"), f).alias("x")).first().x
    assert run(text.long_enough) == "A B | A B"  # equal ones are dropped before they are cleaned
    assert run(lambda c: F.lit(False)) == "N/A"


def test_collapse(val):
    assert val(text.collapse, " a\xa0\n\x1c b ") == "a b"


def test_headings_with_spaces_that_are_not_ascii(val):
    assert val(text.speakers_in, "Speakers\xa0: Jane Doe, John Roe") == "Jane Doe | John Roe"
    assert val(text.theme_in, "x\nTheme\u2003\n\xa0Access for all\n") == "Access for all"
    assert val(text.without_boilerplate, "Skip to main content\xa0|\u2003Menu\n1 rest") == "1 rest"
