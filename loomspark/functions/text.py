"""Text as Columns: Unicode trimming, multi-valued cells, names, years, folders, sections."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str`` has it; Java's class leaves out four control characters even with Unicode classes on.
SPACE = r"(?U)[\s\x1c-\x1f]"
GAP = r"[\s\x1c-\x1f]"
LISTS = "cast(array() as array<string>)"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+$|^{SPACE}+", "")


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, f"{SPACE}+", " "))


def split_multi(c: Column, sep: str = r"\|", dedupe: bool = False, missing: tuple[str, ...] = ("N/A",)) -> Column:
    """The trimmed, non-empty parts of a delimited cell in order; null and missing cells have none."""
    parts = F.filter(F.transform(F.split(c, sep), trim), lambda x: x != "")
    parts = F.array_distinct(parts) if dedupe else parts
    return F.when(c.isNull() | trim(c).isin(*missing), F.expr(LISTS)).otherwise(parts)


def normalise_list(c: Column, synonyms: Mapping[str, str] | None = None) -> Column:
    """Parts of a cell, each replaced by its synonym if it has one; the first of equal ones stays."""
    parts = split_multi(c)
    if synonyms:
        known = F.create_map(*(F.lit(x) for kv in sorted(synonyms.items()) for x in kv))
        parts = F.transform(parts, lambda x: F.coalesce(F.try_element_at(known, x), x))
    return F.array_distinct(parts)


def join_multi(c: Column) -> Column:
    """A list as one cell, or the missing mark if it is empty."""
    return F.when(F.size(c) > 0, F.array_join(c, " | ")).otherwise(F.lit("N/A"))


def or_missing(c: Column, mark: str = "N/A") -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(mark))


def to_int(c: Column) -> Column:
    """Number in text, cut to a whole one; null where it isn't a number."""
    return F.expr("cast(null as int)") if c is None else c.try_cast("double").try_cast("int")


def must_be_int(c: Column) -> Column:
    """The same, but text that isn't a number ends the query."""
    return c.cast("double").cast("int")


def file_name(c: Column) -> Column:
    """A name that file systems take: forbidden characters and returns go, line feeds become spaces, 100 characters."""
    return trim(F.substring(F.regexp_replace(F.translate(c, '\\/*?:"<>|\r', ""), "\n", " "), 1, 100))


def year_in(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "(20[0-9]{2})", 1), F.lit(""))


def absolute(href: Column, base: str) -> Column:
    return F.when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(href)


def page_name(url: Column) -> Column:
    """The last segment of a path up to '?', as a file name; one of less than 3 characters gives way to a hash of the address."""
    last = F.substring_index(F.element_at(F.split(url, "/"), -1), "?", 1)
    named = F.when(F.length(last) < 3, F.concat(F.lit("page_"), F.lower(F.hex(F.xxhash64(url))))).otherwise(last)
    return F.concat(file_name(named), F.lit(".html"))


#: Fixed value: how links to a year's sessions begin.
SESSION_LINK = "igf-"


def link_wanted(href: Column, year: Column | None = None, marks: tuple[str, ...] = ("workshop",)) -> Column:
    """Whether a link names the year's sessions or holds one of the marks, in any case."""
    low = F.lower(href)
    wanted = low.rlike("|".join(f"\\Q{m}\\E" for m in marks))
    return wanted if year is None else wanted | low.contains(F.concat(F.lit(SESSION_LINK), year, F.lit("-")))


def titled(c: Column) -> Column:
    """Upper case after every non-letter and lower case elsewhere, so that '2nd' becomes '2Nd'."""
    letters = F.split(F.lower(c), "")
    before = lambda i: F.get(letters, i - 1)
    return F.array_join(F.transform(letters, lambda x, i: F.when((i == 0) | ~before(i).rlike(r"\p{L}"), F.upper(x)).otherwise(x)), "")


#: Kinds of sessions that a file's name may tell, and how folders of crawls are named.
NAME_KINDS = ("workshop", "networking", "lightning", "launch", "award", "forum")
FOLDER, CRAWL_FOLDER = r"^data_([a-zA-Z0-9\-]+)-(\d{4})_", r"igf_raw_data_(\d{4})"


def name_metadata(name: Column, kinds: tuple[str, ...]) -> Column:
    """(year, session_type) from a file name alone."""
    kind = F.coalesce(*(F.when(F.lower(name).contains(k), titled(F.lit(k))) for k in kinds), F.lit("Unknown"))
    return F.struct(F.coalesce(year_in(name), F.lit("Unknown")).alias("year"), kind.alias("session_type"))


def folder_metadata(folder: Column, name: Column, kinds: tuple[str, ...] = NAME_KINDS) -> Column:
    """(year, session_type, year_source): from the folder; failing that, its crawl year; failing that, the file's name."""
    kind, year = F.regexp_extract(folder, FOLDER, 1), F.regexp_extract(folder, FOLDER, 2)
    crawled = F.regexp_extract(folder, CRAWL_FOLDER, 1)
    own = name_metadata(name, kinds)
    both = lambda y, k, s: F.struct(y.alias("year"), k.alias("session_type"), F.lit(s).alias("year_source"))
    return (
        F.when(year != "", both(year, titled(F.replace(kind, F.lit("-"), F.lit(" "))), "folder"))
        .when(crawled != "", both(crawled, F.lit("Workshop"), "crawl"))
        .otherwise(both(own["year"], own["session_type"], "name"))
    )


def valid_name(c: Column) -> Column:
    """Whether a string may be a person's name: letters, 3 to 80 characters, no label, placeholder or address."""
    labels = ("speakers", "speaker", "moderator", "moderators", "panelists", "panellists", "organizers", "organisers", "tba", "tbc", "n/a")
    return F.length(c).between(3, 80) & c.rlike(r"\p{L}") & ~F.lower(c).isin(*labels) & ~c.rlike(rf"(?iuU)^speaker{GAP}*\d+$|https?://|@")


def _without_colon(c: Column) -> Column:
    return trim(F.regexp_replace(c, ":+$", ""))


def clean_field(items: Column, valid: Callable[[Column], Column]) -> Column:
    """Items as one cell: equal ones once, then space collapsed, a final colon dropped, and only valid ones kept."""
    return join_multi(F.filter(F.transform(F.array_distinct(items), lambda x: _without_colon(F.regexp_replace(x, f"{SPACE}+", " "))), valid))


def long_enough(c: Column) -> Column:
    return F.length(c) > 2


#: Headings that introduce a field in running text. White space is Unicode's, and GAP is what it is.
SPEAKER_HEADS = (
    rf"(?iuU)(?:Speakers|Panellists|Panelists|Moderators|Speakers/Panellists|Organizers|Organisers|Speaker\(s\)){GAP}*[:\-]{GAP}*([^\n\r]+)",
    rf"(?iuU)(?:Speakers|Panellists|Panelists){GAP}*\n{GAP}*([^\n\r]+)",
)
THEME_HEADS = (
    rf"(?iuU)(?:Theme|Sub-theme|Subtheme|Main Theme|Tags|Category){GAP}*[:\-]{GAP}*([^\n\r]+)",
    rf"(?iuU)(?:Theme|Subtheme){GAP}*\n{GAP}*([^\n\r]+)",
)


def _after(text: Column, pattern: str) -> Column:
    return F.regexp_replace(trim(F.regexp_extract(text, pattern, 1)), "(?d)<(.*?)>", "")


def speakers_in(text: Column) -> Column:
    """Names after a heading, as one cell; the first heading with a valid name counts."""
    def names(p: str) -> Column:
        return F.filter(F.transform(F.split(_after(text, p), r"(?U)[,;]|\band\b"), _without_colon), valid_name)

    found = [F.when(F.size(names(p)) > 0, F.array_join(names(p), " | ")) for p in SPEAKER_HEADS]
    return F.coalesce(*found, F.lit("N/A"))


def theme_in(text: Column) -> Column:
    found = [F.when(F.length(_after(text, p)).between(3, 299), _after(text, p)) for p in THEME_HEADS]
    return F.coalesce(*found, F.lit("N/A"))


#: How a page's sections begin and end.
SECTIONS = {
    "theme": r"\nTheme\n([^\n]+)",
    "subtheme": r"\nSubtheme\n([^\n]+)",
    "website": r"Organization's Website\n([^\n]+)",
    "speakers": r"(?s)\nSpeakers\n(.*?)(?=\nOnsite Moderator|\nOnline Moderator|\nRapporteur|\nSDGs|\nFormat|\nDescription)",
    "sdgs": r"(?s)\nSDGs\n(.*?)(?=\nTargets:|\nFormat|\nDescription)",
    "format": r"\nFormat\n([^\n]+)",
    "description": r"(?s)\nDescription\n(.*?)(?=\nReport|\nThe co-organisers|\nCall to Action|\nSession Report|\z)",
    "report": r"(?s)\nReport\n(.*)",
    "session_report": r"(?s)\nSession Report.*?\n(.*)",
}
#: A page's greeting, with any letters, bars and white space up to a line's end, and its footers.
GREETING = rf"^(?iuU)(?:Welcome to the United Nations|Skip to main content)(?:{GAP}|[|A-Za-z])*\n"
FOOTERS = ("UNITED NATIONS\nContact information", "Secretariat of the Internet Governance Forum")


def without_boilerplate(text: Column) -> Column:
    """Text less its greeting and what follows the footer; the first footer counts wherever the second stands."""
    text = F.regexp_replace(text, GREETING, "")
    return F.when(text.contains(FOOTERS[0]), F.substring_index(text, FOOTERS[0], 1)).otherwise(F.substring_index(text, FOOTERS[1], 1))


def lines(c: Column) -> Column:
    return F.coalesce(F.filter(F.transform(F.split(c, "\n"), trim), lambda x: x != ""), F.expr(LISTS))


def sections(text: Column) -> Column:
    """(metadata, description, report, content) of a page's text, one heading a line."""
    found = {k: F.nullif(trim(F.regexp_extract(text, p, 1)), F.lit("")) for k, p in SECTIONS.items()}
    named = lambda k: F.coalesce(found[k], F.lit("N/A"))
    at = F.instr(text, "Description\n")
    content = F.when(at > 0, F.concat(F.lit("Description:\n"), F.substring(text, at + 12, F.length(text)))).otherwise(text)
    content = trim(F.regexp_replace(F.translate(content, "\xa0", " "), "\n{3,}", "\n\n"))
    metadata = F.struct(
        named("theme").alias("theme"), named("subtheme").alias("subtheme"), named("website").alias("website"),
        lines(found["speakers"]).alias("speakers"), lines(found["sdgs"]).alias("sdgs"), named("format").alias("format"),
    )
    report = F.coalesce(found["report"], found["session_report"], F.lit("N/A"))
    return F.struct(metadata.alias("metadata"), named("description").alias("description"), report.alias("report"), content.alias("content"))
