"""From page files to records: by the tree, by sections, and by a service with a cache."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import html, jsonx, text
from loomspark.operators import incremental as inc
from loomspark.sources import boundary

NAME_KINDS = text.NAME_KINDS


def dom_records(pages: DataFrame, kinds: tuple[str, ...] = NAME_KINDS) -> DataFrame:
    """The flat record of each page (file, content): the tree first, headings in running text where it has nothing."""
    p = pages.select("file", html.page("content").alias("p"))
    meta = text.name_metadata(F.col("file"), kinds)
    people = text.clean_field(F.col("p.people"), text.valid_name)
    topics = text.clean_field(F.col("p.topics"), text.long_enough)
    either = lambda found, fallback: F.when(found != "N/A", found).otherwise(fallback)
    return p.select(
        F.col("file").alias("Source_File"), meta["year"].alias("Year"), meta["session_type"].alias("Session_Type"), F.coalesce("p.title", "file").alias("Title"),
        either(topics, text.theme_in(F.col("p.full_text"))).alias("Themes"), either(people, text.speakers_in(F.col("p.full_text"))).alias("Speakers_Raw"),
        F.col("p.description").alias("Description"),
    )


def section_records(pages: DataFrame) -> DataFrame:
    """The nested record of each page (folder, file, content) from its headings."""
    p = pages.select("folder", "file", text.without_boilerplate(html.page_lines("content")).alias("lines"))
    meta = text.folder_metadata(F.col("folder"), F.col("file"))
    s = p.select(F.col("folder").alias("folder_name"), F.col("file").alias("file_name"), meta.alias("m"), text.sections(F.col("lines")).alias("s"))
    return s.select("folder_name", "file_name", "m.year", "m.session_type", "m.year_source", "s.*")


def service_records(pages: DataFrame, service: boundary.Extractor, done: DataFrame, at_once: int = 4, key: str = "path") -> DataFrame:
    """Flat records by a service for pages (path, file, content) that aren't in ``done``; a failed page has missing marks and ``llm_failed``.

    ``key``: ``path``, which ``done`` then has as a column, tells pages apart
    that are named alike in two folders; ``name`` looks for the file's name
    among ``done``'s Source_File instead. The service is asked once a page, with
    its title and whole text, for speakers, organizations, themes and keywords.
    """
    known = done.select("path") if key == "path" else done.select(F.col("Source_File").alias("file"))
    rest = pages.join(known.distinct(), known.columns, "left_anti")
    p = rest.select("path", "file", html.page_brief("content").alias("b"), html.page_text("content").alias("text"))
    name = F.coalesce("b.title", "file")
    asked = p.select(F.col("path").alias("key"), F.lit(jsonx.FLAT).alias("kind"), F.concat(F.lit("Title: "), name, F.lit("\n"), F.col("text")).alias("text"))
    replies = boundary.extracted(asked, service, at_once, attempts=1).select("key", jsonx.repaired(F.col("reply")).alias("json"))
    listed = lambda name: _list_of(F.col("json"), name)
    meta = text.name_metadata(F.col("file"), NAME_KINDS)
    return p.join(replies, p["path"] == replies["key"], "left").select(
        "path", F.col("file").alias("Source_File"), meta["year"].alias("Year"), meta["session_type"].alias("Session_Type"), name.alias("Title"),
        listed("themes").alias("Themes"), listed("speakers").alias("Speakers"), listed("organizations").alias("Organizations"), listed("keywords").alias("Keywords"),
        F.col("b.description").alias("Description"), F.col("json").isNull().alias("llm_failed"),
    )


def _list_of(json: Column, name: str) -> Column:
    """A JSON field, list or single value, as one cell."""
    value = F.get_json_object(json, f"$.{name}")
    items = F.from_json(value, "array<string>")
    return F.coalesce(F.when(value.startswith("["), text.join_multi(F.coalesce(items, F.expr(text.LISTS)))).otherwise(text.or_missing(value)), F.lit("N/A"))


def with_lists(df: DataFrame, *columns: str) -> DataFrame:
    """``<column>_List`` of each multi-valued column; empty where the table lacks the column."""
    return df.withColumns({f"{c}_List": text.split_multi(F.col(c)) if c in df.columns else F.expr(text.LISTS) for c in columns})


@dataclass
class Run:
    """What a run of the typed extraction leaves: unique records, new cache entries, and its figures by file and in three scopes."""

    records: DataFrame
    entries: DataFrame
    summary: DataFrame
    report: DataFrame


def typed_run(files: DataFrame, cache: DataFrame, service: boundary.Extractor, store: str, at_once: int = 4, retry_failed: bool = False, pause: float = 1.0) -> Run:
    """Typed records of page files, by cache where a file's key or content is known and by the service elsewhere.

    ``files``: path, length, modificationTime, content, folder, file. ``store``:
    a folder where the service's answers are written before they are used, so
    that nothing is asked twice. Equal contents are asked once; each file keeps
    its own name. A failed page has its kind's defaults and an error, which are
    cached too; ``retry_failed`` takes such entries for unknown.
    """
    keyed = files.withColumns({"fast_key": inc.fast_key(F.col("path"), F.col("length"), F.col("modificationTime")), "hash": inc.content_hash(F.col("content"))})
    names = keyed.select("fast_key", "hash", "folder", "file")
    held = cache.withColumn("error", F.get_json_object("result", "$.error"))
    held = held.where("error is null") if retry_failed else held
    known = inc.first_by(held, ["hash"], "seq").select("hash", "result", "error")
    fresh = inc.first_by(keyed, ["hash"], "path").join(known.select("hash"), "hash", "left_anti")
    pages = fresh.select(F.col("hash").alias("key"), "folder", html.page_text("content").alias("text"))
    asked = pages.select("key", jsonx.route(F.col("folder"), F.col("text")).alias("kind"), "text")
    boundary.extracted(asked, service, at_once, pause=pause).write.mode("overwrite").parquet(store)
    answers = boundary.records(files.sparkSession.read.parquet(store))
    packed = answers.select(F.col("key").alias("hash"), F.to_json(F.struct(*(c for c in answers.columns if c != "key"))).alias("result"), "error")
    outcome = names.join(known.unionByName(packed), "hash", "left").select("fast_key", "hash", F.col("folder").alias("_meta_folder"), F.col("file").alias("_meta_file"), "result", "error")
    records = inc.first_by(outcome.where("result is not null"), ["hash"], "_meta_folder", "_meta_file")
    new = outcome.where("result is not null").join(held.select("fast_key"), "fast_key", "left_anti")
    entries = new.select("fast_key", "hash", F.unix_micros(F.current_timestamp()).alias("seq"), "result")
    failed = F.col("error").isNotNull().alias("failed")
    summary = inc.outcomes(names.select("fast_key"), outcome.where("result is not null"), ["fast_key"], F.col("error").isNotNull())
    return Run(records, entries, summary, inc.run_report(names.select("hash"), known.select("hash", failed), packed.select("hash", failed)))
