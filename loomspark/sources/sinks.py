"""Writing: CSV and JSON tables, caches, pages, quarantine; and small files for people on the driver."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import join_multi

#: What a table is named while another takes its place.
ASIDE = ".aside"


def flat(df: DataFrame) -> DataFrame:
    """Lists as delimited cells, for formats without lists."""
    return df.select(*(join_multi(F.col(c)).alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes))


def csv_table(df: DataFrame, path: str, *order, mode: str = "overwrite") -> None:
    out = flat(df)
    if order:
        out = out.orderBy(*order)
    out.write.mode(mode).csv(path, header=True, escape='"')


def csv_file(df: DataFrame, path: str, *order, limit: int = 1_000_000) -> int:
    """One CSV file with a byte order mark, for spreadsheet programs; a report of at most ``limit`` rows, else an error."""
    rows = flat(df.orderBy(*order) if order else df).limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows: write a table instead")
    rows.to_csv(path, index=False, encoding="utf-8-sig")
    return len(rows)


def json_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path, ignoreNullFields=False)


def json_file(df: DataFrame, path: str, limit: int = 100_000) -> int:
    """One pretty JSON array, letters as they are; bounded like ``csv_file``."""
    rows = [json.loads(r) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).limit(limit + 1).toPandas().iloc[:, 0]]
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows: write a table instead")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False, indent=2)
    return len(rows)


def checkpoint(df: DataFrame, path: str) -> None:
    """Appends results; unlike a rewrite, its cost doesn't grow with what is there."""
    df.write.mode("append").parquet(path)


def swap(df: DataFrame, path: str) -> None:
    """Replaces a table that may be among ``df``'s inputs.

    The new table is written beside the old one, which is moved aside before
    the new one takes its place and is deleted last. Whenever this breaks off,
    ``files.cache`` finds one of the two whole.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    beside, aside = f"{path}.{uuid.uuid4().hex}", path + ASIDE
    df.write.json(beside)
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old, new, kept = name(path), name(beside), name(aside)
    store = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(old):
        store.delete(kept, True)
        store.rename(old, kept)
    store.rename(new, old)
    store.delete(kept, True)


def new_pages(fetched: DataFrame, existing: DataFrame) -> DataFrame:
    """(file, content) of fetched pages whose file isn't there yet."""
    return fetched.where("error is null").select("file", "content").join(existing.select("file").distinct(), "file", "left_anti")


def quarantine(fetched: DataFrame) -> DataFrame:
    return fetched.where("error is not null").select("url", "error")


def page_files(pages: DataFrame, folder: str) -> None:
    """Writes each page to its own file under ``folder``: a URI of a store that pyarrow knows, or a path that all executors share."""

    def write(rows) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        for r in rows:
            part = f"{root}/.{r['file']}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(r["content"].encode())
            store.move(part, f"{root}/{r['file']}")  # a task that runs twice leaves one whole file

    pages.select("file", "content").foreachPartition(write)
