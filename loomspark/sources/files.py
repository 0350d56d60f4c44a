"""Reading: CSV tables with missing marks, page folders, text, JSON caches, resume sets."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.schemas import CACHE_ENTRY, DEFAULT_NA
from loomspark.operators.clean import null_missing
from loomspark.sources.sinks import ASIDE


def csv_table(spark: SparkSession, path: str, schema: T.StructType, missing: tuple[str, ...] = DEFAULT_NA) -> DataFrame:
    """A CSV table with header and quoted line breaks, its columns in the header's order matched by position.

    Missing marks become null in every column. The reader drops a byte order
    mark at the start of the file.
    """
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', enforceSchema=True, mode="PERMISSIVE")
    return null_missing(rows, missing)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches, in whatever store the path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def csv_or_none(spark: SparkSession, path: str, schema: T.StructType, missing: tuple[str, ...] = DEFAULT_NA) -> DataFrame | None:
    return csv_table(spark, path, schema, missing) if exists(spark, path) else None


def path_parts(path: Column) -> Column:
    """(folder, file): the last two parts of a path."""
    parts = F.split(path, "/")
    return F.struct(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file"))


def pages(spark: SparkSession, root: str, glob: str = "*.[hH][tT][mM]*", folders: tuple[str, ...] = ("data_", "igf_"), skip: tuple[str, ...] = (".venv", ".idea")) -> DataFrame:
    """(path, length, modificationTime, content, folder, file) of page files below ``root``.

    The parent folder's name holds one of ``folders`` (none: any folder), and
    no part of the path is in ``skip``. File names are matched by the scan
    itself; contents are read only if a query uses them.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    df = df.withColumns({"folder": path_parts(F.col("path"))["folder"], "file": path_parts(F.col("path"))["file"]})
    if folders:
        wanted = F.lit(False)
        for f in folders:
            wanted = wanted | F.col("folder").contains(f)
        df = df.where(wanted)
    return df.where(~F.arrays_overlap(F.split("path", "/"), F.array(*(F.lit(s) for s in skip)))) if skip else df


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """UTF-8 text of bytes, those that aren't dropped."""
    return pd.Series([None if b is None else bytes(b).decode("utf-8", "ignore") for b in content], dtype=object)


def _cache_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored lines, with ``bad`` for one that is no entry; None without a table. A table that was moved aside counts while no other is there."""
    here = next((p for p in (path.rstrip("/"), path.rstrip("/") + ASIDE) if exists(spark, p)), None)
    if here is None:
        return None
    try:
        return spark.read.schema(f"{CACHE_ENTRY}, bad string").json(here, mode="PERMISSIVE", columnNameOfCorruptRecord="bad")
    except AnalysisException:
        return None


def cache(spark: SparkSession, path: str) -> DataFrame:
    """(fast_key, hash, seq, result): the stored entries; none if there are none or they can't be read. ``cache_faults`` has the lines left out."""
    rows = _cache_lines(spark, path)
    if rows is None:
        return spark.createDataFrame([], CACHE_ENTRY)
    return rows.where("bad is null and fast_key is not null and hash is not null").drop("bad")


def cache_faults(spark: SparkSession, path: str) -> DataFrame:
    """(line): what stands in a cache and is no entry, to be looked at; the contents are extracted anew."""
    rows = _cache_lines(spark, path)
    if rows is None:
        return spark.createDataFrame([], "line string")
    return rows.where("bad is not null or fast_key is null or hash is null").select(F.coalesce("bad", F.to_json(F.struct("fast_key", "hash", "seq", "result"))).alias("line"))


def processed_names(spark: SparkSession, path: str, schema: T.StructType, column: str = "Source_File") -> DataFrame:
    """Distinct names that a table of results already holds."""
    rows = csv_or_none(spark, path, schema)
    return spark.createDataFrame([], f"{column} string") if rows is None else rows.select(column).na.drop().distinct()
