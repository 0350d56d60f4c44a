"""Folders that driver and executors share, for tables between two steps."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return found.rstrip("/") if found else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/loomspark"


def store(spark: SparkSession, path: str):
    """(Hadoop path, its file system), whatever store the path names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the application's folder, which goes when the driver's JVM ends."""
    root = f"{shared_dir(spark)}/loomspark-{spark.sparkContext.applicationId}"
    place, files = store(spark, root)
    if not files.exists(place):
        files.mkdirs(place)
        files.deleteOnExit(place)
    return f"{root}/{name}-{uuid.uuid4().hex}"
