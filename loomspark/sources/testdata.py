"""The driver's tables, and the tables of this domain that they stand in for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of sessions, one an order: its lines' suppliers speak, their nations are organizations, its parts give themes and keywords.

    Orders without lines have missing marks. The two large tables meet on the
    order's key, which the lists are then grouped by without another shuffle.
    """
    t = lambda name: table(spark, sf_dir, name)
    lines = (
        t("lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
        .join(t("supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t("part").select("p_partkey", "p_type", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    )
    cell = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " | ")
    lists = lines.groupBy("l_orderkey").agg(cell("s_name").alias("Speakers"), cell("n_name").alias("Organizations"), cell("p_type").alias("Themes"), cell("p_name").alias("Keywords"))
    orders = t("orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    missing = lambda c: F.coalesce(F.col(c), F.lit("N/A")).alias(c)
    return orders.join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("order-"), F.col("o_orderkey"), F.lit(".html")).alias("Source_File"), F.year("o_orderdate").alias("Year"),
        F.col("o_orderpriority").alias("Session_Type"), F.concat(F.lit("Order "), F.col("o_orderkey")).alias("Title"),
        missing("Speakers"), missing("Organizations"), missing("Themes"), missing("Keywords"), F.lit(None).cast("string").alias("Description"),
    )
