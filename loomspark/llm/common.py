"""What the training-data operators share: inputs, the shared folder, sampling of labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources.shared import fresh_path, store

#: Rows and bytes of one Arrow batch: a batch of long documents stays within tens of MB.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


#: What a Python worker keeps between tasks, by operator: how to let go of it.
_KEPT: dict[str, list[Callable[[], object]]] = {}
_running: list[str] = [""]


def keeps(operator: str, forget: Callable[[], object]) -> None:
    """``operator`` keeps something between a worker's tasks; ``forget`` frees it."""
    _KEPT.setdefault(operator, []).append(forget)


def entering(operator: str) -> None:
    """Called where a task begins: a worker that turns to another operator frees what the one before kept."""
    if _running[0] != operator:
        for forget in _KEPT.get(_running[0], []):
            forget()
        _running[0] = operator


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, whatever the length of the documents; tighter bounds of the session stay.

    Spark reads these options when a plan runs, so they must still hold when
    the caller uses the result: they stay set for the session.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        text = spark.conf.get(name).removesuffix("b")
        now = int(text) if text.isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    return _written(df, fresh_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The intermediate tables and broadcasts of one call; all of them go at the end of the ``with`` block.

    What is still needed afterwards is written with ``written`` instead.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.number = spark, fresh_path(spark, name), 0
        self.shared: list = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        for b in self.shared:
            b.unpersist()
        self.drop("")

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.number += 1
        return _written(df, f"{self.path}/{name}-{self.number}")

    def broadcast(self, value):
        self.shared.append(self.spark.sparkContext.broadcast(value))
        return self.shared[-1]

    def drop(self, name: str) -> None:
        """Removes one table, or all for the empty name."""
        place, files = store(self.spark, f"{self.path}/{name}" if name else self.path)
        files.delete(place, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, null texts as empty ones; extra columns can't clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most ``per_class`` labelled documents a class, and the class counts.

    Only rows whose fold isn't ``held_out`` are looked at. Within a class those
    with the smallest hash of their id are taken, so the sample is the same for
    any partitioning. The ids, at most two times ``per_class`` of them, are
    broadcast; that is the size bound. Contradicting labels of an id count once,
    with the larger one; of rows of ``docs`` that share an id, that of the
    smallest text is taken.
    """
    known = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id"), parts) != held_out))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    counts = {int(r["label"]): int(r["n"]) for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [r for y in (0, 1) for r in known.where(F.col("label") == y).orderBy(*order).limit(per_class).collect()]
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r["doc_id"], r["label"]) for r in chosen], "doc_id long, label int")
    picked = texts(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return picked.select("doc_id", "text", "label"), {0: counts.get(0, 0), 1: counts.get(1, 0)}
