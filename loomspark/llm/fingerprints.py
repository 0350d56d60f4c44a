"""Document fingerprints by a threshold-scaled sketch (native).

A text's shingles of five words are hashed; every hash below a fixed fraction
of the range is kept. Sketches of any two texts, however unequal in length, are
samples of their shingles at one rate: the share of the smaller sketch that the
other holds estimates containment, and the union of two sketches, cut at the
lower of their bounds, is the sketch of the union. So that a short text isn't
left without a sketch, the FLOOR smallest hashes are kept in any case; the
sketch's bound is then its largest hash, or none if it holds all shingles.

Hashing, sorting and comparison are expressions over arrays within a row. The
next document's text arrives by one shuffle: ids are dealt in ranges whose
bounds are ids of the table, and the first document of each range also goes to
the range before it, where it follows the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.common import table

SHINGLE, SCALE, FLOOR = 5, 16, 16
LOWEST = -(1 << 63)
#: Hashes below this are kept: one of SCALE.
BOUND = LOWEST + (1 << 64) // SCALE
NO_BOUND = (1 << 63) - 1
LONGS = "cast(array() as array<bigint>)"


def shingle_hashes(words: Column) -> Column:
    """Of every SHINGLE words on end; of all words if they are fewer; none without words."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    return F.when(n >= SHINGLE, many).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.expr(LONGS))


def sketched(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with ``out``: the struct (bound, hashes) of ``text_col``, hashes in order."""
    words, all_, low = f"{out}_words", f"{out}_all", f"{out}_low"
    df = df.withColumn(words, F.array_remove(F.split(F.col(text_col), r"\s+"), ""))
    df = df.withColumn(all_, shingle_hashes(F.col(words))).drop(words)
    df = df.withColumn(low, F.array_distinct(F.filter(all_, lambda h: h < BOUND)))
    least = F.slice(F.sort_array(F.array_distinct(all_)), 1, FLOOR)
    enough = F.size(low) >= FLOOR
    hashes = F.when(enough, F.sort_array(low)).otherwise(least)
    bound = F.when(enough, F.lit(BOUND - 1)).when(F.size(hashes) < FLOOR, F.lit(NO_BOUND)).otherwise(F.greatest(F.lit(BOUND - 1), F.element_at(hashes, -1)))
    return df.withColumn(f"{out}_hashes", hashes).withColumn(out, F.struct(bound.alias("bound"), F.col(f"{out}_hashes").alias("hashes"))).drop(all_, low, f"{out}_hashes")


def merged(a: Column, b: Column) -> Column:
    """The sketch of the union of two texts' shingles."""
    bound = F.least(a["bound"], b["bound"])
    return F.struct(bound.alias("bound"), F.filter(F.sort_array(F.array_union(a["hashes"], b["hashes"])), lambda h: h <= bound).alias("hashes"))


def likeness(a: Column, b: Column) -> tuple[Column, Column]:
    """(containment, resemblance) estimates, 0 to 1: over hashes within both bounds, the share that the two have in
    common of the smaller sketch and of their union. Two texts without shingles are alike, one without is unlike any other."""
    bound = F.least(a["bound"], b["bound"])
    within = lambda s: F.when(s["bound"] == bound, s["hashes"]).otherwise(F.filter(s["hashes"], lambda h: h <= bound))
    x, y = within(a), within(b)
    n, m, both = F.size(x), F.size(y), F.size(F.array_intersect(x, y))
    empty = (F.size(a["hashes"]) == 0) & (F.size(b["hashes"]) == 0)
    part = lambda d: F.when(empty, F.lit(1.0)).when(d == 0, F.lit(0.0)).otherwise(both / d)
    return part(F.least(n, m)), part(n + m - both)


def as_text(sketch: Column) -> Column:
    """The bound, or ``all`` where there is none, and every hash, in hex: what it takes to merge and compare sketches."""
    digits = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    bound = F.when(sketch["bound"] == NO_BOUND, F.lit("all")).otherwise(digits(sketch["bound"]))
    return F.concat(bound, F.lit(":"), F.array_join(F.transform(sketch["hashes"], digits), ","))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text, sketch, next_sketch): what is next by id, then text; after the last row, the first.

    Null ids come first. One shuffle of the texts, into as many ranges as there
    are shuffle partitions; the bounds and first ids are that many numbers.
    """
    spark = docs.sparkSession
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    rows = docs.select("doc_id", "text", key.alias("key"))
    stats = rows.agg(F.min("key").alias("first"), F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("cuts")).first()
    first = LOWEST if stats["first"] is None else stats["first"]
    bounds = sorted({first, *(stats["cuts"] or [])})
    n = len(bounds)
    cuts = F.array(*(F.lit(b) for b in bounds))
    # The last bound at or below the key, by halving.
    steps = max(1, n.bit_length())
    half = lambda acc, _: F.when(F.get(cuts, ((acc["lo"] + acc["hi"]) / 2).cast("int")) <= F.col("key"), F.struct(((acc["lo"] + acc["hi"]) / 2).cast("int").alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), ((acc["lo"] + acc["hi"]) / 2).cast("int").alias("hi")))
    at = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), half, lambda acc: acc["lo"])
    rows = rows.withColumn("at", at)
    # The first row of a range follows the last one of the range before; that of the first range follows the last of all.
    # Bounds are approximate, so each range's true first id is looked up; ranges without rows are passed over.
    least = {r["at"]: r["least"] for r in rows.groupBy("at").agg(F.min("key").alias("least")).collect()}
    full = sorted(least)
    last = dict(zip(full, [*full[-1:], *full]))
    leads = F.col("key") == F.get(F.array(*(F.lit(least.get(i, LOWEST)) for i in range(n))), F.col("at"))
    before = F.get(F.array(*(F.lit(last.get(i, 0)) for i in range(n))), F.col("at"))
    copy = lambda at_, turn, real: F.struct(at_.alias("at"), F.lit(turn).alias("turn"), F.lit(real).alias("real"))
    both = F.when(leads, F.array(copy(F.col("at"), 0, True), copy(before, 1, False))).otherwise(F.array(copy(F.col("at"), 0, True)))
    dealt = rows.select("doc_id", "text", "key", F.explode(both).alias("to")).select("doc_id", "text", "key", "to.*")
    dealt = dealt.repartitionById(n, F.col("at").cast("int"))
    follows = Window.partitionBy("at").orderBy("turn", "key", "text")
    dealt = sketched(dealt, "text", "sketch")
    dealt = dealt.withColumns({"next_text": F.lead("text").over(follows), "next_sketch": F.lead("sketch").over(follows)})
    return dealt.where("real").select("doc_id", "text", "next_text", "sketch", "next_sketch")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: fingerprints of a text and of its edited text, and their likenesses.

    The edited text is the text with its last floor(n_chars / 4) code points
    replaced by as many first ones of the next text, or by all if it has fewer.
    Null texts count as empty; a text without words has an empty sketch, like
    to other empty ones alone. Rows of one id follow one another by text, equal
    rows in any order; rows without an id come first. A single row is its own
    next. Very long texts are sketched whole. An empty table gives no rows;
    other columns are ignored.
    """
    rows = with_next(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    n, cut = F.col("n_chars").cast("int"), F.col("cut")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    df = sketched(rows, "edited", "edited_sketch").withColumn("edited_sha256", F.sha2("edited", 256))
    own, edited, other = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    (near_e, same_e), (near_n, same_n) = likeness(own, edited), likeness(own, other)
    return df.select(
        "doc_id", "n_chars", "edited_sha256", as_text(own).alias("fingerprint"), as_text(edited).alias("edited_fingerprint"),
        near_e.alias("near_edited"), near_n.alias("near_next"), same_e.alias("resemblance_edited"), same_n.alias("resemblance_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
