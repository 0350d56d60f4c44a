"""Frequencies, rankings, matrices and shares over multi-valued columns.

Every ranking breaks ties by label, so results don't depend on partitioning.
Lists are exploded after the columns are pruned; top-K sides that are joined
back have K rows, which the optimiser broadcasts by their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exploded(df: DataFrame, lists: dict[str, str], *keep: str) -> DataFrame:
    """One row per combination of the lists' items: ``lists`` maps a list column to its item's name. Empty lists drop the row."""
    out = df.select(*keep, *lists)
    for column, item in lists.items():
        out = out.withColumn(item, F.explode(column)).where(F.col(item) != "").drop(column)
    return out


def value_counts(df: DataFrame, *keys: str, name: str = "Frequency") -> DataFrame:
    """Rows per key; null keys aren't counted."""
    return df.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias(name))


def ordered(freq: DataFrame, *labels: str, name: str = "Frequency") -> DataFrame:
    return freq.orderBy(F.desc(name), *labels)


def top_k(freq: DataFrame, k: int, *labels: str, name: str = "Frequency") -> DataFrame:
    return ordered(freq, *labels, name=name).limit(k)


def frequencies(df: DataFrame, column: str, label: str, k: int | None = None) -> DataFrame:
    freq = value_counts(exploded(df, {column: label}), label)
    return freq if k is None else top_k(freq, k, label)


def ranked(df: DataFrame, groups: list[str], count: str, ties: list[str], n: int, rank: str = "Rank") -> DataFrame:
    """The n largest of each group, numbered from 1; the limit goes below the shuffle."""
    order = Window.partitionBy(*groups).orderBy(F.desc(count), *ties)
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)


def yearly_top(df: DataFrame, column: str, label: str, n: int = 3) -> DataFrame:
    """(Year, Rank, label, Session_Count): the n most frequent labels of each year."""
    counts = value_counts(exploded(df, {column: label}, "Year"), "Year", label, name="Session_Count")
    return ranked(counts, ["Year"], "Session_Count", [label], n).select("Year", "Rank", label, "Session_Count")


def top_lines(top: DataFrame, label: str) -> DataFrame:
    """(Year, line): each year's ranking as one line of text."""
    part = F.struct("Rank", F.format_string("No.%d %s (%d)", "Rank", label, "Session_Count").alias("text"))
    return top.groupBy("Year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "  |  ").alias("line"))


def matrix(df: DataFrame, column: str, label: str, k: int) -> DataFrame:
    """(label, Year, Frequency) for the k most frequent labels of dated rows and every year, zeros included.

    Rows are counted once, by label and year; the ranking sums those counts and
    shares their shuffle.
    """
    dated = df.where("Year is not null")
    counts = value_counts(exploded(dated, {column: label}, "Year"), label, "Year")
    top = top_k(counts.groupBy(label).agg(F.sum("Frequency").alias("Frequency")), k, label).select(label)
    return dense(counts.join(top, label, "left_semi"), top, dated, label)


def dense(counts: DataFrame, labels: DataFrame, dated: DataFrame, *keys: str) -> DataFrame:
    """``counts`` with a zero for every key of ``labels`` and every year from the first to the last of ``dated``; K labels by the years."""
    first, last = (dated.agg(f("Year").alias("y")).scalar() for f in (F.min, F.max))
    grid = labels.select(*keys, F.explode(F.when(first.isNotNull(), F.sequence(first, last))).alias("Year"))
    return grid.join(counts, [*keys, "Year"], "left").withColumn("Frequency", F.coalesce("Frequency", F.lit(0)).cast("long"))


def pivoted(long: DataFrame, row: str, column: str, values: list, count: str = "Frequency") -> DataFrame:
    """A long matrix as a wide one; the columns are stated, so no pass is spent on finding them."""
    return long.groupBy(row).pivot(column, values).agg(F.first(count)).na.fill(0)


def topic_shifts(df: DataFrame, owner: str, owners: int, topic: str, topics: int) -> DataFrame:
    """(owner, topic, Year, Frequency): per leading owner its leading topics by year, ranked over pairs, which are counted once."""
    dated = df.where("Year is not null")
    per = value_counts(exploded(dated, {f"{owner}s": owner, f"{topic}s": topic}, "Year"), owner, topic, "Year")
    top = top_k(per.groupBy(owner).agg(F.sum("Frequency").alias("Frequency")), owners, owner).select(owner)
    led = per.join(top, owner, "left_semi")
    total = led.groupBy(owner, topic).agg(F.sum("Frequency").alias("total"))
    chosen = ranked(total, [owner], "total", [topic], topics).select(owner, topic)
    return dense(led, chosen, dated, owner, topic)


def primary_by_year(df: DataFrame, who: str, leaders: int, what: str) -> DataFrame:
    """(Year, who, what, Session_Count): the most frequent partner by year of the leaders over pairs, which are counted once."""
    per = value_counts(exploded(df.where("Year is not null"), {f"{who}s": who, f"{what}s": what}, "Year"), "Year", who, what, name="Session_Count")
    top = top_k(per.groupBy(who).agg(F.sum("Session_Count").alias("Frequency")), leaders, who).select(who)
    return ranked(per.join(top, who, "left_semi"), ["Year", who], "Session_Count", [what], 1).drop("Rank")


def with_top_partner(df: DataFrame, who: str, what: str, out: str, none: str = "(Unknown)") -> DataFrame:
    """(who, Frequency, out): mentions of each and the partner it is mentioned with most.

    Each mention gives a row for itself, with a null partner, and one for each
    partner, so that one count serves both.
    """
    names = df.select(F.explode(f"{who}s").alias(who), f"{what}s").where(F.col(who) != "")
    partners = F.concat(F.array(F.lit(None).cast("string")), F.filter(F.coalesce(f"{what}s", F.expr("cast(array() as array<string>)")), lambda x: x != ""))
    counts = names.select(who, F.explode(partners).alias(what)).groupBy(who, what).agg(F.count("*").alias("n"))
    order = Window.partitionBy(who).orderBy(F.col(what).isNotNull(), F.desc("n"), what)
    # First the mentions, then the leading partner: two rows of each name at most, side by side.
    two = counts.withColumn("place", F.row_number().over(order)).where("place <= 2")
    found = two.groupBy(who).agg(F.max(F.when(F.col("place") == 1, F.col("n"))).alias("Frequency"), F.max(F.when(F.col("place") == 2, F.col(what))).alias(out))
    return found.withColumn(out, F.coalesce(out, F.lit(none)))


def shares(df: DataFrame, column: str, least: float = 0.02, rest: str = "Others") -> DataFrame:
    """(column, Frequency): labels with more than ``least`` of all, the others under ``rest`` with any label of that name."""
    counts = value_counts(df, column)
    total = counts.agg(F.sum("Frequency").alias("total")).scalar()
    label = F.when(F.col("Frequency") > least * total, F.col(column)).otherwise(F.lit(rest))
    return counts.select(label.alias(column), "Frequency").groupBy(column).agg(F.sum("Frequency").alias("Frequency"))


def yearly(df: DataFrame) -> DataFrame:
    return value_counts(df, "Year", name="Session_Count")


def rate(part: Column, whole: Column) -> Column:
    """A percentage to one place; 0 of nothing."""
    return F.round(F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0)), 1)
