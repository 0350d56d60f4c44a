"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (native).

The ring has 2**bits slots. Every shard owns ``vnodes`` virtual nodes on it, at
places that depend on the shard alone, so a shard keeps its places when another
is added. A key falls into the slot that the top bits of its hash name and
belongs to the first virtual node clockwise. A shard takes no more than its
bound; keys beyond it continue clockwise to the next shard that has room. With
bounds that sum to the number of rows the counts end at most one apart.

Keys of one slot stand in for one another, so the overflow is worked out on
the histogram over slots (at most 2**bits rows, whatever the input) instead of
key by key. Each row then finds its shard by its rank within its slot: one
shuffle of narrow rows, no text in it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.common import table

SHARDS, VNODES, RING_BITS = 40, 128, 14


def ring(shards: int, vnodes: int = VNODES, bits: int = RING_BITS) -> list[tuple[int, int]]:
    """(slot, shard) of every virtual node in clockwise order; of two in one slot the smaller shard comes first."""
    place = lambda s, r: int.from_bytes(hashlib.blake2b(f"{s}:{r}".encode(), digest_size=8).digest(), "big") >> (64 - bits)
    return sorted((place(s, r), s) for s in range(shards) for r in range(vnodes))


def bounded_loads(counts: dict[int, int], nodes: list[tuple[int, int]], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Segments (slot, first rank, end rank, shard, first place in the shard) that take every key of ``counts``.

    In each round the slots offer, in clockwise order, what is left of them to
    the virtual node they have come to; a shard accepts up to its bound.
    """
    if sum(bounds) < sum(counts.values()):
        raise ValueError("the bounds are smaller than the number of keys")
    at = [slot for slot, _ in nodes]
    used = [0] * len(bounds)
    pending = [(slot, 0, n, bisect_left(at, slot) % len(nodes)) for slot, n in sorted(counts.items()) if n]
    out = []
    while pending:
        later = []
        for slot, done, n, node in pending:
            shard = nodes[node][1]
            take = min(n - done, bounds[shard] - used[shard])
            if take:
                out.append((slot, done, done + take, shard, used[shard]))
                used[shard] += take
            if done + take < n:
                node = (node + 1) % len(nodes)
                while used[nodes[node][1]] >= bounds[nodes[node][1]]:
                    node = (node + 1) % len(nodes)
                later.append((slot, done + take, n, node))
        pending = later
    return out


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, bits: int = RING_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row in one of ``shards`` shards, counts at most one apart.

    ``slot`` numbers a shard's rows from 0 without gaps. Null texts count as
    empty (size 16, crc32 0). A null id is a key like any other; rows that
    share an id share a ring slot and are told apart by their text's checksum,
    equal rows in any order. An empty table gives an empty result. Columns
    other than the two named are ignored.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    place = F.shiftrightunsigned(key, 64 - bits).cast("int")
    counts = {r["place"]: r["n"] for r in docs.select(place.alias("place")).groupBy("place").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    bounds = [total // shards + (s < total % shards) for s in range(shards)]
    segments = spark.createDataFrame(bounded_loads(counts, ring(shards, vnodes, bits), bounds), "place int, low long, high long, shard int, first long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"), place.alias("place"),
    )
    rank = F.row_number().over(Window.partitionBy("place").orderBy("key", "doc_id", "text_crc32", "size")) - 1
    # At most 2**bits segments and one more for each shard that fills within a slot: well under a MB.
    return (
        rows.withColumn("rank", rank.cast("long")).join(F.broadcast(segments), "place")
        .where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - F.col("low")).alias("slot"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards under the law ``rows``."""
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
