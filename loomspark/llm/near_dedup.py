"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of shingles of five words: a shingle weighs its count
in the text times an inverse document frequency. Each of SAMPLES consistent
samples picks a shingle and a level such that two texts pick alike with a
probability equal to their weighted Jaccard similarity. Samples are joined to
bands; texts that share a band are candidates, and a candidate pair is a link
if its exact weighted Jaccard similarity is THRESHOLD or more.

Document frequencies are counted over all documents in a table of hashed
counters of a fixed size, less the mean load that other shingles put on a
counter. The weight is flat below what the table can tell and is damped, so
that what a group of copies shares keeps most of its weight against the edits.

Groups aren't expanded into pairs. Equal texts are one node, numbered when the
table of distinct texts is written. In a band's bucket each node is compared
with one leader, in a large bucket with its most central node, the one whose
bands are the fullest; what links join becomes one component. Only where a
bucket still spans several components are nodes of different components
compared with one another: in a small bucket as pairs; in a large one in
blocks, which leave links alone. An exact bound goes before the blocks: a node
can share with others only those of its shingles that any other node there
has, and if so few can't make 0.8 with a set of any size that the bucket holds,
the node has no link in it. No link is lost and no bucket capped.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.common import Scratch, bounded_batches, entering, keeps, table, texts, written

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
SAMPLES = BANDS * ROWS
#: Counters of document frequencies; rows of the table of random variates; bits of the filter of nodes to verify.
COUNTERS, VARIATES, FILTER_BITS = 1 << 20, 1 << 14, 1 << 24
PART = 1 << 14
#: The least weight of a shingle however frequent.
LEAST_WEIGHT = 0.5
#: A bucket up to this size is compared pair by pair if leaders don't settle it, a larger one in blocks.
SMALL = 16
#: Nodes and shingles that a block holds on average at most; nodes of a block that are compared with one another at once.
BLOCK, BLOCK_SHINGLES, TILE = 2048, 1 << 20, 256
#: Columns of a block's shingles that are multiplied at once.
COLUMNS = 4096
#: Shingles that are sampled at once; what rounding may take from the bound of a key, generously.
CHUNK, SLACK = 1024, np.float32(1e-3)
#: Names of texts without an id of their own lie above all ids.
NO_ID = 1 << 62


MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0xD6E8FEB86659FD93
#: Bytes of a text that are hashed at once.
SEGMENT = 1 << 20


@lru_cache(maxsize=4)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word in lower case: its bytes' polynomial, the same wherever the word stands."""
    raw, out, at = " ".join(text.lower().split()).encode("utf-8", "surrogatepass"), [], 0
    while at < len(raw):
        end = len(raw)
        if end - at > SEGMENT:  # cut between words
            end = raw.rfind(b" ", at, at + SEGMENT)
            end = raw.find(b" ", at + SEGMENT) if end < 0 else end
            end = len(raw) if end < 0 else end
        data = np.frombuffer(raw, np.uint8, end - at, at)
        gaps = np.flatnonzero(data == 32)
        first, last = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
        up, down = powers(1 << max(16, (len(data) - 1).bit_length()))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * up[: len(data)], out=sums[1:])
        out.append(mixed((sums[last] - sums[first]) * down[first]))
        at = end + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and their counts. Fewer words than a shingle has make one; no words, none."""
    w = word_hashes(text)
    if len(w) > SHINGLE:
        h = w[: len(w) - SHINGLE + 1] * MULTIPLIERS[0]
        for k in range(1, SHINGLE):
            h = h + w[k : len(w) - SHINGLE + 1 + k] * MULTIPLIERS[k]
    else:
        h = (w * MULTIPLIERS[: len(w)]).sum(keepdims=True, dtype=np.uint64)[: min(1, len(w))]
    return np.unique(mixed(h), return_counts=True)


def part_rows(counts: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame([(i // PART, zlib.compress(counts[i : i + PART].tobytes(), 1)) for i in range(0, len(counts), PART)], columns=["part", "counts"])


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """Adds the tables of all tasks part by part; the driver gets one table of ``size`` numbers."""

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1, np.int64)
        for c in rows["counts"]:
            total = total + np.frombuffer(zlib.decompress(c), np.int64)
        return pd.DataFrame([(key[0], zlib.compress(total.tobytes(), 1))], columns=["part", "counts"])

    rows = parts.groupBy("part").applyInPandas(add, "part int, counts binary").collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        held = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
        out[r["part"] * PART : r["part"] * PART + len(held)] = held
    return out


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """COUNTERS hashed counts of the documents that hold a shingle, then PART cells of which the first counts documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entering("near_dedup")
        counts = np.zeros(COUNTERS + PART, np.int64)
        for b in batches:
            found = [shingles(t)[0] >> np.uint64(44) for t in b["text"]]
            if found:
                counts[:COUNTERS] += np.bincount(np.concatenate(found).astype(np.int64), minlength=COUNTERS)
            counts[COUNTERS] += len(found)
        yield part_rows(counts)

    return summed(docs.select("text").mapInPandas(count, "part int, counts binary"), COUNTERS + PART)


def inverse_frequencies(counts: np.ndarray) -> np.ndarray:
    """A weight from LEAST_WEIGHT to 1 for each counter."""
    n, load = max(1, int(counts[COUNTERS])), counts[:COUNTERS].mean()
    flat = 2 + 3 * np.sqrt(load)  # below this a count can't be told from its counter's load
    own = np.maximum(counts[:COUNTERS] - load, flat)
    if n <= flat:
        return np.ones(COUNTERS, np.float32)
    return np.clip(np.log(n / own) / np.log(n / flat), LEAST_WEIGHT, 1).astype(np.float32)


@lru_cache(maxsize=1)
def variates() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """r and c of Gamma(2, 1), b of U(0, 1), and the sampling key of weight 1, each (VARIATES, SAMPLES); a shingle's hash names its row.

    A shingle's samples lie side by side: read across, they would be 80 places
    in tables that no core's cache holds.
    """
    g = np.random.default_rng(20240229)
    r, c = g.gamma(2, 1, (2, SAMPLES, VARIATES))
    b = g.random((SAMPLES, VARIATES))
    np.log(c, out=c)
    one = r * b
    one += c
    one -= r
    return tuple(np.ascontiguousarray(x.T, np.float32) for x in (r, c, b, one))


keeps("near_dedup", variates.cache_clear)
keeps("near_dedup", powers.cache_clear)


def least(h: np.ndarray, which: np.ndarray, weights: np.ndarray | None = None, found: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each sample's least key, its shingle and its level, among the shingles ``which`` (of weight 1 without ``weights``) and what was ``found`` before.

    A key is at least log(c) - r less its weight's log, so a weighted shingle's
    key is worked out only where that bound isn't above a key that is known.
    """
    r, c, b, one = variates()
    row = (h & np.uint64(VARIATES - 1)).astype(np.int64)
    every = np.arange(SAMPLES)
    if found is None:
        found = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.int64), np.zeros(SAMPLES, np.int64)
    best, at, level = (x.copy() for x in found)
    for a in range(0, len(which), CHUNK):
        i = which[a : a + CHUNK]
        if weights is None:  # log of the weight is 0, so the level is floor(b) = 0
            keys = one.take(row[i], 0)
            j = keys.argmin(0)
            k, t = keys[j, every], np.zeros(SAMPLES, np.int64)
        else:
            logs = np.log(weights[i]).astype(np.float32)

            def exact(j: np.ndarray, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                place = row[i[j]] * SAMPLES + sample
                rr, bb = r.ravel()[place], b.ravel()[place]
                t = np.floor(logs[j] / rr + bb)
                return c.ravel()[place] - rr * (t - bb + 1), t

            bound = c.take(row[i], 0)
            bound -= r.take(row[i], 0)
            bound -= logs[:, None]
            j = bound.argmin(0)
            known = best if np.isfinite(best).all() else exact(j, every)[0]
            n, sample = np.divmod(np.flatnonzero(bound <= known + SLACK), SAMPLES)
            keys, levels = exact(n, sample)
            k, t = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.int64)
            np.minimum.at(k, sample, keys)
            hit = np.flatnonzero(keys == k[sample])[::-1]  # the first of equal keys is written last
            j[sample[hit]], t[sample[hit]] = n[hit], levels[hit]
        # Ties go to the smaller hash, whatever the order in which they are met.
        better = (k < best) | ((k == best) & (h[i[j]] < h[at]))
        best[better], at[better], level[better] = k[better], i[j][better], t[better]
    return best, at, level


def samples(h: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingle and the level that each sample of a weighted set picks; the set isn't empty."""
    plain, other = np.flatnonzero(weights == 1), np.flatnonzero(weights != 1)
    _, at, level = least(h, other, weights, least(h, plain))
    return h[at], level


def joined(picked: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The BANDS band hashes of samples, for each row of (sets, SAMPLES)."""
    sample = mixed(picked ^ mixed(level.astype(np.uint64) + np.uint64(1)))
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sample), BANDS))
    for k in range(ROWS):
        out = mixed(out * MULTIPLIERS[0] ^ sample[:, k::ROWS])
    return out.view(np.int64)


def all_bands(sets: Iterable[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The BANDS band hashes of each weighted set (hashes in order, weights); none for an empty one."""
    found = [samples(h, w) if len(h) else None for h, w in sets]
    out = [np.zeros(0, np.int64)] * len(found)
    full = [x for x, f in enumerate(found) if f is not None]
    if full:
        for x, row in zip(full, joined(*(np.stack([found[x][k] for x in full]) for k in (0, 1))), strict=True):
            out[x] = row
    return out


def bands(h: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The band hashes of one weighted set."""
    return all_bands([(h, weights)])[0]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weight: Callable[[np.ndarray], np.ndarray]) -> float:
    """The weighted Jaccard similarity of two (hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    wa, wb = a[1] * weight(a[0]), b[1] * weight(b[0])
    shared = np.minimum(wa[i], wb[j]).sum()
    return float(shared / (wa.sum() + wb.sum() - shared))


def packed_set(h: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """(hashes, counts) as bytes; a count of 2**32 or more would need a text of 8 GB."""
    return h.tobytes(), n.astype(np.uint32).tobytes()


def read_set(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.uint32)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, text_id, class_id, class_texts): one row per row of ``docs``.

    ``digest`` names the text and ``text_id`` is the smallest id that has it;
    ``class_id`` is the smallest ``text_id`` among the texts that links join it
    to, and ``class_texts`` their number. Equal texts are one class, also null
    and empty ones, which link to nothing else. Texts without words link to
    equal ones alone. Rows that share an id but not the text are looked at
    each: of several texts with the same smallest id the one with the smallest
    digest has it as ``text_id``; the others, like texts without any id, get a
    number above all ids from their digest. Very long texts are read whole; an
    empty table gives no rows; other columns are ignored.
    """
    with Scratch(docs.sparkSession, "near-dedup") as s:
        signed, named = _solved(s, docs, id_col, text_col)
        found = signed.select("doc_id", "digest").join(named.drop("min_id"), "digest")
        return written(found.select("doc_id", "digest", "text_id", "class_id", "class_texts"), "classes")


def _solved(s: Scratch, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest, …) and distinct texts (digest, min_id, text_id, class_id, class_texts), both in ``s``."""
    bounded_batches(s.spark)
    rows = texts(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    idf = s.broadcast(inverse_frequencies(document_frequencies(rows)))  # COUNTERS floats: 4 MB

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("near_dedup")
        weight = idf.value
        for b in batches:
            out = all_bands((h, n * weight[(h >> np.uint64(44)).astype(np.int64)]) for h, n in map(shingles, b.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "digest", "bands"])

    digest = F.unhex(F.sha2(F.col("text"), 256))
    signed = s.written(rows.select("doc_id", digest.alias("digest"), "text").mapInArrow(sign, "doc_id long, digest binary, bands array<long>"), "signatures")
    # A number for every distinct text; it is fixed once the table is written, and no result depends on its value.
    distinct = signed.groupBy("digest").agg(F.min("doc_id").alias("min_id"), F.first("bands").alias("bands"))
    nodes = s.written(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = _buckets(s, nodes.select("node", F.explode("bands").alias("band")))

    # Round 1: every node against its bucket's leader.
    done = _pairs(s, members.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    links, sets = _verified(s, rows, nodes, done, idf)
    label = components(s, links)

    # Round 2: buckets that still span components.
    open_ = _unsettled(s, members, label)
    more = _pairs(s, _cross(open_.where(F.col("n") <= SMALL), nodes), done)
    found = []
    if not more.isEmpty():
        found.append(_verified(s, rows, nodes, more, idf)[0])
    large = open_.where(F.col("n") > SMALL)
    if not large.isEmpty():
        found.append(_block_links(s, _possible(s, large, sets, idf), sets, idf))
    for extra in found:
        links = links.unionByName(extra)
    if found:
        label = components(s, s.written(links.distinct(), "links"))
    return signed, _named(s, nodes, label)


def _named(s: Scratch, nodes: DataFrame, label: DataFrame) -> DataFrame:
    """(digest, min_id, text_id, class_id, class_texts) of every distinct text.

    Tables that are grouped are written before they are joined, so that both
    sides of a join are dealt for it alone and a hot id or class can be split.
    """
    own = F.lit(NO_ID) + F.pmod(F.xxhash64("digest"), F.lit(NO_ID - 1))
    texts_ = nodes.select("digest", "node", "min_id", F.coalesce("min_id", own).alias("text_id"))
    twice = s.written(nodes.where("min_id is not null").groupBy("min_id").agg(F.count("*").alias("n"), F.min("digest").alias("first")).where("n > 1").drop("n"), "shared-ids")
    if not twice.isEmpty():
        texts_ = texts_.join(twice, "min_id", "left").withColumn("text_id", F.when(F.col("digest") != F.col("first"), own).otherwise(F.col("text_id"))).drop("first")
    named = s.written(texts_.join(label, "node", "left").select("digest", "min_id", "text_id", F.coalesce("label", "node").alias("label")), "named")
    best = s.written(named.groupBy("label").agg(F.min("text_id").alias("class_id"), F.count("*").alias("class_texts")), "class-ids")
    return s.written(named.join(best, "label").drop("label"), "texts")


def _buckets(s: Scratch, members: DataFrame) -> DataFrame:
    """(band, node, n, leader): members of bands' buckets of two nodes or more.

    Everything about a bucket is a sum or an extremum, so one of any size costs
    a row a task. The tables are written before they are joined, so that both
    sides of a join are dealt for it alone and a hot bucket can be split.
    """
    counts = s.written(members.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"), "counts")
    members = s.written(members.join(counts, "band"), "members")
    central = members.groupBy("node").agg(F.sum("n").alias("fullness"))
    order = F.col("fullness") * (1 << 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20))
    lead = members.where(F.col("n") > SMALL).join(central, "node").groupBy("band").agg(F.max_by("node", order).alias("center"))
    lead = s.written(lead, "leaders")
    return s.written(members.join(lead, "band", "left").select("band", "node", "n", F.coalesce("center", "least").alias("leader")), "buckets")


def _unsettled(s: Scratch, members: DataFrame, label: DataFrame) -> DataFrame:
    """Members, with ``label``, of the buckets whose nodes have more than one label. Buckets of two were compared in full."""
    named = s.written(members.where("n > 2").join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    open_ = s.written(named.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("band"), "open")
    return s.written(named.join(open_, "band"), "unsettled")


def _cross(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of nodes of different labels in a bucket, each in the first band alone that the two share."""
    full = members.join(nodes.select("node", "bands"), "node")
    x, y = full.alias("x"), full.alias("y")
    place = F.array_position("x.bands", F.col("x.band"))
    before = F.slice("x.bands", 1, (place - 1).cast("int"))
    on = (F.col("x.band") == F.col("y.band")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & ~F.arrays_overlap(before, "y.bands")
    return x.join(y, on).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _block_links(s: Scratch, members: DataFrame, sets: DataFrame, idf) -> DataFrame:
    """Links between nodes of different labels in a bucket, for each node and other label the best of two blocks.

    A bucket's nodes are dealt into blocks of a bounded number of nodes and
    shingles, and every two blocks meet in one task, tile by tile; of what they
    hold only links come out. Sets are shipped once for each block they meet:
    the bucket's shingles over BLOCK_SHINGLES times, or its nodes over BLOCK.
    """
    load = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    counts = s.written(members.groupBy("band").agg(load.alias("blocks")), "blocks")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.select("band", "node", "label").join(counts, "band").withColumn("own", own)
    # A node of block i goes to the meetings of i with every block.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label")
    dealt = dealt.join(sets.select("node", "s.hashes", "s.counts"), "node")

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        held = [read_set(h, c) for h, c in zip(rows["hashes"], rows["counts"], strict=True)]
        weight = lambda h: idf.value[(h >> np.uint64(44)).astype(np.int64)]
        label, node = rows["label"].to_numpy(), rows["node"].to_numpy()
        sides = [np.flatnonzero(rows["own"] == k) for k in key[1:]]
        best: dict[tuple, tuple] = {}
        tiles = [[side[a : a + TILE] for a in range(0, len(side), TILE)] for side in sides]
        for x, left in enumerate(tiles[0]):
            for right in tiles[1][x if key[1] == key[2] else 0 :]:
                both = np.union1d(left, right)
                good = likely([held[i] for i in both], weight)[np.ix_(np.searchsorted(both, left), np.searchsorted(both, right))]
                for p, q in np.argwhere(good & (label[left][:, None] != label[right][None])):
                    p, q = left[p], right[q]
                    if (node[p], label[q]) in best and (node[q], label[p]) in best:
                        continue
                    if similarity(held[p], held[q], weight) >= THRESHOLD:
                        pair = min(node[p], node[q]), max(node[p], node[q])
                        best.setdefault((node[p], label[q]), pair)
                        best.setdefault((node[q], label[p]), pair)
        return pd.DataFrame(sorted(set(best.values())), columns=["a", "b"], dtype="int64")

    return s.written(dealt.groupBy("band", "i", "j").applyInPandas(meet, "a long, b long").distinct(), "links")


def likely(held: list[tuple[np.ndarray, np.ndarray]], weight: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Which pairs may be links, by a bound on the weighted similarity that is exact for counts of 1."""
    h = np.concatenate([x for x, _ in held])
    owner = np.repeat(np.arange(len(held)), [len(x) for x, _ in held])
    w = np.concatenate([n * weight(x) for x, n in held])
    heavy = np.bincount(owner, w, len(held))
    _, column, often = np.unique(h, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often[column] > 1)  # what one set alone has counts for its weight, not for what it shares
    order = shared[np.argsort(column[shared], kind="stable")]
    column = np.unique(column[order], return_inverse=True)[1]
    common = np.zeros((len(held), len(held)))
    for a in range(0, int(column.max()) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        one, much = (np.zeros((len(held), COLUMNS), np.float32) for _ in range(2))
        at = owner[order[lo:hi]], column[lo:hi] - a
        one[at], much[at] = 1, w[order[lo:hi]]
        common += much @ one.T
    common = np.minimum(common, common.T)
    return common * (1 + THRESHOLD) >= THRESHOLD * (heavy[:, None] + heavy[None]) * (1 - 1e-4) - 1e-2


def _possible(s: Scratch, members: DataFrame, sets: DataFrame, idf) -> DataFrame:
    """Members that may have a link to another label in their bucket, with ``size``, ``weight``, ``common``.

    ``common`` is the weight of the shingles that another of these nodes may
    have, by hashed counters: it errs upwards only.
    """
    nodes = members.select("node").distinct()
    held = s.written(sets.join(nodes, "node"), "held").select("node", "s.hashes", "s.counts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for b in batches:
            h = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64)
            counts += np.bincount((h & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        yield pa.RecordBatch.from_pandas(part_rows(counts), schema=pa.schema([("part", pa.int32()), ("counts", pa.binary())]))

    often = summed(held.mapInArrow(count, "part int, counts binary"), COUNTERS) > 1
    seen = s.broadcast(np.packbits(often))  # COUNTERS bits

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(seen.value).astype(bool)
        for b in batches:
            out = []
            for h, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                h, n = read_set(h, n)
                w, own = n * idf.value[(h >> np.uint64(44)).astype(np.int64)], bits[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]
                out.append((len(h), float(w.sum()), float(w[own].sum())))
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.float64(), pa.float64()), strict=True))], names=["node", "size", "weight", "common"])

    sized = s.written(held.mapInArrow(measure, "node long, size int, weight double, common double"), "sized")
    full = s.written(members.join(sized, "node"), "measured")
    # Weights that a bucket holds, in whole numbers: as many as there are lengths of texts at most.
    there = s.written(full.groupBy("band").agg(F.collect_set(F.floor("weight").cast("long")).alias("weights")), "sizes")
    # A similar set weighs at least THRESHOLD of this one, and at most what is left once the shared part is counted.
    slack = F.lit(1e-6) + F.col("weight") * 1e-6
    most = F.col("common") * (1 + THRESHOLD) / THRESHOLD - F.col("weight") + slack
    fits = F.exists("weights", lambda w: (w + 1 >= F.col("weight") * THRESHOLD - slack) & (w <= most))
    return s.written(full.join(there, "band").where(fits).drop("weights"), "possible")


def _pairs(s: Scratch, pairs: DataFrame, done: DataFrame | None = None) -> DataFrame:
    pairs = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return s.written(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")


def _verified(s: Scratch, rows: DataFrame, nodes: DataFrame, pairs: DataFrame, idf) -> tuple[DataFrame, DataFrame]:
    """Those of ``pairs`` whose exact similarity is THRESHOLD or more, and the sets (node, s) of all nodes in pairs.

    Only nodes in a pair need their shingles: a filter of a fixed number of
    bits, no larger for more nodes, spares the others the shuffle.
    """
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = s.written(nodes.join(involved, "node", "left_semi").select("digest", "node"), "wanted")

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(FILTER_BITS, bool)
        for b in batches:
            seen[b["bit"].to_numpy()] = True
        yield part_rows(np.packbits(seen).view(np.int64))

    # Every bit comes once, so that adding the tasks' words sets each of them.
    positions = wanted.select(F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS)).cast("int").alias("bit")).distinct()
    packed = summed(positions.mapInPandas(bits, "part int, counts binary"), FILTER_BITS // 64)
    seen = s.broadcast(packed.view(np.uint8))  # FILTER_BITS: 2 MB

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = b.column(1).to_numpy()
            b = b.filter(pa.array((seen.value[bit >> 3] >> (7 - (bit & 7))) & 1 == 1))
            found = [packed_set(*shingles(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[k] for f in found], pa.binary()) for k in (0, 1))], names=["digest", "hashes", "counts"])

    digest = F.unhex(F.sha2(F.col("text"), 256))
    found = rows.select(digest.alias("digest"), F.pmod(F.xxhash64(digest), F.lit(FILTER_BITS)).cast("int").alias("bit"), "text").mapInArrow(sets, "digest binary, hashes binary, counts binary")
    # Copies of a text hold equal sets: one of them, found before the shuffle.
    found = found.join(wanted, "digest").groupBy("node").agg(F.first(F.struct("hashes", "counts")).alias("s"))
    found = s.written(found, "sets")
    both = pairs.join(found.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(found.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    flat = both.select("a", "b", "sa.hashes", "sa.counts", F.col("sb.hashes").alias("hashes2"), F.col("sb.counts").alias("counts2"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = lambda h: idf.value[(h >> np.uint64(44)).astype(np.int64)]
        for b in batches:
            c = [b.column(i).to_pylist() for i in range(2, 6)]
            good = [similarity(read_set(h, n), read_set(h2, n2), weight) >= THRESHOLD for h, n, h2, n2 in zip(*c, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return s.written(flat.mapInArrow(judge, "a long, b long"), "links"), found


def components(s: Scratch, links: DataFrame) -> DataFrame:
    """(node, label): the least node of each linked node's component; by least neighbour and shortcuts until nothing changes."""
    both = s.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = s.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        step = s.written(step, "labels")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = s.written(step.join(jump, "label", "left").select("node", "old", F.coalesce("next", "label").alias("label")), "labels")
        label = new.select("node", "label")
        if new.where("old != label").isEmpty():
            return label


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, that of its smallest id, and the columns they had.

    Null and empty texts are one text, of which one row stays; a text without
    words stays once. Of rows that are equal in id and text one stays, the one
    with the smallest hash of all its columns; a row without an id stays only
    where no row with an id has its text. Very long texts are compared whole,
    other columns are carried along whatever their names, and an empty table
    gives no rows.
    """
    with Scratch(docs.sparkSession, "keep-one") as s:
        signed, named = _solved(s, docs, id_col, text_col)
        kept = named.where("text_id = class_id").select(F.coalesce("min_id", F.lit(NO_ID)).alias("id"), "digest")
        kept = written(kept, "kept")  # narrow: a number and a digest of each class
        # Rows that are equal in id and text, if there are any: found without the texts.
        own = signed.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "digest")
        repeated = s.written(own.groupBy("id", "digest").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
        again = not repeated.join(kept, ["id", "digest"], "left_semi").isEmpty()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    packed = docs.select(row, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))
    if again:  # the limit goes below the shuffle: each task leaves one of its equal rows
        order = Window.partitionBy("id", "digest").orderBy(F.xxhash64("row"))
        packed = packed.withColumn("n", F.row_number().over(order)).where("n = 1")
    return packed.join(kept, ["id", "digest"], "left_semi").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near duplicates."""
    return classes(table(spark, sf_dir, "documents")).drop("digest")
