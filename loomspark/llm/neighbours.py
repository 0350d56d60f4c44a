"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample; every vector is indexed: it goes down
to the leaf whose centroids it is nearest to. A query keeps the nodes it has
passed in a priority queue and opens the nearest first, until it has come to as
many leaves as the calibration asks for. The calibration compares a bounded
number of vectors, none of which the tree was fitted on, with all others, and
widens the number of leaves until the leaves hold enough of their true
neighbours. Answers come from the opened leaves alone; should these hold too
few vectors, a query goes on to the next leaves until there are enough.

Equal vectors are one entry with their smallest ids, as many as a result can
show, so a vector that fills a third of the table costs one entry. Leaves that
follow one another in the tree make a region of a bounded number of vectors; a
leaf with more is dealt into blocks. A task holds a block of a region and a
bounded number of the queries that open any of its leaves, and leaves no more
of each query than a result can show, so what is gathered for a query grows
with the regions it touches and not with the leaves or the vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.common import Scratch, bounded_batches, table, written

K, EVERY = 10, 100
#: Bounds: vectors and bytes of vectors that the tree is fitted on, of every SHARE vectors one at most; vectors that the calibration compares with all.
SAMPLE, SAMPLE_BYTES, SHARE, CALIBRATION = 20_000, 16 << 20, 4, 200
#: Vectors of a task's block of a region, and queries that meet it at once.
BLOCK, QUERIES = 4096, 4096
BRANCH, LEAF_SAMPLE, LEAF_ROWS, ROUNDS = 8, 8, 100, 8
#: The share of true neighbours that the visited leaves must hold for the calibration's vectors.
RECALL = 0.97


@dataclass
class Tree:
    """Nodes by number: ``children[i]`` and their centroids, or none and ``leaf[i]``."""

    children: list[np.ndarray]
    centroids: list[np.ndarray]
    leaf: list[int]
    leaves: int

    @staticmethod
    def fit(x: np.ndarray, most: int, seed: int = 1) -> Tree:
        """``most``: sample vectors of a leaf at most, unless they are all alike."""
        r = np.random.default_rng(seed)
        tree = Tree([], [], [], 0)

        def add(points: np.ndarray) -> int:
            me = len(tree.leaf)
            tree.children.append(np.zeros(0, int)), tree.centroids.append(np.zeros((0, x.shape[1]))), tree.leaf.append(-1)
            parts = split(points) if len(points) > most else []
            if len(parts) < 2:
                tree.leaf[me], tree.leaves = tree.leaves, tree.leaves + 1
                return me
            tree.centroids[me] = np.stack([x[p].mean(0) for p in parts])
            tree.children[me] = np.array([add(p) for p in parts])
            return me

        def split(points: np.ndarray) -> list[np.ndarray]:
            v = x[points]
            k = min(BRANCH, -(-len(points) // most) + 1)
            c = v[r.choice(len(v), k, replace=False)]
            for _ in range(ROUNDS):
                to = nearest(v, c)
                c = np.stack([v[to == j].mean(0) if (to == j).any() else c[j] for j in range(k)])
            to = nearest(v, c)
            return [points[to == j] for j in range(k) if (to == j).any()]

        add(np.arange(len(x)))
        return tree

    def assign(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(v), np.int64)
        todo = [(0, np.arange(len(v)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                to = nearest(v[rows], self.centroids[node])
                todo += [(int(self.children[node][j]), rows[to == j]) for j in np.unique(to)]
        return out

    def visits(self, q: np.ndarray, most: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """Leaves in best-bin-first order: ``most`` of them, or more until they hold ``least`` vectors by ``held``."""
        queue, out, seen = [(0.0, 0)], [], 0
        while queue and (len(out) < most or seen < least):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                seen += 0 if held is None else int(held[self.leaf[node]])
                continue
            d = ((self.centroids[node] - q) ** 2).sum(1)
            for far, child in zip(d.tolist(), self.children[node].tolist(), strict=True):
                heapq.heappush(queue, (far, child))
        return out


def nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1)[None] - 2 * v @ c.T).argmin(1)


def distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from the differences themselves."""
    return np.sqrt(((v - q) ** 2).sum(1))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in column]) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows whose vector is finite, not zero and of the commonest length (the longest of tied ones)."""
    v = F.col("v")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id is not null and v is not null").where(good)
    size = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return rows.where(F.size("v") == (size[0]["size"] if size else 0))


def neighbours(vectors: DataFrame, k: int = K, every: int = EVERY, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` nearest found of every row whose id ``every`` divides.

    A row is no candidate for its own id. Vectors that are null, zero, of
    another length than most or that hold nulls or non-finite numbers take no
    part, nor do rows with a null id; rows equal in id and vector count once.
    Ties go to the smaller id. Fewer candidates than ``k`` are all returned.
    A ``recall`` of 1 opens every leaf, which makes the answer exact. An empty
    table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    with Scratch(spark, "neighbours") as s:
        found = _search(s, vectors, k, every, recall, id_col, vector_col)
        return spark.createDataFrame([], RESULT) if found is None else written(found, "found")


RESULT = "query_id long, rank int, vec_id long, score double"


def _search(s: Scratch, vectors: DataFrame, k: int, every: int, recall: float, id_col: str, vector_col: str) -> DataFrame | None:
    spark = s.spark
    bounded_batches(spark)
    rows = usable(vectors, id_col, vector_col).withColumn("h", F.xxhash64("v"))
    # Of equal vectors the k + 1 smallest ids; Spark limits the group before it shuffles too.
    order = Window.partitionBy("h", "v").orderBy("vec_id")
    entries = (
        rows.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= k + 1)
        .groupBy("h", "v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    )
    entries = s.written(entries.select("v", "ids"), "vectors")
    total = entries.count()
    if not total:
        return None
    # The order of the hashes is no order of the vectors: the first are the sample, the next are asked about.
    size = len(entries.first()["v"])
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * size), -(-total // SHARE)))
    drawn = matrix(entries.orderBy(F.xxhash64("v"), "v").limit(most + CALIBRATION).select("v").toPandas()["v"])
    points, held_out = drawn[:most], drawn[most:]
    tree = Tree.fit(points, max(LEAF_SAMPLE, int(np.ceil(len(points) * LEAF_ROWS / total))))

    def to_leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(leaf=tree.assign(matrix(b["v"])) if len(b) else [])

    kind = entries.schema["v"].dataType.simpleString()
    indexed = s.written(entries.mapInPandas(to_leaf, f"v {kind}, ids array<long>, leaf long"), "leaves")
    held = np.zeros(tree.leaves, np.int64)  # a number for each leaf: as many as the sample's size allows
    for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        held[r["leaf"]] = r["n"]
    open_ = tree.leaves if recall >= 1 or not len(held_out) else calibrate(indexed, tree, held_out, k, recall)
    region, blocks = regions(held)

    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "h", "v")
    distinct = s.written(asked.groupBy("h", "v").agg(F.min("vec_id").alias("q")), "queries")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for q, v in zip(b["q"], b["v"], strict=True):
                leaves = tree.visits(np.asarray(v, float), open_, held, k + 1)
                by: dict[int, list[int]] = {}
                for leaf in leaves:
                    if held[leaf]:
                        by.setdefault(int(region[leaf]), []).append(leaf)
                out += [(q, v, r, own) for r, own in by.items()]
            yield pd.DataFrame(out, columns=["q", "v", "region", "leaves"])

    routed = s.written(distinct.select("q", "v").mapInPandas(route, f"q long, v {kind}, region long, leaves array<long>"), "routed")
    meets = {r["region"]: -(-r["n"] // QUERIES) for r in routed.groupBy("region").agg(F.count("*").alias("n")).collect()}
    # A row for each leaf, and for each region: their number is bounded by the sample.
    places = spark.createDataFrame([(i, int(region[i]), int(blocks[region[i]]), meets.get(int(region[i]), 0)) for i in range(tree.leaves)], "leaf long, region long, blocks int, meets int")
    there = indexed.join(F.broadcast(places), "leaf").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    there = there.where("meets > 0").select("region", "block", "leaf", "v", "ids", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)).alias("meet"))
    sizes = places.select("region", "blocks", "meets").distinct()
    here = routed.join(F.broadcast(sizes), "region").withColumn("meet", F.pmod(F.xxhash64("q"), F.col("meets")).cast("int"))
    here = here.select("region", "q", "v", "leaves", "meet", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def best(there: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(there) and len(here):
            v, leaf, ids = matrix(there["v"]), there["leaf"].to_numpy(), there["ids"].to_list()
            least = np.array([i[0] for i in ids])
            for q, x, leaves in zip(here["q"], here["v"], here["leaves"], strict=True):
                i = np.flatnonzero(np.isin(leaf, leaves))
                d = distances(np.asarray(x, float), v[i])
                if len(i) > k + 1:  # all up to the k + 1 least distances, ties included
                    near = np.flatnonzero(d <= np.partition(d, k)[k])
                    i, d = i[near], d[near]
                out += [(q, float(d[j]), ids[i[j]]) for j in np.lexsort((least[i], d))[: k + 1]]
        return pd.DataFrame(out, columns=["q", "score", "ids"])

    by = ("region", "block", "meet")
    found = there.groupBy(*by).cogroup(here.groupBy(*by)).applyInPandas(best, "q long, score double, ids array<long>")
    near = found.select("q", "score", F.explode("ids").alias("vec_id"))
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1)
    near = near.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    answers = s.written(distinct.join(near, "q").select("h", "v", "near"), "answers")
    # The queries that share a vector share its answer, each without itself.
    own = asked.distinct().join(answers, ["h", "v"]).select(F.col("vec_id").alias("query_id"), "near")
    own = own.select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("place", "x")).select("query_id", (F.col("place") + 1).alias("rank"), "x.vec_id", "x.score")


def regions(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The region of each leaf, and the blocks of each region: leaves on end, together at most BLOCK vectors, or one larger leaf."""
    region, blocks, size = np.zeros(len(held), np.int64), [], 0
    for leaf, n in enumerate(held.tolist()):
        if not blocks or size + n > BLOCK:
            blocks.append(1)
            size = 0
        size += n
        region[leaf] = len(blocks) - 1
        blocks[-1] = max(1, -(-size // BLOCK))
    return region, np.array(blocks, np.int64)


def calibrate(indexed: DataFrame, tree: Tree, queries: np.ndarray, k: int, recall: float) -> int:
    """The least number of leaves that hold ``recall`` of the true ``k`` neighbours of ``queries`` on average."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[list[tuple[float, int]]] = [[] for _ in queries]
        for b in batches:
            if len(b):
                v, leaf = matrix(b["v"]), b["leaf"].to_numpy()
                for held, q in zip(kept, queries, strict=True):
                    d = distances(q, v)
                    i = d.argpartition(min(k, len(d) - 1))[: k + 1]
                    held[:] = sorted([*held, *zip(d[i].tolist(), leaf[i].tolist(), strict=True)])[: k + 1]
        yield pd.DataFrame([(c, d, leaf) for c, held in enumerate(kept) for d, leaf in held], columns=["c", "d", "leaf"])

    truth = indexed.select("v", "leaf").mapInPandas(scan, "c int, d double, leaf long")
    truth = truth.withColumn("n", F.row_number().over(Window.partitionBy("c").orderBy("d", "leaf"))).where(F.col("n") <= k + 1)
    depth = []
    at = [{leaf: i + 1 for i, leaf in enumerate(tree.visits(q, tree.leaves))} for q in queries]
    for r in truth.where("n > 1").select("c", "leaf").collect():  # the first is the vector itself
        depth.append(at[r["c"]][r["leaf"]])
    depth.sort()
    return depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)] if depth else 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth embedding."""
    return neighbours(table(spark, sf_dir, "embeddings"))
