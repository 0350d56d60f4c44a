"""What SQL can decide of the operators: queries that run an operator over its whole table, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import fingerprints, near_dedup, neighbours, packing, pieces, pii, quality, sharding, token_counts, toxicity
from loomspark.llm.common import fresh_path, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


@check("cached_counts", "SELECT doc_id, octet_length(encode(text)) AS n_bytes, TRUE AS same, TRUE AS marked FROM documents")
def cached_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts from a cache that a first run has filled: bytes, and whether both runs agree."""
    docs, cache = table(spark, sf_dir, "documents"), fresh_path(spark, "token-cache")
    first, again = (token_counts.token_counts(docs, cache) for _ in range(2))
    both = first.join(again.select("doc_id", F.col("n_tokens").alias("again")), "doc_id")
    return both.select("doc_id", "n_bytes", (F.col("n_tokens") == F.col("again")).alias("same"), (F.col("over_limit") == (F.col("n_tokens") > token_counts.LIMIT)).alias("marked"))


def _fold_sql(parts: int, held_out: int) -> str:
    """crc32 of the id as text, bit by bit."""
    steps = "flatten(list_transform(range(1, length(s) + 1), lambda i: [ascii(substr(s, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"SELECT doc_id, xor({crc}, 4294967295) % {parts} = {held_out} AS held_out, TRUE AS consistent FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents)"


def _folds(query: Query, threshold: float) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        right = F.col("score").between(0, 1) & (F.col("predicted") == (F.col("score") >= threshold).cast("int"))
        return query(spark, sf_dir).select("doc_id", "held_out", right.alias("consistent"))

    return run


check("quality_folds", _fold_sql(4, 2))(_folds(quality.query, quality.THRESHOLD))
check("toxicity_folds", _fold_sql(5, 0))(_folds(toxicity.query, toxicity.THRESHOLD))


@check(
    "edited_texts",
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt FROM d)
SELECT doc_id, n AS n_chars, sha256(left(t, n - n // 4) || left(nt, n // 4)) AS edited_sha256 FROM n""",
)
def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.query(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


@check(
    "exact_neighbours",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS k FROM p)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM r WHERE k <= 10""",
)
def exact_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search with every leaf opened, which makes it exact."""
    found = neighbours.neighbours(table(spark, sf_dir, "embeddings"), recall=1.0)
    return found.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@check("packed_whole", "SELECT doc_id, TRUE AS whole FROM documents")
def packed_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pieces of each document lie end to end and hold all its tokens."""
    p = packing.query(spark, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"), F.array_sort(F.collect_list(F.struct("start", "length"))).alias("p"))
    gapless = F.forall(F.transform("p", lambda x, i: x["start"] == F.when(i == 0, F.lit(0)).otherwise(F.get("p", i - 1)["start"] + F.get("p", i - 1)["length"])), lambda x: x)
    return p.select("doc_id", ((F.col("n") == F.col("all")) & gapless).alias("whole"))


@check("equal_texts", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS text_id, TRUE AS least FROM documents")
def equal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each document by its smallest id, and whether its class has none larger."""
    return near_dedup.query(spark, sf_dir).select("doc_id", "text_id", (F.col("class_id") <= F.col("text_id")).alias("least"))


def _spans_sql() -> str:
    """The base patterns as the contract has them, matches placed by what lies between them."""
    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE"),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_bool_and(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) <= 255))"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", "length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(d, length(d) - i, 1) AS INTEGER) "
                 "ELSE 2 * CAST(substr(d, length(d) - i, 1) AS INTEGER) - CASE WHEN substr(d, length(d) - i, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 10 AND 15"),
    }
    parts = []
    for order, (kind, (pattern, passes)) in enumerate(patterns.items()):
        parts.append(
            f"SELECT doc_id, {order} AS o, '{kind}' AS kind, a, a + length(v) AS e FROM (SELECT doc_id, v, a, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM (SELECT doc_id, m[i] AS v, "
            f"coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i "
            f"FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM documents) WHERE len(m) > 0))) WHERE {passes}"
        )
    spans = " UNION ALL ".join(parts)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in patterns)
    return f"WITH s AS ({spans}) SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY a, o), '')) AS base_sha256 FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"


@check("base_spans", _spans_sql())
def base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(spark, sf_dir).drop("spans")


@check("decoded_texts", "SELECT doc_id, sha256(text) AS decoded_sha256 FROM documents")
def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the decoder gives back: this model's map is empty, so the text itself."""
    return pieces.query(spark, sf_dir).select("doc_id", "decoded_sha256")


@check("shard_sizes", "SELECT doc_id, octet_length(encode(text)) + 16 AS size FROM documents")
def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(spark, sf_dir).select("doc_id", "size")


@check("shard_loads", "SELECT CAST(s AS INTEGER) AS shard, n // 40 + CASE WHEN s < n % 40 THEN 1 ELSE 0 END AS n_rows, 0::BIGINT AS first, n // 40 + CASE WHEN s < n % 40 THEN 1 ELSE 0 END - 1 AS last FROM (SELECT count(*) AS n FROM documents), (SELECT unnest(range(40)) AS s)")
def shard_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and slots of every shard."""
    return sharding.query(spark, sf_dir).groupBy("shard").agg(F.countDistinct("slot").alias("n_rows"), F.min("slot").alias("first"), F.max("slot").alias("last"))
