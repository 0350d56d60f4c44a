"""Token counts through a digest cache.

Every text is reduced to the digest of its normalised content. Those digests,
with the digest of the tokenizer's file, are joined to a stored table of
counts; only distinct contents that the table lacks are encoded, and their
counts are appended to it. Content is normalised in ways that can't change a
count: a null is an empty text, and the rest is left alone, since the byte-level
tokenizer has no normaliser of its own.

Digests are looked up before any text moves. When the cache lacks nothing, no
text is shuffled; when it lacks few, their digests are broadcast and theirs are
the only texts that move; else texts are shuffled once, after each task has
left one of its equal ones.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import Scratch, bounded_batches, entering, fresh_path, table, texts, written

LIMIT = 512
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
SPECIAL = "<|endoftext|>"
#: Digests of missing contents that are broadcast at most: 32 bytes each.
FEW = 100_000


class TokenCounter:
    """Counts as the library for the .json file gives them, special strings taken as their token.

    The .tiktoken file holds the same merges. Texts of plain Latin letters go
    that quicker way, cut at special strings; any other goes to the library.
    """

    PLAIN = re.compile(r"[\t\n\r -~¡-ɏ]*\Z")
    #: Runs that the quicker encoder would take in time beyond their length.
    RUN = re.compile(r"\S{2000}|\s{2000}")

    def __init__(self, json_path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(json_path)
        self.quick = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def counts(self, values: list[str]) -> list[int]:
        out = [-1] * len(values)
        slow = []
        for i, t in enumerate(values):
            if self.quick is None or not self.PLAIN.match(t) or self.RUN.search(t):
                slow.append(i)
            else:
                parts = t.split(SPECIAL)
                out[i] = len(parts) - 1 + sum(len(self.quick.encode_ordinary(p)) for p in parts)
        for i, e in zip(slow, self.tokenizer.encode_batch_fast([values[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = len(e.ids)
        return out


@lru_cache(maxsize=2)
def counter_at(json_path: str, ranks_path: str | None) -> TokenCounter:
    """One counter for the life of a Python worker."""
    return TokenCounter(json_path, ranks_path)


@lru_cache(maxsize=4)
def version(path: str) -> str:
    """The digest that names a tokenizer's version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def encode_misses(distinct: DataFrame, json_name: str, ranks_name: str | None) -> DataFrame:
    """(digest, text) → (digest, n_tokens)."""
    bounded_batches(distinct.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        entering("token_counts")
        counter = counter_at(public_tokenizers.path(json_name), ranks_name and public_tokenizers.path(ranks_name))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counter.counts(b.column(1).to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    return distinct.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def token_counts(
    docs: DataFrame,
    cache_path: str,
    json_name: str = "byte_bpe_50k.json",
    ranks_name: str | None = "byte_bpe_50k.tiktoken",
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; the cache at ``cache_path`` gains what it lacked.

    Nulls count as empty texts (0 bytes, 0 tokens). Repeated rows and ids are
    counted row by row, equal texts encoded once. Very long texts are encoded
    whole. An empty table gives no rows. Columns other than the two named are
    ignored.

    A content that a third of all rows share is reduced before the shuffle to
    one row per task; joined back it is one row of counts against many, which
    adaptive execution splits. Tasks write the cache as committed Parquet files,
    so a lost executor costs its own tasks alone. The cache is stored by
    tokenizer, so that counts of other versions aren't read; two runs at once
    may both append a digest, which then counts once.
    """
    import public_tokenizers

    spark = docs.sparkSession
    name = version(public_tokenizers.path(json_name))
    base = texts(docs, id_col, text_col)
    digest = F.unhex(F.sha2(F.col("text"), 256))
    # The empty table makes the cache's folder, so that a first run reads it like any other.
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    stored = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == name).select("digest", "n_tokens")
    with Scratch(spark, "token-counts") as s:
        rows = s.written(base.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("digest")), "rows")
        digests = s.written(rows.select("digest").distinct(), "digests")
        misses = s.written(digests.join(stored(), "digest", "left_anti"), "misses")
        lacking = misses.count()
        if lacking:
            found = base.select(digest.alias("digest"), "text")
            if lacking <= FEW:
                found = found.join(F.broadcast(misses), "digest", "left_semi")
            found = found.groupBy("digest").agg(F.first("text").alias("text"))
            if lacking > FEW:
                found = found.join(misses, "digest", "left_semi")
            encode_misses(found, json_name, ranks_name).select(F.lit(name).alias("tokenizer"), "digest", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache_path)
        # Grouped counts are written before they are joined, so that both sides are dealt for the join alone.
        known = s.written(stored().join(digests, "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "known")
        counts = rows.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
        return written(counts, "token-counts")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from a cache that starts empty."""
    return token_counts(table(spark, sf_dir, "documents"), fresh_path(spark, "token-cache"))
