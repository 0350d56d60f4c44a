"""Packing of examples into sequences by vector bin packing with the dot-product heuristic.

A sequence has limits on tokens, on segments and on loss-bearing tokens at once.
An open sequence takes, of the examples waiting, the one whose demand vector
has the largest dot product with what is left of its limits; each dimension is
divided by its limit. When none fits whole, the largest is cut so that it fills
the sequence. Each task packs its own rows, a window of examples at a time, and
carries its open sequence from window to window, so nothing is shuffled and a
task holds one window of token ids.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from loomspark.llm.common import bounded_batches, entering, keeps, table

MAX_TOKENS, MAX_SEGMENTS, END_ID = 4096, 512, 2
#: Sequences of a task are numbered from its index times this.
TASK_STRIDE = 1 << 36
#: Runs whose ids a task keeps; beyond that it begins anew.
RUNS_KEPT = 800_000


class WordEncoder:
    """Ids of the word-end BPE as little-endian uint32 bytes, with those of each run between spaces kept.

    The vocabulary merges within a word only and no word holds a space, so a
    text of plain Latin-1 (which the normaliser only puts in lower case) is cut
    at spaces and its runs are looked up. New runs go to the library joined by
    spaces; the ids that end a word tell where each run ends. Any other text,
    and one that may hold a special token, goes to the library whole.
    """

    PLAIN = re.compile(r"[\t\n\r -~\u00a1-\u00ff]*\Z")
    #: The tokenizer's split pattern, its classes written out for Latin-1; it tells how many words a run has.
    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]|[^\s0-9a-zA-Z\u00aa\u00b2\u00b3\u00b5\u00b9\u00ba\u00bc-\u00be\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def _library(self, parts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn(self, runs: list[str]) -> None:
        if len(self.known) + len(runs) > RUNS_KEPT:
            self.known.clear()
        (ids,) = self._library([" ".join(runs)])
        cuts = np.flatnonzero(self.ends[ids]) + 1
        words = np.cumsum([len(self.SPLIT.findall(r)) for r in runs])
        if len(cuts) != (words[-1] if len(runs) else 0):
            raise ValueError("the ids don't tell the words apart")
        raw, at = ids.tobytes(), 0
        for run, end in zip(runs, (4 * cuts[words - 1]).tolist(), strict=True):
            self.known[run] = raw[at:end]
            at = end

    def encode(self, values: list[str]) -> list[bytes]:
        out: list = [None] * len(values)
        whole, gaps = [], []
        get = self.known.get
        for i, t in enumerate(values):
            if "<|" in t or not self.PLAIN.match(t):
                whole.append(i)
                continue
            runs = t.lower().split()
            out[i] = parts = list(map(get, runs))
            if None in parts:
                gaps += [(parts, j, runs[j]) for j, p in enumerate(parts) if p is None]
        if gaps:
            new = list(dict.fromkeys(run for _, _, run in gaps))
            self._learn(new)
            for parts, j, run in gaps:
                parts[j] = self.known[run]
        for i, ids in zip(whole, self._library([values[i] for i in whole]), strict=True):
            out[i] = (ids.tobytes(),)
        return [b"".join(x) for x in out]


class Packer:
    """Places pieces (row, start, length) of examples; ``emit`` gets (row, start, length, sequence, offset)."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int):
        if max_tokens < 1 or max_segments < 1 or max_loss < 1:
            raise ValueError("each limit of a sequence must be 1 at least")
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.sequence = -1
        self._open()

    def _open(self) -> None:
        self.sequence += 1
        self.left, self.offset = self.limits.copy(), 0

    def _put(self, out: list, row: int, start: int, length: int, loss: int) -> None:
        out.append((row, start, length, self.sequence, self.offset))
        self.offset += length
        self.left -= (length, 1, loss)
        if self.left[0] < 1 or self.left[1] < 1:
            self._open()

    def pack(self, lengths: list[int], loss_starts: list[int]) -> list[tuple[int, int, int, int, int]]:
        """Every token of a window's examples in one piece each; the last sequence stays open."""
        n = len(lengths)
        start, end, bears = np.zeros(n, np.int64), np.array(lengths, np.int64), np.array(loss_starts, np.int64)
        loss = lambda i, a, b: int(max(0, b - max(a, bears[i])))
        out: list[tuple[int, int, int, int, int]] = []
        waiting = end > start
        need = np.stack([end - start, np.ones(n), np.maximum(0, end - np.maximum(start, bears))], 1).astype(float) if n else np.zeros((0, 3))
        while waiting.any():
            fits = waiting & (need <= self.left).all(1)
            if fits.any():
                dot = np.where(fits, (need / self.limits) @ (self.left / self.limits), -1.0)
                i = int(dot.argmax())
                a, b = int(start[i]), int(end[i])
                waiting[i] = False
                self._put(out, i, a, b - a, loss(i, a, b))
                continue
            # None fits whole: cut the largest to what is left, in tokens and in loss-bearing tokens.
            i = int(np.where(waiting, need[:, 0], -1.0).argmax())
            a = int(start[i])
            room = min(int(self.left[0]), max(0, int(bears[i]) - a) + int(self.left[2]), int(end[i]) - a)
            if room < 1:
                self._open()
                continue
            self._put(out, i, a, room, loss(i, a, a + room))
            start[i] = a + room
            waiting[i] = start[i] < end[i]
            need[i] = (end[i] - start[i], 1, loss(i, int(start[i]), int(end[i])))
        return out


def pack(
    examples: DataFrame,
    encoder: Callable[[], WordEncoder],
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss_tokens: int | None = None,
    end_id: int = END_ID,
    loss_start_col: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset).

    ``loss_start_col`` names the column with the first loss-bearing token of an
    example (null or absent: all bear loss). Null and empty texts are the end
    id alone. Repeated ids and rows are packed each on its own; a null id stays
    null. A text longer than a sequence spans as many as it needs. An empty
    table gives no rows. Other columns are ignored. Sequences are numbered
    task by task, so their numbers depend on how the rows are partitioned. A
    limit below 1 is an error.
    """
    spark = examples.sparkSession
    bounded_batches(spark)
    from pyspark.sql import functions as F

    bears = F.lit(0).cast("long") if loss_start_col is None else F.coalesce(F.col(loss_start_col).cast("long"), F.lit(0).cast("long"))
    rows = examples.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), bears.alias("bears"))
    most_loss = max_tokens if max_loss_tokens is None else max_loss_tokens
    Packer(max_tokens, max_segments, most_loss)  # tells of a limit that can't be met before anything runs
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset"]
    last = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("packing")
        words, packer, first = encoder(), Packer(max_tokens, max_segments, most_loss), TaskContext.get().partitionId() * TASK_STRIDE
        for batch in batches:
            ids = [x + last for x in words.encode(batch.column(1).to_pylist())]
            begins = batch.column(2).to_pylist()
            pieces = packer.pack([len(x) // 4 for x in ids], begins)
            crc = [zlib.crc32(memoryview(ids[i])[4 * a : 4 * (a + n)]) for i, a, n, _, _ in pieces]
            i, a, n, seq, off = (np.array(x, np.int64) for x in zip(*pieces, strict=True)) if pieces else [np.zeros(0, np.int64)] * 5
            begin = np.array(begins, np.int64)[i]
            cols = [batch.column(0).take(pa.array(i)), a, n, np.array(crc, np.int64), np.array([len(x) // 4 for x in ids], np.int64)[i], np.maximum(0, a + n - np.maximum(a, begin)), first + seq, off]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols], names=names)

    return rows.mapInArrow(run, schema)


@lru_cache(maxsize=2)
def encoder_at(path: str) -> WordEncoder:
    """One encoder for the life of a Python worker, so that its tasks share what is known."""
    return WordEncoder(path)


keeps("packing", encoder_at.cache_clear)


def public_encoder(name: str = "word_bpe_49k.json") -> Callable[[], WordEncoder]:
    def make() -> WordEncoder:
        import public_tokenizers

        return encoder_at(public_tokenizers.path(name))

    return make


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_encoder())
