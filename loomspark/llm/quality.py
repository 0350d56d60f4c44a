"""Quality by a convolutional network over bytes, in numpy.

A filter looks at WIDTH bytes; its response is a sum of learned rows, one for
each byte value and place. A document's bytes are cut into overlapping chunks
that cover all of it; each chunk keeps the largest response of every filter. A
hidden layer over those maxima and the chunk's fill gives one vector a chunk,
their mean over the chunks goes through a logistic unit: one probability.

Beside the filters over byte values there is one filter a lag over the channel
that says where a byte equals the one so many places on; its response is the
mean over BLOCK bytes. Filters over values tell symbols, shouting and tables;
those over lags tell words that are repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import bounded_batches, entering, fold, free_name, labelled_sample, table, texts

#: Bounds of the training sample: labelled documents of each class, and chunks, spread evenly, of each of them.
PER_CLASS, CHUNKS_EACH = 2000, 4
#: Filters and their width in bytes (even: the rows of two bytes are joined); hidden units.
FILTERS, WIDTH, HIDDEN = 32, 6, 32
#: A chunk is CHUNK bytes, and the next begins STRIDE later; both are multiples of BLOCK.
CHUNK, STRIDE, BLOCK = 256, 192, 64
EPOCHS, BATCH, RATE = 12, 64, 3e-3
THRESHOLD = 0.7
LAGS = tuple(range(2, 18))
INPUTS = FILTERS + len(LAGS) + 1
#: Bytes whose responses are worked out at once.
SPAN = 1 << 15


@dataclass
class Network:
    rows: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray
    w1: np.ndarray  # (INPUTS, HIDDEN)
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    _pairs: np.ndarray | None = None

    @staticmethod
    def fresh(seed: int = 1) -> Network:
        r = np.random.default_rng(seed)
        return Network(
            r.normal(0, 0.5, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
            r.normal(0, INPUTS**-0.5, (INPUTS, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
            r.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32), 0.0,
        )

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_pairs": None}

    def pairs(self) -> np.ndarray:
        """(WIDTH / 2, 65536, FILTERS): the rows of two neighbouring bytes, added."""
        if self._pairs is None:
            p = self.rows[0::2, :, None, :] + self.rows[1::2, None, :, :]
            self._pairs = p.reshape(WIDTH // 2, 1 << 16, FILTERS)
        return self._pairs

    def block_maxima(self, data: np.ndarray) -> np.ndarray:
        """(blocks, FILTERS): the largest responses that begin in each BLOCK bytes. ``data``: bytes padded with zeros."""
        n = -(-max(1, len(data)) // BLOCK) * BLOCK
        padded = np.zeros(n + WIDTH, np.uint16)
        padded[: len(data)] = data
        two = (padded[:-1] << 8) | padded[1:]
        pairs, out = self.pairs(), np.empty((n // BLOCK, FILTERS), np.float32)
        for a in range(0, n, SPAN):
            m = min(SPAN, n - a)
            held = pairs[0].take(two[a : a + m], 0)
            for k in range(1, WIDTH // 2):
                held += pairs[k].take(two[a + 2 * k : a + 2 * k + m], 0)
            out[a // BLOCK : (a + m) // BLOCK] = held.reshape(-1, BLOCK, FILTERS).max(1)
        return out

    def chunk_vectors(self, raw: bytes) -> np.ndarray:
        """(chunks, INPUTS): maxima of every chunk and how full it is. A place past the end responds like any other."""
        data = np.frombuffer(raw, np.uint8)
        blocks = np.concatenate([self.block_maxima(data), lag_blocks(data)], 1)
        per, step = CHUNK // BLOCK, STRIDE // BLOCK
        starts = np.arange(0, max(1, len(blocks) - (per - step)), step)
        top = np.maximum.reduceat(blocks, np.stack([starts, np.minimum(starts + per, len(blocks))], 1).ravel()[:-1], axis=0)[::2] if len(starts) > 1 else blocks.max(0, keepdims=True)
        fill = np.clip((len(data) - starts * BLOCK) / CHUNK, 0, 1).astype(np.float32)
        return np.concatenate([np.maximum(top[:, :FILTERS] + self.bias, 0), top[:, FILTERS:], np.log1p(8 * fill)[:, None]], 1)

    def probability(self, raw: bytes) -> float:
        h = np.maximum(self.chunk_vectors(raw) @ self.w1 + self.b1, 0).mean(0)
        return float(1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -40, 40))))


def lag_blocks(data: np.ndarray) -> np.ndarray:
    """(blocks, lags): 4 times the share of bytes in each BLOCK that equal the byte a lag on."""
    n = -(-max(1, len(data)) // BLOCK) * BLOCK
    out = np.zeros((n // BLOCK, len(LAGS)), np.float32)
    for j, lag in enumerate(LAGS):
        same = np.zeros(n, np.uint8)
        if len(data) > lag:
            np.equal(data[:-lag], data[lag:], out=same[: len(data) - lag].view(bool))
        out[:, j] = same.reshape(-1, BLOCK).sum(1, dtype=np.uint16)
    return out * np.float32(4 / BLOCK)


def sample_chunks(raw: bytes, most: int) -> list[bytes]:
    """At most ``most`` chunks spread evenly over the whole text, for training alone."""
    starts = list(range(0, max(1, len(raw) - (CHUNK - STRIDE)), STRIDE))
    if len(starts) > most:
        starts = [starts[i * (len(starts) - 1) // (most - 1)] for i in range(most)]
    return [raw[s : s + CHUNK] for s in starts]


def train(chunks: list[list[bytes]], y: np.ndarray, shift: float, seed: int = 1) -> Network:
    """Adam on the documents' sampled chunks; ``shift`` is added to the final bias for the classes' true shares."""
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    owner = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
    data = np.zeros((len(owner), CHUNK + WIDTH), np.uint8)
    fill = np.zeros(len(owner), np.float32)
    for i, c in enumerate(b for cs in chunks for b in cs):
        data[i, : len(c)] = np.frombuffer(c, np.uint8)
        fill[i] = len(c) / CHUNK
    lags = np.array([lag_blocks(np.frombuffer(b, np.uint8)).max(0) for cs in chunks for b in cs], np.float32)
    # As in whole texts, places up to the end of the last begun block respond.
    places = np.clip(np.ceil(np.maximum(fill, 1e-6) * CHUNK / BLOCK) * BLOCK, BLOCK, CHUNK)
    by_doc = np.split(np.arange(len(owner)), np.cumsum([len(c) for c in chunks])[:-1])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    names = ("rows", "bias", "w1", "b1", "w2")
    moments = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in names} | {"b2": [0.0, 0.0]}
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 1e-4
        order = r.permutation(len(chunks))
        for a in range(0, len(order), BATCH):
            docs = order[a : a + BATCH]
            idx = np.concatenate([by_doc[d] for d in docs])
            seg = np.repeat(np.arange(len(docs)), [len(by_doc[d]) for d in docs])
            x = data[idx]
            held = net.rows[0].take(x[:, :CHUNK], 0)
            for k in range(1, WIDTH):
                held += net.rows[k].take(x[:, k : k + CHUNK], 0)
            held[np.arange(CHUNK)[None] >= places[idx][:, None]] = -1e9
            where = held.argmax(1)
            top = np.take_along_axis(held, where[:, None], 1)[:, 0] + net.bias
            v = np.concatenate([np.maximum(top, 0), lags[idx], np.log1p(8 * fill[idx])[:, None]], 1)
            z = v @ net.w1 + net.b1
            h = np.maximum(z, 0)
            share = 1.0 / np.bincount(seg, minlength=len(docs))[seg]
            pooled = np.zeros((len(docs), HIDDEN), np.float32)
            np.add.at(pooled, seg, h * share[:, None].astype(np.float32))
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.w2 + net.b2, -40, 40)))
            g = ((p - y[docs]) * weight[docs] / len(docs)).astype(np.float32)
            grads = {"w2": pooled.T @ g, "b2": float(g.sum())}
            gz = (g[seg] * share).astype(np.float32)[:, None] * net.w2 * (z > 0)
            grads["w1"], grads["b1"] = v.T @ gz, gz.sum(0)
            gt = (gz @ net.w1.T)[:, :FILTERS] * (top > 0)
            grads["bias"] = gt.sum(0)
            rows = np.zeros_like(net.rows)
            filters = np.broadcast_to(np.arange(FILTERS), where.shape)
            for k in range(WIDTH):
                np.add.at(rows[k], (np.take_along_axis(x, where + k, 1), filters), gt)
            grads["rows"] = rows
            step += 1
            for k, grad in grads.items():
                m = moments[k]
                m[0] = 0.9 * m[0] + 0.1 * grad
                m[1] = 0.999 * m[1] + 0.001 * grad**2
                change = rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-7)
                setattr(net, k, getattr(net, k) - change)
    net.b2 = float(net.b2) + shift
    return net


def learn(docs: DataFrame, labels: DataFrame, parts: int, held_out: int, per_class: int = PER_CLASS) -> Network | None:
    """The network fitted to at most ``per_class`` labelled documents a class; None without labels of both.

    Executors cut the training chunks, so the driver gets at most two times
    ``per_class`` times CHUNKS_EACH chunks of CHUNK bytes.
    """
    picked, counts = labelled_sample(docs, labels, "quality", parts, held_out, per_class)
    most = CHUNKS_EACH

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "chunks": [sample_chunks(t.encode(), most) for t in b["text"]]})

    bounded_batches(docs.sparkSession)
    rows = picked.select("doc_id", "label", "text").mapInPandas(cut, "doc_id long, label int, chunks array<binary>").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["label"], r["chunks"]))
    y = np.array([r["label"] for r in rows], np.float32)
    if not (y == 1).any() or not (y == 0).any():
        return None
    shift = float(np.log(counts[1] / counts[0]))
    return train([[bytes(c) for c in r["chunks"]] for r in rows], y, shift)


def scored(docs: DataFrame, net: Network | None, out: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``out``, 0 to 1; a null text is an empty one. Without a network every text scores 1."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        entering("quality")
        return pd.Series([1.0 if net is None else net.probability(b"" if t is None else t.encode()) for t in text], dtype=float)

    return docs.withColumn(out, score(F.col(text_col)))


def quality(docs: DataFrame, labels: DataFrame, parts: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts are one chunk of zeros and are scored like any other.
    Repeated rows are scored each and alike. Very long texts are read whole, a
    span at a time. Without documents there are no rows; without labels of
    both classes every document scores 1. Columns other than the two named are
    ignored.
    """
    rows = texts(docs, id_col, text_col)
    out = scored(rows, learn(rows, labels, parts, held_out))
    return out.select("doc_id", (fold(F.col("doc_id"), parts) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` of good quality, with the columns they had, whatever their names.

    Null and empty texts are scored as one empty chunk and stay or go alike;
    repeated rows stay or go together; very long texts are scored whole; an
    empty table gives no rows.
    """
    name = free_name(docs, "quality")
    return scored(docs, learn(docs, labels, 4, 2), name).where(F.col(name) >= THRESHOLD).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for quality."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
