"""SentencePiece encoding that keeps offsets, and decoding.

The text is normalised through the model's compiled character map: at each
place the longest source prefix that the map knows is replaced, else one
character is copied. The normaliser records, for every byte it writes, the
source byte it came from. The model's merges cut the normalised text to pieces,
and the record projects every piece to its span of original bytes; the spans
cover the text gaplessly.

Where no map moves spaces and no piece holds a space mark behind another
character, no merge goes across the beginning of a run of spaces. Such a text
is cut there, and the normaliser runs once for each different part that a
worker meets; of all parts only those go to the library's merges.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import bounded_batches, entering, keeps, table, texts

MARK = "▁"
SPACE = MARK.encode()
#: Parts whose pieces a worker keeps twice over, and the characters of the longest of them.
PARTS_KEPT, PART_CHARS = 400_000, 64
#: A run of spaces and what follows it.
PART = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")


class CharacterMap:
    """The compiled map: a double-array trie over source bytes, and its replacement strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]
        root = self._shift(self.units[0]) if self.units else 0
        begins = [b for b in range(1, 256) if self.units and (root ^ b) < len(self.units) and self.units[root ^ b] & 0x800000FF == b]
        self.stops = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in {*begins, 32}) + b"]")

    @staticmethod
    def _shift(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def next(self, source: bytes, at: int) -> int:
        """The first byte from ``at`` that is a space or may begin a key."""
        found = self.stops.search(source, at)
        return found.start() if found else len(source)

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest known prefix of ``source`` from ``at``."""
        if not self.units:
            return None
        found, node = None, 0
        pos = self._shift(self.units[0])
        for i in range(at, len(source)):
            node = pos ^ source[i]
            if node >= len(self.units) or (unit := self.units[node]) & 0x800000FF != source[i]:
                break
            pos = node ^ self._shift(unit)
            if unit & 0x100:
                value = self.units[pos] & 0x7FFFFFFF
                found = (i + 1 - at, self.strings[value : self.strings.index(b"\0", value)])
        return found


@dataclass
class Encoded:
    """ids with begin and end, and per id the span of source bytes (empty for begin and end)."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class Kept:
    """What a worker keeps by text: at most ``most`` entries now, and as many from before, of which those asked for again come back."""

    def __init__(self, most: int):
        self.most, self.now, self.before = most, {}, {}

    def get(self, key: str):
        found = self.now.get(key)
        if found is None and (found := self.before.pop(key, None)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: object) -> None:
        if len(self.now) >= self.most:
            self.now, self.before = {}, self.now
        self.now[key] = value


class Pieces:
    """A BPE model with its normaliser; ``encode`` and ``decode`` agree with the library."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as model

        self.library = SentencePieceProcessor(model_file=path)  # decodes
        spec = model.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        self.spec = spec.normalizer_spec
        self.map = CharacterMap(self.spec.precompiled_charsmap)
        kind = model.ModelProto.SentencePiece
        if spec.trainer_spec.model_type != model.TrainerSpec.BPE or any(p.type == kind.USER_DEFINED for p in spec.pieces):
            raise ValueError("only BPE models without pieces of users' own are known")
        known = [p.piece for p in spec.pieces if p.type == kind.NORMAL]
        #: Bytes of normalised text that each piece covers; -1 where that depends on the text.
        self.lengths = np.array([1 if p.type == kind.BYTE else len(p.piece.encode()) if p.type == kind.NORMAL else -1 for p in spec.pieces], np.int64)
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        # The model's merges alone, for text that is normalised already.
        plain = model.ModelProto()
        plain.CopyFrom(spec)
        plain.normalizer_spec.Clear()
        plain.normalizer_spec.name = "identity"
        plain.normalizer_spec.add_dummy_prefix = plain.normalizer_spec.remove_extra_whitespaces = plain.normalizer_spec.escape_whitespaces = False
        self.merges = SentencePieceProcessor(model_proto=plain.SerializeToString())
        apart = not any(MARK in p.lstrip(MARK) for p in known)
        self.cuts = apart and not self.map.units and not self.spec.remove_extra_whitespaces and self.spec.escape_whitespaces
        self.parts = Kept(PARTS_KEPT)

    def normalise(self, source: bytes, begins: bool = True) -> tuple[bytes, list[int]]:
        """The normalised bytes and, for each of them and for the end, the source byte where it begins.

        ``begins``: whether a text begins here, which the model may mark with a
        space. Bytes up to the next that may begin a key of the map, or a space,
        are copied at once.
        """
        out, origin, at, size = bytearray(), [], 0, len(source)
        before_space = self.spec.remove_extra_whitespaces
        space = SPACE if self.spec.escape_whitespaces else b" "
        if self.spec.remove_extra_whitespaces:
            while at < size and (step := self._step(source, at))[1] == b" ":
                at += step[0]
        if begins and at < size and self.spec.add_dummy_prefix:
            out += space
            origin += [at] * len(space)
        while at < size:
            stop = self.map.next(source, at)
            if stop > at:  # copied: every byte is its own origin
                out += source[at:stop]
                origin += range(at, stop)
                at, before_space = stop, False
                continue
            used, text = self._step(source, at)
            while before_space and text[:1] == b" ":
                text = text[1:]
            if text and text == source[at : at + used] and text != b" ":
                out += text
                origin += range(at, at + used)
                before_space = False
            elif text:
                put = text.replace(b" ", space)
                out += put
                origin += [at] * len(put)
                before_space = self.spec.remove_extra_whitespaces and text[-1:] == b" "
            at += used
        end = size
        if self.spec.remove_extra_whitespaces:
            while out.endswith(space):
                end = origin[-1]
                del out[-len(space) :], origin[-len(space) :]
        origin.append(end)
        return bytes(out), origin

    def _step(self, source: bytes, at: int) -> tuple[int, bytes]:
        if found := self.map.longest(source, at):
            return found
        width = 1 + (source[at] >= 0xC0) + (source[at] >= 0xE0) + (source[at] >= 0xF0)
        return width, source[at : at + width]

    def _parts(self, new: list[tuple[str, bool]]) -> dict[tuple[str, bool], tuple[bytes, bytes]]:
        """By part, and whether a text begins with it: its ids, and how many source bytes each spans, as little-endian 32-bit numbers."""
        if not new:
            return {}
        normal, origin, base = [], [], 0
        for part, begins in new:
            source = part.encode()
            held, own = self.normalise(source, begins)
            normal.append(held.decode())
            origin += [base + x for x in own[:-1]] if base else own[:-1]
            base += len(source)
        ids = self.merges.encode(normal, num_threads=1)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, counts.sum())
        sizes = self.lengths[flat]
        ends = np.cumsum(counts)
        for i in sorted(set(np.searchsorted(ends, np.flatnonzero(sizes < 0), "right").tolist())):  # an unknown run: the library says which text each piece has
            sizes[ends[i] - counts[i] : ends[i]] = [len(p.encode()) for p in self.merges.encode(normal[i], out_type=str)]
        if sizes.sum() != len(origin):
            raise ValueError("the pieces don't cover the normalised text")
        places = np.array([*origin, base], np.int64)
        widths = np.diff(places[np.concatenate([[0], np.cumsum(sizes)])]).astype("<u4").tobytes()
        raw = flat.astype("<u4").tobytes()
        cuts = (4 * ends).tolist()
        return {key: (raw[a:b], widths[a:b]) for key, a, b in zip(new, [0, *cuts], cuts, strict=False)}

    def encoded(self, values: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of each text without begin and end, and the source bytes of each id."""
        if not self.cuts:
            found = self._parts([(t, True) for t in dict.fromkeys(values)])
            return [found[t, True] for t in values]
        split = [PART.findall(t) for t in values]
        held = [list(map(self.parts.now.get, parts)) for parts in split]
        new: dict[tuple[str, bool], tuple[bytes, bytes] | None] = {}
        for parts, found in zip(split, held, strict=True):
            if parts:
                found[0] = None
                new[parts[0], True] = None
                for i, x in enumerate(found):
                    if x is None and i and (parts[i], False) not in new:
                        new[parts[i], False] = self.parts.get(parts[i])
        for (part, begins), x in self._parts([k for k, x in new.items() if x is None]).items():
            new[part, begins] = x
            if not begins and len(part) <= PART_CHARS:
                self.parts.put(part, x)
        out = []
        for parts, found in zip(split, held, strict=True):
            found = [new[parts[i], i == 0] if x is None else x for i, x in enumerate(found)] if None in found else found
            out.append((b"".join([x for x, _ in found]), b"".join([x for _, x in found])))
        return out

    def encode(self, values: list[str]) -> list[Encoded]:
        out = []
        for text, found in zip(values, self.encoded(values), strict=True):
            ids, widths = (np.frombuffer(x, "<u4").astype(np.int64) for x in found)
            ends = np.cumsum(widths)
            size = len(text.encode())
            out.append(Encoded(np.concatenate([[self.bos], ids, [self.eos]]), np.concatenate([[0], ends - widths, [size]]), np.concatenate([[0], ends, [size]])))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


@lru_cache(maxsize=2)
def pieces_at(path: str) -> Pieces:
    """One model for the life of a Python worker, so that its tasks share what is known."""
    return Pieces(path)


keeps("pieces", pieces_at.cache_clear)


def public_pieces(name: str = "piece_bpe_32k.model") -> Callable[[], Pieces]:
    def make() -> Pieces:
        import public_tokenizers

        return pieces_at(public_tokenizers.path(name))

    return make


def _mapped(docs: DataFrame, model: Callable[[], Pieces], columns: str, rows: Callable[[Pieces, list[str]], list[tuple]], id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    base = texts(docs, id_col, text_col)
    schema = base.select("doc_id").schema.simpleString()[len("struct<doc_id:") : -1]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(c.rsplit(" ", 1) for c in columns.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("pieces")
        pieces = model()
        for b in batches:
            found = rows(pieces, b.column(1).to_pylist())
            cols = zip(*found, strict=True) if found else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), kinds[k]) for c, k in zip(cols, types, strict=True))], names=["doc_id", *names])

    return base.mapInArrow(run, f"doc_id {schema}, {columns}")


def encode(docs: DataFrame, model: Callable[[], Pieces], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends): every piece with its span of bytes of the original text.

    Nulls are empty texts: begin and end alone. A character outside the
    vocabulary becomes byte pieces, each with a span of its own byte. Repeated
    rows are encoded each; very long texts whole; an empty table gives no rows;
    other columns are ignored.
    """
    rows = lambda pieces, values: [(e.ids.astype(np.int32), e.starts, e.ends) for e in pieces.encode(values)]
    return _mapped(docs, model, "ids array<int>, starts array<long>, ends array<long>", rows, id_col, text_col)


def round_trip(docs: DataFrame, model: Callable[[], Pieces], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256): digests of the ids, of the decoded text and of the spans.

    ``spans_sha256`` is the digest of the number of original bytes that each
    piece spans, begin and end left out, as little-endian unsigned 32-bit
    numbers. Edge cases as in ``encode``.
    """

    def rows(pieces: Pieces, values: list[str]) -> list[tuple]:
        begin, end = (np.array([i], "<u4").tobytes() for i in (pieces.bos, pieces.eos))
        found = [(begin + ids + end, widths) for ids, widths in pieces.encoded(values)]
        decoded = pieces.decode([np.frombuffer(ids, "<u4").tolist() for ids, _ in found])
        digest = lambda x: hashlib.sha256(x).hexdigest()
        return [(len(ids) // 4, digest(ids), digest(t.encode()), digest(widths)) for (ids, widths), t in zip(found, decoded, strict=True)]

    return _mapped(docs, model, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string", rows, id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with begin and end ids, and decoded again."""
    return round_trip(table(spark, sf_dir, "documents"), public_pieces())
