"""Token counts, packing and pieces against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomspark.llm import packing, pieces, token_counts
from loomspark.llm.common import fresh_path

ODD = ["", " ", "a", "<|endoftext|>", "a<|endoftext|> b<|startoftext|>c", "It'S we'LL 'tis ''s ...'s", "²³ ¼x ªº µ ÀÉ ß ÿ", "x" * 5000, " " * 3000 + "a", "日本語 テスト", "😀 é İI ſ ﬁ", "a b\u0085c\u001cd", "1234567 12,5%", "▁a ▁▁ b", "tab\tnl\n\n  x  ", "\x00\x01", "Ǆ ĳ Ŀ", "!!!'s", "a\r\nb", "¿Qué? ¡x×÷¿¼½¾¿Àé\xad«»"]
MIXED = st.text(alphabet=st.one_of(st.sampled_from(list("abc'stdSTLre 12 \n\t.!<|>")), st.characters(codec="utf-8")), max_size=60)


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def words():
    return packing.WordEncoder(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def model():
    return pieces.public_pieces()()


def library_ids(name, values):
    return [e.ids for e in Tokenizer.from_file(P.path(name)).encode_batch(values, add_special_tokens=False)]


def test_counts_agree_with_library(counter):
    assert counter.counts(ODD) == [len(x) for x in library_ids("byte_bpe_50k.json", ODD)]


def test_word_ids_agree_with_library(words):
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(ODD)] == library_ids("word_bpe_49k.json", ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(MIXED, max_size=8))
def test_any_text(counter, words, values):
    assert counter.counts(values) == [len(x) for x in library_ids("byte_bpe_50k.json", values)]
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(values)] == library_ids("word_bpe_49k.json", values)


def test_documents_agree_with_library(spark, counter, words):
    values = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert counter.counts(values) == [len(x) for x in library_ids("byte_bpe_50k.json", values)]
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(values)] == library_ids("word_bpe_49k.json", values)


def test_word_memory_is_bounded(words, monkeypatch):
    monkeypatch.setattr(packing, "RUNS_KEPT", 3)
    small = packing.WordEncoder(P.path("word_bpe_49k.json"))
    assert small.encode(["a b c", "d e"]) == words.encode(["a b c", "d e"])
    assert small.encode(["a x"]) == words.encode(["a x"]) and len(small.known) <= 5


def test_cache_encodes_only_misses(spark, odd_docs, monkeypatch):
    path = fresh_path(spark, "cache")
    first = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd_docs, path).collect()}
    want = {(r.doc_id, r.text or "") for r in odd_docs.collect()}
    ids = library_ids("byte_bpe_50k.json", [t for _, t in want])
    assert first == {(i, len(t.encode()), len(x), len(x) > 512) for (i, t), x in zip(want, ids)}
    assert spark.read.parquet(path).count() == 6  # distinct contents: the null and the empty text are one
    assert token_counts.token_counts(odd_docs, path).count() == 9
    assert spark.read.parquet(path).count() == 6  # nothing was encoded again
    more = odd_docs.union(spark.createDataFrame([(9, "a new text", "", "", 0, 0.0, "")], odd_docs.schema))
    assert token_counts.token_counts(more, path).count() == 10
    assert spark.read.parquet(path).count() == 7


def test_a_run_that_lacks_nothing_moves_no_text(spark, odd_docs, monkeypatch):
    """The second run encodes nothing; few misses are the only texts that reach an encoder; many go by the other way."""
    path, seen = fresh_path(spark, "cache"), []
    encode = token_counts.encode_misses
    monkeypatch.setattr(token_counts, "encode_misses", lambda df, *a: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or encode(df, *a))
    first = sorted(map(tuple, token_counts.token_counts(odd_docs, path).collect()), key=str)
    assert len(seen) == 1
    assert sorted(map(tuple, token_counts.token_counts(odd_docs, path).collect()), key=str) == first
    assert len(seen) == 1
    monkeypatch.setattr(token_counts, "FEW", 0)
    more = odd_docs.union(spark.createDataFrame([(9, "a newer text", "", "", 0, 0.0, "")] * 2, odd_docs.schema))
    assert token_counts.token_counts(more, path).count() == 11
    assert len(seen) == 2 and spark.read.parquet(path).count() == 7


@pytest.mark.parametrize("n", [1999, 2000, 2001])
def test_long_runs_count_alike(counter, n):
    values = ["x" * n, " " * n + "b", "a" + "1" * n + "é", ("ab" * n)[:n] + " c"]
    assert counter.counts(values) == [len(x) for x in library_ids("byte_bpe_50k.json", values)]


def test_counts_of_nothing(spark, no_docs):
    assert token_counts.token_counts(no_docs, fresh_path(spark, "cache")).count() == 0


def check_packing(rows, want_ids, limit=4096, segments=512, loss=4096):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, parts in by_doc.items():
        ids = want_ids[doc]
        if len({(p["start"]) for p in parts}) < len(parts):
            continue  # a repeated id: its rows are checked by their sums below
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= limit and len(parts) <= segments and sum(p["loss_tokens"] for p in parts) <= loss
    return by_sequence


def test_packing_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r.asDict() for r in packing.pack(docs, packing.public_encoder()).collect()]
    texts = docs.collect()
    ids = dict(zip([r.doc_id for r in texts], [x + [2] for x in library_ids("word_bpe_49k.json", [r.text for r in texts])]))
    by_sequence = check_packing(rows, ids)
    assert {r["doc_id"] for r in rows} == set(ids)
    full = sum(sum(p["length"] for p in parts) == 4096 for parts in by_sequence.values())
    assert full >= len(by_sequence) - 1


def test_packing_of_odd_rows(odd_docs, no_docs):
    rows = [r.asDict() for r in packing.pack(odd_docs, packing.public_encoder(), max_tokens=64, max_segments=3, max_loss_tokens=50).collect()]
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    ids = dict(zip(texts, [x + [2] for x in library_ids("word_bpe_49k.json", list(texts.values()))]))
    check_packing(rows, ids, 64, 3, 50)
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values())) + len(ids[5])
    assert packing.pack(no_docs, packing.public_encoder()).count() == 0


@pytest.mark.parametrize("limits", [(0, 4, 4), (16, 0, 16), (16, 4, 0), (-1, 4, 4)])
def test_impossible_limits_are_errors(limits):
    with pytest.raises(ValueError):
        packing.Packer(*limits)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 100)), max_size=40))
def test_packer_keeps_all_limits(items):
    packer = packing.Packer(32, 4, 20)
    out = packer.pack([n for n, _ in items], [b for _, b in items])
    held, sums = {}, {}
    for i, a, n, s, o in out:
        held.setdefault(i, []).append((a, n))
        x = sums.setdefault(s, [0, 0, 0])
        assert o == x[0]
        x[0] += n
        x[1] += 1
        x[2] += max(0, a + n - max(a, items[i][1]))
    for i, parts in held.items():
        at = 0
        for a, n in sorted(parts):
            assert a == at and n > 0
            at += n
        assert at == items[i][0]
    assert len(held) == len(items)
    assert all(x[0] <= 32 and x[1] <= 4 and x[2] <= 20 for x in sums.values())


def library_spans(model, text):
    """(ids, source bytes of each piece) by the library's own alignment, in which the bytes of one character share its span."""
    found = model.library.encode(text, return_type="proto").pieces
    return [p.id for p in found], [(p.begin, p.end) for p in found]


def check_pieces(model, text):
    (e,) = model.encode([text])
    raw = text.encode()
    assert e.ids.tolist() == model.library.encode(text, add_bos=True, add_eos=True)
    assert b"".join(raw[a:b] for a, b in zip(e.starts, e.ends)) == raw
    ids, spans = library_spans(model, text)
    bytes_ = {i for i, n in enumerate(model.lengths) if n == 1 and model.library.id_to_piece(i).startswith('<0x')}
    assert ids == e.ids[1:-1].tolist()
    for i, (a, b), start, end in zip(ids, spans, e.starts[1:-1], e.ends[1:-1]):
        if i not in bytes_:
            assert (a, b) == (start, end)
        else:
            assert end - start == 1


def test_pieces_agree_with_library(model):
    for t in [*ODD, "x▁ y ▁z▁", " a  b   c    ", "<0x0A> <s> </s>", "日本 " * 50 + "語" * 300]:
        check_pieces(model, t)


@settings(max_examples=150, deadline=None)
@given(st.one_of(MIXED, st.text(alphabet="ab ▁ethinos\n", max_size=60)))
def test_any_text_and_its_spans(model, text):
    check_pieces(model, text)


def test_cuts_change_nothing(model):
    """Parts against the merges of the whole normalised text."""
    for r in ("the quick  brown fox, éü ▁ it", " two  spaces ", "x", "thor%%% an.\nOneux THERE!! ▁▁▁▁▁▁▁"):
        normal, _ = model.normalise(r.encode())
        whole = np.array(model.merges.encode(normal.decode()), "<u4").tobytes()
        (found,) = model.encoded([r])
        assert found[0] == whole
        again = pieces.Pieces(P.path("piece_bpe_32k.model"))
        again.cuts = False
        assert again.encoded([r]) == [found]


def test_what_is_kept_is_bounded():
    kept = pieces.Kept(3)
    for i in range(10):
        kept.put(str(i), i)
        assert len(kept.now) <= 3 and len(kept.before) <= 3
    assert kept.get("0") is None and kept.get("9") == 9 and kept.get("8") == 8


def test_normaliser_with_a_map_and_with_spaces_removed(model):
    """A hand-made map: 'a' becomes 'x', 'ab' becomes 'yz'; extra spaces go."""
    made = pieces.Pieces.__new__(pieces.Pieces)
    made.map = hand_made_map()
    made.spec = type("Spec", (), {"remove_extra_whitespaces": True, "add_dummy_prefix": True, "escape_whitespaces": True})
    normal, origin = made.normalise(b"  cab  a ")
    assert normal.decode() == "▁cyz▁x"
    assert origin == [2, 2, 2, 2, 3, 3, 5, 5, 5, 7, 8]
    made.spec.remove_extra_whitespaces = False
    normal, origin = made.normalise(b" a", begins=False)
    assert normal.decode() == "▁x" and origin == [0, 0, 0, 1, 2]


def hand_made_map():
    """A small double array built by hand: 'a' -> 'x', 'ab' -> 'yz'."""
    units = [0] * 1024
    put = lambda node, label, base, leaf: units.__setitem__(node, (base << 10) | label | (0x100 if leaf else 0))
    root = 1
    units[0] = root << 10
    a = root ^ ord("a")
    base_a = 300
    put(a, ord("a"), a ^ base_a, True)
    units[base_a] = 0x80000000 | 0
    b = base_a ^ ord("b")
    base_b = 700
    put(b, ord("b"), b ^ base_b, True)
    units[base_b] = 0x80000000 | 2
    blob = (4 * 1024).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + b"x\0yz\0"
    return pieces.CharacterMap(blob)


def test_longest_prefix_of_a_compiled_map():
    found = hand_made_map()
    assert found.longest(b"ac", 0) == (1, b"x")
    assert found.longest(b"cab", 1) == (2, b"yz")
    assert found.longest(b"ca", 0) is None


def test_round_trip_rows(odd_docs, no_docs, model):
    rows = pieces.round_trip(odd_docs, pieces.public_pieces()).collect()
    want = []
    for r in odd_docs.collect():
        ids = model.library.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.library.decode(ids).encode()).hexdigest()))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted((tuple(r)[:4] for r in rows), key=key) == sorted(want, key=key)
    for r in rows:
        (e,) = model.encode([next(x.text or "" for x in odd_docs.collect() if x.doc_id == r.doc_id)])
        assert r.spans_sha256 == hashlib.sha256((e.ends - e.starts)[1:-1].astype("<u4").tobytes()).hexdigest()
    assert pieces.encode(no_docs, pieces.public_pieces()).count() == 0


def test_all_documents_round_trip(spark, model):
    """Ids, text and spans of whole documents against the library, document by document."""
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = pieces.query(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = model.library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.library.decode(ids).encode()).hexdigest()
