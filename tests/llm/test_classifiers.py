import pickle
import zlib

import numpy as np

from loomspark.llm import quality, toxicity


def held_out(i, parts, fold):
    return zlib.crc32(str(i).encode()) % parts == fold


def accuracy(spark, module, label, parts, fold, sf="/root/testdata/sf0.1"):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = module.query(spark, sf).collect()
    assert len(rows) == docs.count()
    want = {r.doc_id: r[label] for r in labels.collect()}
    assert all(r.held_out == held_out(r.doc_id, parts, fold) for r in rows)
    own = [(want[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in want]
    return np.mean([a == b for a, b in own]), np.mean([b == 1 for a, b in own if a == 1]), np.mean([b == 0 for a, b in own if a == 0])


def test_quality_on_held_out_documents(spark):
    right, kept, dropped = accuracy(spark, quality, "quality", 4, 2)
    assert right > 0.97 and kept > 0.99 and dropped > 0.9


def test_toxicity_on_held_out_documents(spark):
    right, found, clean = accuracy(spark, toxicity, "toxic", 5, 0)
    assert right > 0.97 and found > 0.85 and clean > 0.99


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon(toxicity.folded_seeds())
    bad = ["you IDIOT", "1d10t!", "ｉｄｉｏｔ", "іdіоt", "what a $cum", "a m0r0n...", "&&&idiot&&&", "ìdïot", "stup1d"]
    good = ["", "idiotic", "clown fish swim", "the trash can", "2024 5555", "scumble", "lose"]
    assert all(lexicon.hits(t)[0] for t in bad) and not any(lexicon.hits(t)[0] for t in good)
    assert lexicon.hits("a s$um sc@m, 5$ for us@ $5")[0] == {} and all(lexicon.hits(t)[0] for t in ("tr@sh", "@idiot", "$tupid", "pay $5, $cum"))
    assert len(lexicon.hits("idiot, the trash can, idiot")[0]) == 2
    a, b = lexicon.features("idiot " + "word " * 5), lexicon.features("idiot " + "word " * 5000)
    assert a[1] > b[1] and a[0] == b[0]
    assert pickle.loads(pickle.dumps(lexicon)).hits("idiot")[0]


def test_lookalikes_are_pairs():
    assert all(len(k) == 1 and len(v) == 1 and v.isascii() for k, v in toxicity.LOOKALIKES.items())


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, 1), (None, 1, 1), (99, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for module, run in ((quality, quality.quality), (toxicity, toxicity.toxicity)):
        for known in (labels, none):
            rows = run(odd_docs, known).collect()
            assert len(rows) == 9 and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
            same = [r.score for r in rows if r.doc_id in (5, 6)]
            assert len(set(same)) == 1
            assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
            assert run(no_docs, known).count() == 0
            kept = module.keep(odd_docs, known)
            assert kept.columns == odd_docs.columns and kept.count() <= 9
            assert module.keep(no_docs, known).count() == 0


def test_chunks_cover_the_whole_text():
    net = quality.Network.fresh(3)
    for size in (0, 1, 63, 64, 65, 256, 257, 448, 449, 5000):
        raw = bytes(np.random.default_rng(size).integers(32, 120, size, dtype=np.uint8))
        v = net.chunk_vectors(raw)
        blocks = np.concatenate([net.block_maxima(np.frombuffer(raw, np.uint8)), quality.lag_blocks(np.frombuffer(raw, np.uint8))], 1)
        top = np.maximum(blocks.max(0)[: quality.FILTERS] + net.bias, 0)
        assert np.allclose(v[:, : quality.FILTERS].max(0), top)
        assert np.allclose(v[:, quality.FILTERS : -1].max(0), blocks[:, quality.FILTERS :].max(0))
        assert len(v) == max(1, -(-(max(1, size) - 64) // 192)) or size < 65


def test_responses_agree_with_the_definition():
    net = quality.Network.fresh(4)
    data = np.frombuffer(b"some bytes, some more of them" * 5, np.uint8)
    padded = np.concatenate([data, np.zeros(300, np.uint8)])
    direct = np.stack([sum(net.rows[k, padded[i + k]] for k in range(quality.WIDTH)) for i in range(192)])
    assert np.allclose(net.block_maxima(data), direct.reshape(3, 64, -1).max(1), atol=1e-5)


def test_the_sample_is_bounded_whatever_the_ids(spark):
    """A repeated id gives one row: a bound of 1 a class gives 2 rows at most."""
    from loomspark.llm.common import labelled_sample

    docs = spark.createDataFrame([(1, "b text")] * 300 + [(1, "a text"), (2, "other"), (3, "third")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    picked, counts = labelled_sample(docs, labels, "quality", 1, 5, 1)
    rows = {r.label: (r.doc_id, r.text) for r in picked.collect()}
    assert picked.count() == 2 and rows[1] == (1, "a text") and counts == {0: 2, 1: 1}
