import hashlib
import random

from pyspark.sql import functions as F

from loomspark.llm import fingerprints as fp


def by_id(rows):
    return {r.doc_id: r for r in rows}


def edited(text, following):
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            rows = by_id(fp.fingerprints(docs).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert len(rows) == len(texts)
        off = []
        for i, (doc, text) in enumerate(texts):
            r, e = rows[doc], edited(text, texts[(i + 1) % len(texts)][1])
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            a, b = shingles(text), shingles(e)
            off.append(abs(r.near_edited - len(a & b) / max(1, min(len(a), len(b)))))
            off.append(abs(r.resemblance_edited - len(a & b) / max(1, len(a | b))))
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert sum(off) / len(off) < 0.08
    assert len({(r.fingerprint) for r in rows.values()}) >= 0.95 * len({t for _, t in texts})
    same = {}
    for doc, text in texts:
        assert same.setdefault(text, rows[doc].fingerprint) == rows[doc].fingerprint


def test_short_texts_are_exact(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f x y"), (3, "b a"), (4, "b a"), (5, "")], "doc_id long, text string")
    rows = by_id(fp.fingerprints(docs).collect())
    assert rows[1].near_next == 0.5 and rows[3].near_next == 1.0 and rows[5].near_next == 0.0 and rows[4].near_next == 0.0
    assert rows[5].near_edited == 1.0


def test_containment_of_unequal_texts(spark):
    r = random.Random(5)
    words = [str(r.randrange(10**6)) for _ in range(20000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[5000:7000]))], "doc_id long, text string")
    row = by_id(fp.fingerprints(docs).collect())[1]
    assert row.near_next > 0.9 and row.resemblance_next < 0.15


def test_sketches_merge(spark):
    r = random.Random(6)
    a, b = ([str(r.randrange(10**6)) for _ in range(3000)] for _ in range(2))
    df = spark.createDataFrame([(" ".join(a), " ".join(b), " ".join(a) + " " + " ".join(b))], "a string, b string, c string")
    for c in "abc":
        df = fp.sketched(df, c, f"s{c}")
    row = df.select(fp.merged(F.col("sa"), F.col("sb")).alias("m"), F.col("sc")).first()
    assert set(row.m.hashes) <= set(row.sc.hashes) and len(row.sc.hashes) - len(row.m.hashes) <= 4


def test_odd_rows(spark, odd_docs, no_docs):
    rows = fp.fingerprints(odd_docs).collect()
    assert len(rows) == 9 and sorted(r.n_chars for r in rows) == sorted(len(r.text or "") for r in odd_docs.collect())
    first = next(r for r in rows if r.doc_id is None)
    text = next(r.text for r in odd_docs.collect() if r.doc_id is None)
    nxt = next(r.text for r in odd_docs.collect() if r.doc_id == 1)
    assert first.edited_sha256 == hashlib.sha256(edited(text, nxt).encode()).hexdigest()
    assert fp.fingerprints(no_docs).count() == 0
    one = spark.createDataFrame([(1, "just this one text here")], "doc_id long, text string")
    assert fp.fingerprints(one).first().near_next == 1.0


def test_ids_beyond_double_precision(spark):
    """Ids like hashes: every row has its next, though the bounds of the ranges are approximate."""
    ids = [(1 << 62) + 3 * i for i in range(200)] + [-(1 << 61) - i for i in range(50)]
    docs = spark.createDataFrame([(i, f"text number {k} of many more words here") for k, i in enumerate(ids)], "doc_id long, text string")
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    rows = by_id(fp.fingerprints(docs.repartition(5)).collect())
    for k, (doc, text) in enumerate(texts):
        assert rows[doc].edited_sha256 == hashlib.sha256(edited(text, texts[(k + 1) % len(texts)][1]).encode()).hexdigest()
