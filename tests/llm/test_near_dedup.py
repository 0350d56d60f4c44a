import random
from collections import Counter

import numpy as np
import pytest

from loomspark.llm import near_dedup as nd


def shingles(text):
    w = text.lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (Counter([tuple(w)]) if w else Counter())


def brute(docs):
    """Classes by weighted similarity over all pairs of texts; weights from document frequencies counted one by one."""
    reps = {}
    for i, t in sorted(docs):
        reps.setdefault(t or "", i)
    held = {t: shingles(t) for t in reps}
    cell = {}
    for s in held.values():
        for x in s:
            if x not in cell:
                cell[x] = int(nd.shingles(" ".join(x))[0][0] >> np.uint64(44))
    counts = np.zeros(nd.COUNTERS + nd.PART, np.int64)
    counts[nd.COUNTERS] = len(docs)
    for _, t in docs:
        for c in {cell[x]: 0 for x in held[t or ""]}:
            counts[c] += 1
    idf = nd.inverse_frequencies(counts)
    sets = [(i, {x: n * float(idf[cell[x]]) for x, n in held[t].items()}) for t, i in reps.items()]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            shared = sum(min(w, b[k]) for k, w in a.items() if k in b)
            if shared and shared >= 0.8 * (sum(a.values()) + sum(b.values()) - shared) - 1e-9:
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: root(reps[t or ""]) for i, t in docs}


@pytest.fixture(scope="module")
def planted():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    docs, n = [], 0
    passage = " ".join(word() for _ in range(60))

    def add(t):
        nonlocal n
        docs.append((n, t))
        n += 1

    for _ in range(80):
        add(" ".join(word() for _ in range(r.randint(30, 300))))
    for i in range(60):  # a passage that many share, half of each text
        add(passage + " " + " ".join(word() for _ in range(60)))
    for base in [t for _, t in docs[:12]]:  # exact copies, and copies with one word changed
        add(base)
        w = base.split()
        w[len(w) // 2] = "changed"
        if len(w) > 60:
            add(" ".join(w))
    center = [word() for _ in range(220)]
    for i in range(70):  # one large group of near copies, each with an edit of its own
        w = list(center)
        for _ in range(2):
            w[r.randrange(len(w))] = word()
        add(" ".join(w))
    return docs


def test_classes_agree_with_brute_force(spark, planted):
    df = spark.createDataFrame(planted, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.classes(df).collect()}
    want = brute(planted)
    linked = lambda c: {(a, b) for a in c for b in c if a < b and c[a] == c[b]}
    assert linked(got) == linked(want) and len(linked(want)) > 1000
    assert nd.classes(df.repartition(5)).count() == len(planted)


def test_unsettled_large_buckets_lose_nothing(spark, planted, monkeypatch):
    """With bands of one sample the passage makes one bucket of many classes; leaders alone don't settle it."""
    monkeypatch.setattr(nd, "SMALL", 3)
    monkeypatch.setattr(nd, "BLOCK", 9)
    df = spark.createDataFrame(planted, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.classes(df).collect()}
    want = brute(planted)
    assert got == want


def test_sampling_estimates_weighted_similarity():
    r = np.random.default_rng(2)
    h = nd.mixed(np.arange(1, 1201, dtype=np.uint64))
    share = []
    for trial in range(12):
        r.shuffle(h)
        a, b = np.sort(h[:800]), np.sort(h[100:900])
        wa, wb = ((1 + (x % np.uint64(3))).astype(float) * 0.7 for x in (a, b))
        share.append(np.mean([x == y for x, y in zip(nd.bands(a, wa), nd.bands(b, wb))]))
    inter = 700 / 900
    assert abs(np.mean(share) - inter**nd.ROWS) < 0.12


def test_samples_are_the_least_keys():
    """Each sample against all keys of all shingles, worked out one text at a time; the last two texts are longer than a chunk."""
    gen = np.random.default_rng(3)
    g = np.random.default_rng(20240229)
    r, c = g.gamma(2, 1, (2, nd.SAMPLES, nd.VARIATES))
    b = g.random((nd.SAMPLES, nd.VARIATES)).astype(np.float32)
    one, r, c = (np.log(c) + r * b.astype(float) - r).astype(np.float32), r.astype(np.float32), np.log(c).astype(np.float32)
    for size, share in ((1, 0), (1, 1), (2, 0.5), (40, 1), (300, 0), (300, 0.1), (300, 1), (3000, 0.3), (5000, 1)):
        h = np.sort(nd.mixed(gen.integers(1, 1 << 60, size).astype(np.uint64)))
        w = np.where(gen.random(size) < share, gen.choice([0.5, 0.7, 0.99, 2, 3.5, 1e5], size), 1.0)
        row = (h & np.uint64(nd.VARIATES - 1)).astype(int)
        t = np.floor(np.log(w).astype(np.float32) / r[:, row] + b[:, row])
        keys = np.where(w == 1, one[:, row], c[:, row] - r[:, row] * (t - b[:, row] + 1))
        want = keys.argmin(1)
        picked, level = nd.samples(h, w)
        assert (picked == h[want]).all()
        assert (level == np.where(w[want] == 1, 0, t[np.arange(nd.SAMPLES), want])).all()


def test_sets_that_are_banded_together_have_their_own_bands():
    h = np.sort(nd.mixed(np.arange(1, 201, dtype=np.uint64)))
    sets = [(h[:k], np.where(h[:k] % np.uint64(3) == 0, 0.6, 1.0)) for k in (200, 0, 1, 7, 0, 150)]
    found = nd.all_bands(sets)
    assert [len(x) for x in found] == [nd.BANDS, 0, nd.BANDS, nd.BANDS, 0, nd.BANDS]
    assert all((x == nd.bands(*y)).all() for x, y in zip(found, sets, strict=True))
    assert nd.all_bands([]) == [] and [len(x) for x in nd.all_bands(sets[1:2])] == [0]


def test_few_keys_of_weighted_shingles_are_worked_out(monkeypatch):
    """All keys of all shingles, with the tables read across, took half of the operator's time."""
    done, floor = [], np.floor
    h = np.sort(nd.mixed(np.arange(1, 2001, dtype=np.uint64)))
    monkeypatch.setattr(nd.np, "floor", lambda x: done.append(x.size) or floor(x))
    assert len(nd.bands(h, 0.5 + (h % np.uint64(5)).astype(float) / 10)) == nd.BANDS
    assert 0 < sum(done) < len(h) * nd.SAMPLES / 10
    assert all(x.flags.c_contiguous and x.shape == (nd.VARIATES, nd.SAMPLES) for x in nd.variates())


def test_keep_one(spark, odd_docs, no_docs):
    kept = nd.keep_one(odd_docs)
    rows = kept.collect()
    assert kept.columns == odd_docs.columns and kept.dtypes == odd_docs.dtypes
    assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "2", "4", "5", "None", "7"])
    assert nd.keep_one(no_docs).count() == 0


def test_odd_rows(odd_docs, no_docs):
    rows = nd.classes(odd_docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.class_id, []).append(r.doc_id)
    groups = sorted(sorted(str(x) for x in v) for v in by.values())
    assert groups == sorted([["1"], ["2", "3"], ["4"], ["5", "5", "6"], ["None"], ["7"]])
    assert nd.classes(no_docs).count() == 0


def test_block_bound_excludes_no_link():
    r = np.random.default_rng(7)
    base = nd.mixed(np.arange(1, 301, dtype=np.uint64))
    held = []
    for i in range(60):
        keep = r.random(300) > 0.02 * (i % 12)
        own = nd.mixed(np.arange(10**6 + 100 * i, 10**6 + 100 * i + 5 * (i % 9), dtype=np.uint64))
        h = np.sort(np.concatenate([base[keep], own]))
        held.append((h, (1 + h % np.uint64(3) + (r.random(len(h)) < 0.05)).astype(np.uint32)))
    weight = lambda h: np.where(h % np.uint64(3) == 0, 0.5, 1.0).astype(np.float32)
    may = nd.likely(held, weight)
    links = 0
    for i in range(60):
        for j in range(i):
            if nd.similarity(held[i], held[j], weight) >= nd.THRESHOLD:
                links += 1
                assert may[i, j] and may[j, i]
    assert links > 50 and may.sum() < 60 * 60


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    text = "Alpha beta  gamma delta " + "y" * 300 + " beta ALPHA é 日本"
    whole = nd.word_hashes(text)
    monkeypatch.setattr(nd, "SEGMENT", 40)
    assert (nd.word_hashes(text) == whole).all() and len(whole) == len(text.split())
    assert whole[0] == whole[6] and whole[1] == whole[5] and len(set(whole.tolist())) == len(whole) - 2
    assert len(nd.word_hashes(" \n")) == 0


def test_repeated_passages_count(spark):
    """A passage repeated once more leaves the weighted similarity above 0.8; 10 times more takes it below."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    docs = []
    for i in range(40):
        w = [word() for _ in range(104)]
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w + w[-14:] * (10 if i % 2 else 1)))]
    want = brute(docs)
    assert all(want[2 * i + 1] == (2 * i if i % 2 == 0 else 2 * i + 1) for i in range(40))
    got = {r.doc_id: r.class_id for r in nd.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_counts_beyond_16_bits(spark):
    """Two texts of one word repeated 100,000 and 70,000 times: 0.7 alike."""
    docs = [(1, "a " * 100_004), (2, "a " * 70_004), (3, "a " * 99_000)]
    got = {r.doc_id: r.class_id for r in nd.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_texts_that_share_an_id(spark):
    """Each text is looked at: A and B share the id 1 and no word, C is near B."""
    r = random.Random(9)
    text = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(120))
    a, b = text(), text()
    rows = [(1, a), (1, b), (2, a), (3, b + " more")]
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        found = nd.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        by = {}
        for x in found:
            by.setdefault(x.class_id, set()).add((x.doc_id, x.digest))
        texts = sorted((sorted(i for i, _ in v), len({d for _, d in v})) for v in by.values())
        assert texts == [([1, 2], 1), ([1, 3], 2)]
        assert sorted(r.doc_id for r in nd.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) in ([1, 1], [1, 3])


def test_equal_rows_leave_one(spark):
    df = spark.createDataFrame([(7, "the same words in every row")] * 500 + [(8, "the same words in every row")], "doc_id long, text string").repartition(6)
    assert [r.doc_id for r in nd.keep_one(df).collect()] == [7]


def test_nothing_is_left_behind(spark):
    import os

    from loomspark.llm.common import fresh_path

    root = os.path.dirname(fresh_path(spark, "x")).removeprefix("file:")
    before = set(os.listdir(root))
    df = nd.classes(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g h i j k l")], "doc_id long, text string"))
    assert df.count() == 2
    assert {n.split("-")[0] for n in set(os.listdir(root)) - before} == {"classes"}


def test_keep_one_drops_a_row_without_an_id_beside_one_with(spark):
    df = spark.createDataFrame([(None, "one text"), (5, "one text"), (None, "another"), (None, "another")], "doc_id long, text string")
    assert sorted(map(str, nd.keep_one(df).collect())) == ["Row(doc_id=5, text='one text')", "Row(doc_id=None, text='another')"]
