import numpy as np

from loomspark.llm import neighbours as nn


def brute(vectors, k=10, every=100):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], float)
    out = {}
    for i in sorted({i for i in ids if i % every == 0}):
        d = np.sqrt(((x - x[ids == i][0]) ** 2).sum(1))
        keep = ids != i
        order = np.lexsort((ids[keep], d[keep]))[:k]
        out[i] = [(int(ids[keep][j]), float(d[keep][j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall_of(want, got):
    return sum(len({a for a, _ in want[q]} & {a for a, _ in got.get(q, [])}) for q in want) / sum(map(len, want.values()))


def test_recall_comes_from_the_leaves(spark, monkeypatch):
    """A sample of a twentieth of the table, several blocks a leaf, and clusters: recall falls when one leaf alone is opened."""
    monkeypatch.setattr(nn, "SAMPLE", 120)
    monkeypatch.setattr(nn, "BLOCK", 60)
    monkeypatch.setattr(nn, "QUERIES", 7)
    r = np.random.default_rng(6)
    centers = r.normal(size=(40, 12))
    x = centers[r.integers(0, 40, 2400)] + 0.6 * r.normal(size=(2400, 12))
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, every=20)
    assert recall_of(want, found(nn.neighbours(df, every=20))) >= 0.9
    assert found(nn.neighbours(df, every=20, recall=1.0)) == want
    monkeypatch.setattr(nn, "calibrate", lambda *a: 1)
    few = found(nn.neighbours(df, every=20))
    assert recall_of(want, few) < 0.8 and all(len(v) == 10 for v in few.values())


def test_regions_hold_every_leaf_and_are_bounded():
    held = np.array([0, 4000, 90, 7, 9000, 0, 1, 4096, 1])
    region, blocks = nn.regions(held)
    assert region.tolist() == [0, 0, 0, 1, 2, 3, 3, 4, 5] and blocks.tolist() == [1, 1, 3, 1, 1, 1]


def test_recall_on_embeddings(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want, got = brute([(r.vec_id, r.embedding) for r in v.collect()]), found(nn.query(spark, "/root/testdata/sf0.1"))
    assert set(want) == set(got)
    share = recall_of(want, got)
    print("recall", share)
    assert 0.9 <= share
    for q in got:
        d = dict(got[q])
        assert got[q] == sorted(got[q], key=lambda x: (x[1], x[0]))
        assert all(abs(d[i] - s) < 1e-12 for i, s in want[q] if i in d)


def test_equal_vectors_and_ties(spark):
    hot = [(i, [1.0, 2.0]) for i in range(0, 3000)]
    rest = [(i, [float(i % 7), float(i % 11)]) for i in range(3000, 3200)]
    df = spark.createDataFrame(hot + rest, "vec_id long, embedding array<float>")
    got = found(nn.neighbours(df, recall=1.0))
    assert got == brute(hot + rest)


def test_few_candidates_and_unusable_rows(spark):
    rows = [
        (0, [1.0, 0.0], "x"), (1, [0.0, 1.0], None), (2, None, "x"), (3, [0.0, 0.0], "x"), (4, [None, 1.0], "x"), (5, [float("nan"), 1.0], "x"),
        (6, [float("inf"), 1.0], "x"), (7, [1.0], "x"), (None, [3.0, 3.0], "x"), (100, [1.0, 0.0], "x"), (1, [0.0, 1.0], "y"), (200, [], "z"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = found(nn.neighbours(df))
    assert got == {0: [(100, 0.0), (1, 2**0.5)], 100: [(0, 0.0), (1, 2**0.5)]}
    assert nn.neighbours(df.limit(0)).count() == 0


def test_tree_visits_every_leaf_once():
    x = np.random.default_rng(3).normal(size=(500, 8))
    tree = nn.Tree.fit(x, 20)
    assert sorted(tree.visits(x[0], 10**6)) == list(range(tree.leaves)) and tree.leaves > 10
    first = [tree.visits(v, 1)[0] for v in x[:50]]
    assert np.mean(tree.assign(x[:50]) == first) > 0.7


def test_the_search_aims_at_its_target(spark, monkeypatch):
    aimed, calibrate = [], nn.calibrate
    monkeypatch.setattr(nn, "calibrate", lambda *a: aimed.append(a[-1]) or calibrate(*a))
    x = np.random.default_rng(4).normal(size=(300, 4)).tolist()
    assert nn.neighbours(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")).count() == 30
    assert aimed == [0.97]
