import numpy as np

from lodestone.llm import search


def brute(ids, x, k):
    out = []
    for m, (i, a) in enumerate(zip(ids, x)):
        if i % 50 == 0:
            near = sorted((-int(a @ b), j) for n, (j, b) in enumerate(zip(ids, x)) if n != m)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    v = search.integer_vectors(df)
    return sorted(map(tuple, search.top_k(v.filter("vec_id % 50 = 0"), v, 5, **kw).collect()))


def test_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.2, (700, 24))
    x[100:300] = x[100]  # one very common vector
    want = np.floor(256 * x.astype(np.float32).astype(np.float64))
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    assert found(spark, rows) == brute(range(700), want, 5) == found(spark, rows, block=5, chunk=64)


def test_repeated_ids_are_rows_of_their_own(spark):
    rng = np.random.default_rng(7)
    ids = [0, 0, 0, 50, *range(1, 60), 50]
    x = rng.normal(0, 0.3, (len(ids), 8))
    x[1] = x[0]
    want = np.floor(256 * x.astype(np.float32).astype(np.float64))
    rows = [(i, [float(c) for c in v], 0) for i, v in zip(ids, x)]
    assert found(spark, rows) == brute(ids, want, 5) == found(spark, rows, block=2, chunk=8, seeds=16)


def test_registered_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.1, (300, 16))
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, search.op6_segment_topk(spark, str(tmp_path)).collect())) == brute(range(300), np.floor(256 * x.astype(np.float32).astype(np.float64)), 5)


def test_odd_rows(spark):
    ok = [0.5, -0.25]
    rows = [(0, ok, 1), (1, None, 1), (2, [], 1), (3, [float("nan"), 1.0], 1), (4, [None, 1.0], 1), (5, [float("inf"), 0.0], 1), (6, [1.0, 1.0], None), (7, [1.0, 2.0, 3.0], 0), (None, ok, 0)]
    assert found(spark, rows) == [(0, 1, 6, 128 * 256 - 64 * 256)]
    assert found(spark, []) == []
    assert found(spark, [(0, ok, 0)]) == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 60, (20, 64))
    x = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 8, (4000, 64)))
    top = search.TopK(x[:20], 5)
    for s in (4, 16, 32):
        r = search.Resolution(64, s)
        a, b = r(x[:50]), r(x[50:100])
        assert (a @ b.T + 1e-6 >= x[:50] @ x[50:100].T).all()
    for a in range(0, 4000, 500):
        top.add(np.arange(a, a + 500), x[a : a + 500])
    assert top.exact < top.pairs / 4
