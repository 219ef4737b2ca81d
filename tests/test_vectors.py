import numpy as np

from lodestone.operators import vectors


def brute(ids, x, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    for i, a in zip(ids, unit):
        if i % 10 == 0:
            near = sorted((-float(a @ b), j) for j, b in zip(ids, unit) if j != i)[:k]
            out += [(i, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(near)]
    return sorted(out)


def test_equals_brute_force_with_repeated_ids(spark):
    rng = np.random.default_rng(6)
    ids = [0, 0, *range(1, 80), 40]
    x = rng.normal(size=(len(ids), 6))
    rows = [(i, v.tolist()) for i, v in zip(ids, x)] + [(500, None), (510, []), (520, [0.0] * 6), (530, [float("nan")] * 6), (540, [1.0, 2.0])]
    v = vectors.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    for block, chunk in ((4096, 1024), (3, 7)):
        got = vectors.cosine_neighbours(v.filter("id % 10 = 0"), v, 4, block, chunk).collect()
        assert sorted((r[0], r[1], r[2], round(r[3], 9)) for r in got) == brute(ids, x, 4)
