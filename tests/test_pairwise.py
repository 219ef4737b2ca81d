import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import pairwise, similarity
from lodestone.operators import blocking, features


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        cur = [i]
        for j, d in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != d)))
        prev = cur
    return prev[-1]


def test_many_pairs_equal_one_by_one():
    r = random.Random(3)
    words = ["".join(r.choices("abcdé", k=r.randrange(1, 9))) for _ in range(40)] + ["店舗", "x"]
    text = lambda k: (" " * r.randrange(1, 3)).join(r.choices(words, k=r.randrange(k)))
    left = list(dict.fromkeys(["", " ", "a", "ab", "a" * 64, "a" * 65, "b" * 128, *(text(k) for k in (4, 9, 30) for _ in range(20))]))
    right = list(dict.fromkeys(["", " ", "ba", "a" * 63, "a" * 66, "b" * 129, *(text(k) for k in (4, 9, 30) for _ in range(20)), *left[:20]]))
    p, q = (x.ravel() for x in np.meshgrid(np.arange(len(left)), np.arange(len(right)), indexing="ij"))
    got = pairwise.similarities(left, np.arange(len(left)), right, np.arange(len(right)))(p, q)
    in_order = lambda x: " ".join(sorted(x.split()))
    for i, (a, b) in enumerate((left[x], right[y]) for x, y in zip(p, q)):
        n = max(len(a), len(b), 1)
        want = [1 - distance(a, b) / n, similarity.jaro_winkler(a, b), similarity.indel_ratio(in_order(a), in_order(b)), similarity.token_set_ratio(a, b)]
        assert [float(x[i]) for x in got] == [*(1.0 if a == b else float(np.float32(w)) for w in want), float(np.float32(abs(len(a) - len(b)) / n)), float(a == b)], (a, b)


def test_features_in_blocks_equal_those_of_looked_up_rows(spark):
    r = random.Random(11)
    words = ["apex", "zen", "tools", "foods", "Öl", "店舗", "tool"]
    rows = [(f"S{1 + i % 3}-{i % 50}", 1 + i % 3, "US", " ".join(r.choices(words, k=r.randrange(5))), r.choice([None, f"{i % 4} main st, unit {i % 3}", "9 " + "long " * 20])) for i in range(60)]
    e = spark.createDataFrame([(*x, x[3], x[3][:6]) for x in rows], "entity_id string, src int, country string, norm_name string, business_address string, norm_name_no_legal string, truth string")
    q, c = e.filter("src = 1"), e.filter("src <> 1")
    b = blocking.MultiStrategyBlocker(blocking.BlockingConfig(enable_tfidf=False, enable_phonetic=False, enable_address=False)).fit(c)
    fx = features.FeatureExtractor().fit(e)
    look = [fx.sides(features.lookup(x)).join(x.select("entity_id", "truth").distinct(), "entity_id") for x in (q, c)]
    got, want = fx.in_blocks(b, q, *look), fx.of_sides(b.sided_pairs(q, *look))
    columns = [*features.PAIR, *(F.round(x, 5).alias(x) if x == "feat_name_tfidf_cosine" else x for x in features.FEATURES), "label"]
    assert got.select(*want.columns).schema.simpleString() == want.schema.simpleString()
    held = sorted(got.select(*columns).collect())
    assert len(held) > 200 and held == sorted(want.select(*columns).collect())
    assert "pythonudf" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
