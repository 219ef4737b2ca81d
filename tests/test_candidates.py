"""Candidates of blocks of queries against a join of all keys, and counts of true pairs that are never listed."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import blocking, candidates, metrics

KEYS = "country string, strategy string, key string, weight int, entity_id string"
PAIR = ["source1_entity_id", "candidate_entity_id"]


@pytest.fixture(scope="module")
def keyed(spark):
    r = random.Random(7)

    def side(prefix, n):
        out = []
        for _ in range(n):
            # Ids repeat, with other countries; a key may come twice.
            country, who = r.choice(["US", "FR"]), f"{prefix}-{r.randrange(n * 3 // 4)}"
            out += [(country, s, f"K:{k}", 2 + len(s) % 3, who) for s in ("token", "address") for k in r.choices(range(12), k=r.randrange(4))]
        return spark.createDataFrame(out, KEYS)

    return side("S1", 60), side("S2", 90)


class _All(dict):
    """Each gram in its own place."""

    def get(self, key, default=None):
        return key


def lookups(spark):
    r = random.Random(8)
    return [spark.createDataFrame([(f"{p}-{i % (n - 9)}", f"{p}{i}", r.choice("abcdef") if i % 7 else None) for i in range(n)], "entity_id string, name string, truth string") for p, n in (("S1", 60), ("S2", 90))]


@pytest.mark.parametrize("block_keys", [10, 10_000])
def test_blocks_equal_the_join(spark, keyed, block_keys):
    q, c = keyed
    left, right = lookups(spark)
    near = q.groupBy("entity_id").agg(F.min("country").alias("at"))
    spec = candidates.rows(q, near, c, blocking.KEY, left, right, block_keys)
    want = blocking.top_candidates(blocking.scored(q, c), 7).cache()
    true = left.join(right.withColumnRenamed("entity_id", PAIR[1]), "truth").select(F.col("entity_id").alias(PAIR[0]), PAIR[1]).distinct()
    labelled = want.join(true.withColumn("label", F.lit(1)), PAIR, "left").fillna(0, ["label"])
    rows = lambda df, cols: sorted(map(tuple, df.select(*cols).collect()))
    cols = [*PAIR, "score", "rank", "label"]
    assert rows(candidates.top(spec, 7, True, []), cols) == rows(labelled, cols)
    sides = labelled.join(left.select(F.col("entity_id").alias(PAIR[0]), F.col("name").alias("l_name")), PAIR[0]).join(right.select(F.col("entity_id").alias(PAIR[1]), F.col("name").alias("r_name")), PAIR[1])
    cols += ["l_name", "r_name"]
    assert rows(candidates.top(spec, 7, True, ["name"]), cols) == rows(sides, cols)
    per = q.select(*blocking.KEY, F.col("entity_id").alias(PAIR[0])).join(c.select(*blocking.KEY, F.col("entity_id").alias(PAIR[1])), blocking.KEY).select("strategy", *PAIR).distinct()
    every = per.unionByName(per.select(F.lit("union").alias("strategy"), *PAIR).distinct()).join(true.withColumn("hit", F.lit(1)), PAIR, "left")
    ablated = every.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("h"))
    assert rows(candidates.by_strategy(spec), ["strategy", "candidate_pairs", "recalled_pairs"]) == rows(ablated, ["strategy", "n", "h"])
    assert metrics.true_counts(left, right).agg(F.sum("t")).first()[0] == true.count()


def test_no_pair_is_dealt_out(spark):
    columns = ["entity_id", "country", "norm_name", "norm_name_no_legal", "addr_postal_code", "addr_city", "addr_state", "addr_street_number", "addr_street_name", "business_address"]
    make = lambda *rows: spark.createDataFrame([(*r, r[2], "90210", *[None] * 5) for r in rows], ", ".join(f"{c} string" for c in columns))
    corpus, queries = make(("S2-1", "US", "apex tools")), make(("S1-1", "US", "apex tools"), ("S1-2", "US", None))
    b = blocking.MultiStrategyBlocker(blocking.BlockingConfig.production()).fit(corpus)
    plan = b.block_pairs(queries)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan.split("MapInArrow")[0]


def test_nothing_to_ask(spark, keyed):
    q, c = keyed
    near = q.select("entity_id", F.col("country").alias("at"))
    assert candidates.top(candidates.rows(q.limit(0), near, c, blocking.KEY), 5, False, []).count() == 0
    assert candidates.top(candidates.rows(q, near.distinct(), c.limit(0), blocking.KEY), 5, False, []).count() == 0


@pytest.mark.parametrize("engine", ["exact", "dense"])
def test_nearest_names_equal_all_pairs(spark, engine, monkeypatch):
    import numpy as np

    from lodestone.operators import tfidf

    monkeypatch.setattr(tfidf, "QUERY_BLOCK", 7)
    r = random.Random(9)
    names = lambda p, n: [(f"{p}-{i}", r.choice(["US", "FR"]), " ".join(r.choices(["apex", "zen", "tools", "foods", "of"], k=r.randrange(4)))) for i in range(n)]
    q, c = names("S1", 40), names("S2", 70)
    made = [spark.createDataFrame(x, "entity_id string, country string, norm_name string") for x in (q, c)]
    got = tfidf.nearest(*made, "norm_name", blocking.BlockingConfig(knn_engine=engine, top_k_tfidf=4, min_tfidf_sim=0.3), digits=6)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("gram") == 0  # no row is made for a gram of a pair
    model: dict = {}
    for country in ("US", "FR"):
        own = [tfidf.grams(t, _All(), 3) for _, x, t in c if x == country]
        df: dict = {}
        for g in own:
            for k in g:
                df[k] = df.get(k, 0) + 1
        model[country] = {g: np.log((1 + len(own)) / (1 + n)) + 1 for g, n in df.items() if n >= min(2, len(own))}
    order = sorted({g for m in model.values() for g in m})
    h = {r[0]: r[1] for r in spark.createDataFrame([(g,) for g in order], "g string").select("g", F.xxhash64("g")).collect()}
    basis = tfidf.signs(np.array([h[g] for g in order]), 128) if engine == "dense" else np.eye(len(order))

    def vector(country, t):
        v = sum((n * model[country][g] * basis[order.index(g)] for g, n in tfidf.grams(t, _All(), 3).items() if g in model[country]), np.zeros(basis.shape[1]))
        return v / (np.linalg.norm(v) or 1.0)

    want = set()
    for i, x, t in q:
        sims = sorted((-round(float(vector(x, t) @ vector(y, u)), 6), j) for j, y, u in c if x == y)
        want |= {(i, j, -s, k) for k, (s, j) in enumerate(sims[:4], 1) if -s >= 0.3}
    assert {(a, b, round(s, 6), k) for a, b, s, k in got.collect()} == want


def test_equal_candidates_are_dealt_out_once(spark):
    who, keys = [f"S2-{i:02}" for i in range(40)], [f"K:{k}" for k in range(6)]
    index = spark.createDataFrame([("US", "token", k, 2, w) for w in who for k in keys] + [("US", "token", "K:unasked", 2, who[0])], KEYS)
    asked = spark.createDataFrame([("US", "token", k, 2, w) for w in ("S1-1", "S1-2") for k in keys], KEYS)
    left, right = (spark.createDataFrame([(w, "apex", "t") for w in ids], "entity_id string, name string, truth string") for ids in (["S1-1", "S1-2"], who))
    spec = candidates.rows(asked, asked.select("entity_id", "country").distinct(), index, blocking.KEY, left, right, 1000)
    assert spec.count() == 1 + 2 + 12  # the class, the queries' rows and their keys
    got = candidates.top(spec, 30, True, ["name"]).collect()
    assert sorted(tuple(r) for r in got) == [(q, w, 12, n, 1, "apex", "apex") for q in ("S1-1", "S1-2") for n, w in enumerate(who[:30], 1)]


@pytest.mark.parametrize("most", [3, 200_000])
def test_cosines_in_blocks_equal_the_join(spark, most):
    from lodestone.operators import tfidf

    r = random.Random(10)
    words = ["apex", "zen", "tools", "a", "foods", "Öl", "店舗", "tool"]
    # An id may have several names, all of which count.
    rows = [(f"S{1 + i % 3}-{i % 50}", 1 + i % 3, "US", " ".join(r.choices(words, k=r.randrange(5)))) for i in range(60)]
    e = spark.createDataFrame([(*x, x[3]) for x in rows], "entity_id string, src int, country string, norm_name string, norm_name_no_legal string")
    q, c = e.filter("src = 1"), e.filter("src <> 1")
    b = blocking.MultiStrategyBlocker(blocking.BlockingConfig(enable_tfidf=False, enable_phonetic=False, enable_address=False)).fit(c)
    names = tfidf.texts(e, "entity_id", "norm_name").withColumn("text", F.lower(F.trim("text")))
    names, cosine = tfidf.block_cosine(names, e.count(), most=most)
    assert ("dfs" in names.columns) == (most == 3)
    got = b.sided_pairs(q, names, names, ("cosine", cosine))
    assert "gram" not in got._jdf.queryExecution().optimizedPlan().toString()
    counts = tfidf.gram_counts(e, "entity_id", "norm_name")
    w = tfidf.weights(counts, tfidf.idf(counts, e.count()))
    want = {tuple(x[:2]): x[2] for x in tfidf.pair_cosine(b.block_pairs(q).select(*PAIR), w, w).collect()}
    found = {tuple(x[:2]): x[2] for x in got.select(*PAIR, "cosine").collect()}
    assert len(found) == got.count() and found == pytest.approx(want) and len({round(x, 3) for x in found.values()}) > 5
