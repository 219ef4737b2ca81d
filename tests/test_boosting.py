import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import boosting, matcher


def test_tasks_grow_the_trees_of_one(spark):
    r = random.Random(4)
    rows = []
    for i in range(3000):
        a, b, c = r.random(), r.choice([0.0, 1.0]), r.random()
        rows.append((a, b, c, int(a + 0.2 * b > 0.7) if r.random() < 0.95 else r.randrange(2), i % 5 == 0))
    df = spark.createDataFrame(rows, "a double, b double, c float, label int, is_val boolean").repartition(4).persist()
    params = matcher.MatcherParams(max_iter=8, max_depth=3, min_rows=20)
    one, loss = boosting.train(df, ["a", "b", "c"], "label", "is_val", 2.0, params, 1)
    three, other = boosting.train(df, ["a", "b", "c"], "label", "is_val", 2.0, params, 3)
    assert [t["feature"] for t in one.nodes] == [t["feature"] for t in three.nodes] and len(one.nodes) == 8
    assert loss == pytest.approx(other) and loss < 0.9 and max(t["depth"] for t in one.nodes) == 3
    assert one.importances()[0] > one.importances()[2]
    got = one.score(df, ["a", "b", "c"]).agg(F.avg(((F.col("prob") >= 0.5).cast("int") == F.col("label")).cast("int"))).first()[0]
    assert got > 0.9


def test_bins_hold_few_values_apart_and_many_by_rows(spark):
    df = spark.range(10_000).select((F.col("id") % 3).cast("double").alias("few"), F.col("id").cast("double").alias("many"))
    few, many = boosting.edges(df, ["few", "many"])
    assert few.tolist() == [0.5, 1.5] and len(many) == boosting.BINS - 1
    assert max(abs(x - 10_000 * (i + 1) / boosting.BINS) for i, x in enumerate(many)) < 120
