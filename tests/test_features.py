import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import features, matcher, profile, sampling

LOOK = "entity_id string, name string, address string, country string"
PAIRS = "source1_entity_id string, candidate_entity_id string"


def test_matrix(spark):
    look = spark.createDataFrame([("S1-1", "apple computer", "1 infinite loop cupertino ca", "US"), ("S2-1", "apple computer", "1 infinite loop cupertino ca", "US"), ("S2-2", "pear works", "22 oak st, unit 5", "India")], LOOK)
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-1", "S2-9")], PAIRS)
    truth = spark.createDataFrame([("S1-1", "S2-1")], PAIRS)
    fx = features.FeatureExtractor()
    with pytest.raises(RuntimeError):
        fx.matrix(pairs, look, look)
    m = {r.candidate_entity_id: r for r in fx.fit(look, "name").matrix(pairs, look, look, truth).collect()}
    a, b, c = m["S2-1"], m["S2-2"], m["S2-9"]
    assert list(m["S2-1"].__fields__) == [*features.PAIR, *features.FEATURES, "label"]
    assert a.label == 1 and b.label == 0 and a.feat_name_tfidf_cosine == pytest.approx(1) and a.feat_country_match == 1 and b.feat_country_match == 0
    assert a.exact_street_number_match == 1 and a.street_number_numeric_distance == 0 and b.street_number_numeric_distance == 21 and b.unit_number_match == 0
    assert c.feat_name_exact_match == 0 and c.feat_name_len_diff_ratio == 1 and c.feat_name_tfidf_cosine == 0
    assert all(0 <= v <= 1 for r in m.values() for k, v in r.asDict().items() if k.startswith("feat_"))


def test_train_score_save(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for e in range(100):
        for k in range(5):
            y = int(k == 0 and e % 5 != 0)
            rows.append((f"S1-{e}", f"S2-{e}-{k}", y, *(rng.uniform(0.7, 1) if y else rng.uniform(0, 0.4) for _ in features.FEATURES)))
    m = spark.createDataFrame(rows, f"{PAIRS}, label int, " + ", ".join(f"{c} double" for c in features.FEATURES))
    ids = m.select(F.col("source1_entity_id").alias("entity_id")).distinct().withColumn("stratum", F.lit("x"))
    split = sampling.split(ids, "entity_id", ["stratum"])
    model = matcher.train(m, split, matcher.MatcherParams(max_iter=5, max_depth=3, min_rows=2))
    assert model.report["average_precision"] > 0.9 and model.report["roc_auc"] > 0.9
    scored = model.score(m)
    truth = m.filter("label = 1").select(*features.PAIR)
    t = matcher.tune(model, scored, ids.select(F.col("entity_id").alias("source1_entity_id")), truth)
    assert 0.5 <= t <= 0.95 and model.threshold() == t and model.threshold(0.7) == 0.7 and model.report["val_macro_f05"] > 0.9
    model.save(str(tmp_path / "m"))
    back = matcher.Matcher.load(spark, str(tmp_path / "m"))
    assert back.report == model.report and back.importance() == model.importance()
    three = matcher.three_way(ids, "entity_id", ["stratum"])
    assert {r.split: r["count"] for r in three.groupBy("split").count().collect()} == {"train": 60, "val": 20, "test": 20}


def test_change_notes(spark):
    rows = [("Acme Inc", "acme inc", "1 Main St", "1 Main St"), ("Acme Inc", "Inc Acme", "1 Main, Rome", "Rome, 1 Main"), ("Acme", "Acmé www.acme.com", "near park 5", None), ("A B", "A B C", "Near 5", "far 6")]
    df = profile.change_notes(spark.createDataFrame(rows, "a string, b string, x string, y string"), "a", "b", "x", "y")
    assert [r.notes for r in df.collect()] == [
        "Case variation only; Exact address match",
        "Name word transposition/reordering; Address component inversion/reordering",
        "Non-Latin/Indic script or accent in name; URL / Domain appended to name; Lexical variation / typo / alias; Target address MISSING (Null)",
        "Legal suffix/prefix addition or omission; Landmark addition/omission; Street/Door number variation (range or unit)",
    ]


def test_class_notes_stand_for_all_pairs(spark):
    import random

    r = random.Random(3)
    rows = [(f"S{1 + i % 3}-{i}", r.choice("xy"), r.choice(["Apex Tools", "apex tools", "Apex LLC", None]), r.choice(["1 Main, Rome", "Rome, 1 Main", "nan", "1 MAIN, Rome, near B"])) for i in range(150)]
    e = spark.createDataFrame(rows, "entity_id string, truth string, name string, address string")
    q, c = e.filter("entity_id like 'S1-%'"), e.filter("entity_id not like 'S1-%'")
    got = profile.class_notes(q, c, "name", "address", "truth").collect()
    of: dict = {}
    for x in got:
        if x.kind == "member":
            of.setdefault(x.representative, []).append(x.source1_entity_id or x.candidate_entity_id)
    pairs = [x for x in got if x.kind == "pair"]
    side = lambda x, p: x.select("truth", *(F.col(k).alias(f"{p}{k}") for k in ("entity_id", "name", "address")))
    every = profile.change_notes(side(q, "l_").join(side(c, "r_"), "truth"), "l_name", "r_name", "l_address", "r_address")
    want = sorted((x.l_entity_id, x.r_entity_id, x.notes) for x in every.collect())
    assert sorted((a, b, x.notes) for x in pairs for a in of[x.source1_entity_id] for b in of[x.candidate_entity_id]) == want
    assert len(pairs) <= 2 * 16 * 16 < len(want)  # two truths, sixteen records at most a side


def test_matrix_makes_no_row_for_a_gram_of_a_pair(spark):
    look = spark.createDataFrame([("S1-1", "apex tools", "1 main", "US"), ("S2-1", "apex tool", "1 main", "US")], LOOK)
    m = features.FeatureExtractor().fit(look, "name").matrix(spark.createDataFrame([("S1-1", "S2-1")], PAIRS), look, look)
    assert "gram" not in m._jdf.queryExecution().optimizedPlan().toString()

def test_query_trains_the_full_schedule(spark, monkeypatch):
    from lodestone.plans import pairs

    seen = []

    class Seen(Exception):
        pass

    def train(matrix, split, params=matcher.MatcherParams()):
        seen.append(params)
        raise Seen

    rows = spark.createDataFrame([("S1-1", "S2-1", 1)], f"{PAIRS}, label int")
    records = spark.createDataFrame([("S1-1", 1, "US", "a"), ("S2-1", 2, "US", "a")], "entity_id string, src int, country string, truth string")
    monkeypatch.setattr(matcher, "train", train)
    monkeypatch.setattr(pairs, "matrix", lambda *_: rows)
    monkeypatch.setattr(pairs, "records", lambda *_: records)
    with pytest.raises(Seen):
        pairs.train_score(spark, "")
    assert seen == [matcher.MatcherParams()]
