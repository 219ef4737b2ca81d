import pytest
from pyspark.sql import functions as F

from lodestone.functions import keys
from lodestone.operators import blocking, tfidf

COLUMNS = "entity_id string, country string, norm_name string, norm_name_no_legal string, addr_postal_code string, addr_city string, addr_state string, addr_street_number string, addr_street_name string, business_address string"


def entity(id_, country, name, postal=None, city=None, state=None, number=None, street=None, raw=None):
    return (id_, country, name, name, postal, city, state, number, street, raw)


def keys_of(df, column):
    return [set(r[0]) for r in df.select(column).collect()]


def test_token_keys(spark):
    df = spark.createDataFrame([("johnson electric motors",), ("the of",), (None,), ("",), ("shri balaji traders",)], "n string")
    a, b, c, d, e = keys_of(keys.token_key_column(df, "n", least=2), "token_keys")
    assert {"TOK2:electric_johnson", "LONG:electric", "TOK1:electric", "ACRO:jem", "G4:elec", "G3:ele", "PRE6:johnso", "PRE5:johns", "TOK2_PRE3:ele_joh"} <= a
    assert "TOK1:of" in b and not c and not d
    assert "PFX_TOK:balaji" in e and "TOK:shri" in e


def test_phonetic_keys(spark):
    df = spark.createDataFrame([("johnson electric",), ("12 34",)], "n string")
    a, b = keys_of(keys.phonetic_key_column(df, "n"), "phonetic_keys")
    assert "META1:JNSN" in a and "META2:ELKTRK_JNSN" in a and "SND1:J525" in a and not b


def test_address_keys(spark):
    rows = [
        entity("1", "US", "Apex Tools", "90210", "Beverly Hills", "CA"),
        entity("2", "India", "apex tools", None, "Bangalore", "Karnataka", "12", "mg road", "plot 045, mg road, bangalore 560041"),
        entity("3", "India", None),
        entity("4", "US", "ab", None, None, None, None, None, "5 oak street, west virginia"),
    ]
    a, b, c, d = keys_of(keys.address_key_column(spark.createDataFrame(rows, COLUMNS)), "address_keys")
    assert {"POST:90210_ap", "GEO:CALIFORNIA_beverly hills_ap", "GEO:CA_beverly hills_ap", "POST_STATE:CALIFORNIA_90210", "GEO_TOK:CALIFORNIA_beverly hills_apex"} <= a
    assert {"IN_PIN:560041", "ADDR_PLOT_CITY:bengaluru_45", "ADDR_PLOT_PIN:560041_045", "ADDR_NUM_CITY:bengaluru_045", "NUM_ST:KARNATAKA_12"} <= b
    assert not c and not any(k.startswith("GEO") for k in d)


def test_non_ascii_names_get_latin_keys(spark):
    df = spark.createDataFrame([("हरियाणा traders",)], "n string")
    (a,) = keys_of(keys.token_key_column(df, "n"), "token_keys")
    assert any(k.startswith("XLAT_TOK:hariy") for k in a) and "TOK:traders" in a


@pytest.mark.parametrize("tfidf_on", [False, True])
def test_two_countries(spark, tfidf_on):
    corpus = spark.createDataFrame(
        [entity("S2-1", "US", "apex tools", "90210"), entity("S2-2", "US", "zenith foods"), entity("S2-3", "India", "apex tools"), entity("S3-1", "US", "apex tool works")], COLUMNS
    )
    queries = spark.createDataFrame([entity("S1-1", "US", "apex tools", "90210"), entity("S1-2", "France", "apex tools"), entity("S1-3", "US", None)], COLUMNS)
    b = blocking.MultiStrategyBlocker(blocking.BlockingConfig(enable_tfidf=tfidf_on)).fit(corpus)
    got = {r[0]: list(r[1]) for r in b.block_queries(queries).collect()}
    assert got["S1-1"][0] == "S2-1" and "S3-1" in got["S1-1"] and "S2-3" not in got["S1-1"]
    assert got["S1-2"] == [] and got["S1-3"] == []


def test_unfitted(spark):
    with pytest.raises(RuntimeError):
        blocking.MultiStrategyBlocker().block_pairs(spark.createDataFrame([], COLUMNS))


def test_large_blocks_and_plan(spark):
    rows = [(f"S2-{i}", "US", "token", "TOK:a" if i < 5 else f"TOK:{i}") for i in range(8)]
    index = spark.createDataFrame(rows, "entity_id string, country string, strategy string, key string").withColumn("weight", F.lit(3))
    assert {r.key for r in blocking.without_large_blocks(index, 4).collect()} == {"TOK:5", "TOK:6", "TOK:7"}
    pairs = blocking.top_candidates(blocking.scored(index, index), 2)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan and "WindowGroupLimit" in plan


def test_quality(spark):
    q = spark.createDataFrame([("q1", "US"), ("q2", "US"), ("q3", "India")], "entity_id string, country string")
    c = spark.createDataFrame([(f"c{i}", "US") for i in range(1000)], "entity_id string, country string")
    truth = spark.createDataFrame([("q1", "c1"), ("q1", "c2"), ("q2", "c3"), ("q2", "c4")], "source1_entity_id string, candidate_entity_id string")
    pairs = spark.createDataFrame([("q1", "c1"), ("q1", "c2"), ("q2", "c3"), ("q2", "c9")], "source1_entity_id string, candidate_entity_id string")
    m = blocking.quality(q, pairs, truth, c).filter("country is null").first()
    assert (m.pair_recall, m.entity_recall, m.true_pairs, m.singleton_queries) == (75.0, 100.0, 4, 1) and m.reduction_ratio > 99
    assert blocking.ceiling(1.0) == 1.0 and blocking.ceiling(0.0) == 0.0


def test_tfidf_neighbours_equal_brute_force(spark):
    import math
    from collections import Counter

    names = ["apex tools", "apex tool", "zenith foods", "zen foods ltd", "apex", "a b", "tools apex"]

    def grams(t):
        return Counter(w[i : i + 3] for x in t.split() for w in [f" {x} "] for i in range(max(1, len(w) - 2)))

    counted = [grams(t) for t in names]
    df = Counter(g for c in counted for g in c)
    idf = {g: math.log((1 + len(names)) / (1 + n)) + 1 for g, n in df.items()}
    vec = []
    for c in counted:
        v = {g: n * idf[g] for g, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vec.append({g: x / norm for g, x in v.items()})
    rows = spark.createDataFrame([(f"{i}", t, "X") for i, t in enumerate(names)], "id string, t string, country string")
    counts = tfidf.gram_counts(rows, "id", "t")
    w = tfidf.weights(counts, tfidf.idf(counts, len(names))).withColumn("country", F.lit("X"))
    for heavy in (1, 2000):
        got = {(r[0], r[1]): r[2] for r in tfidf.similar(w, w, 100, 0.2, heavy=heavy).select("source1_entity_id", "candidate_entity_id", "similarity").collect()}
        want = {(str(i), str(j)): s for i, a in enumerate(vec) for j, b in enumerate(vec) if (s := sum(x * b.get(g, 0) for g, x in a.items())) >= 0.2}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
