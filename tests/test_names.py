import pytest

from lodestone.functions import names, text

CASES = [
    ("Custom Wealth Services LLC", "custom wealth services llc", "custom wealth services", "llc"),
    ("LLC Moncada Léarning Center", "moncada learning center llc", "moncada learning center", "llc"),
    ("Pvt. EFS Print Ventures Ltd.", "efs print ventures limited", "efs print ventures", "limited"),
    ("<< Team Ecole", "team ecole", "team ecole", None),
    ("-- Holloway Peak Inc Seafood", "holloway peak seafood inc", "holloway peak seafood", "inc"),
    ("Thermal & Fils SASU", "thermal and fils sasu", "thermal and fils", "sasu"),
    ("Orelee's Barbershop", "orelees barbershop", "orelees barbershop", None),
    (None, "", "", None),
    ("   ", "", "", None),
    ("NULL", "", "", None),
    ("www.birch-bridge.com", "birch bridge", "birch bridge", None),
    ("birch.com | Foo MD", "foo", "foo", None),
    ("lndia lnvestment 1td", "india investment limited", "india investment", "limited"),
]


def test_golden_names(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, business_name string")
    rows = names.normalized(df).orderBy("i").collect()
    assert [(r.norm_name, r.norm_name_no_legal, r.legal_type) for r in rows] == [c[1:] for c in CASES]


def test_outputs_replace_columns_of_their_names(spark):
    df = spark.createDataFrame([("A Co", "old")], "business_name string, norm_name string")
    assert names.normalized(df).columns == ["business_name", *names.OUTPUTS]
    assert names.normalized(df.limit(0)).count() == 0


def test_segmentation_with_corpus_costs(spark):
    costs = text.word_costs(spark.createDataFrame([("birch bridge tucson birch bridge",)], "t string"), "t")
    df = spark.createDataFrame([("birchbridgetucson.com",)], "business_name string")
    assert names.normalized(df, costs=costs).first().norm_name == "birch bridge tucson"


@pytest.mark.parametrize(("word", "code"), [("johnson", "JNSN"), ("", ""), ("knight", "NT"), ("school", "SKL"), ("Philip", "FLP"), ("electric", "ELKTRK")])
def test_metaphone(word, code):
    assert text.metaphone(word) == code


def test_transliteration():
    assert text.transliterate("Größe élève") == "Grosse eleve"
    assert text.transliterate("plain") == "plain"
    assert text.transliterate("हरियाणा").isascii() and text.transliterate("తెలంగాణ").startswith("t")


def test_accents_beyond_latin(spark):
    df = spark.createDataFrame([("ﬁnance Élan",), ("café",), (None,)], "s string")
    assert [r[0] for r in df.select(text.fold_accents(df.s)).collect()] == ["finance Elan", "cafe", None]
