"""Queries over literal rows; their oracle is the literal table of results, so it shares no rule with the engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import addresses, keys, names, records, similarity, text
from lodestone.functions.dialect import DUCK, apply
from lodestone.plans.catalog import query

Row = tuple


def values(columns: str, rows: list[Row]) -> str:
    """DuckDB SQL of literal rows; ``columns``: names with their types."""
    cols = [c.split() for c in columns.split(", ")]
    cell = lambda v: "NULL" if v is None else DUCK.text(v) if isinstance(v, str) else str(v)
    typed = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in cols)
    return f"SELECT {typed} FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({', '.join(n for n, _ in cols)})"


def given(spark, columns: str, rows: list[Row]):
    return spark.createDataFrame(rows, columns)


# (name, norm_name, norm_name_no_legal, legal_type)
NAMES = [
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
    ("Größe & Søn", "große and søn", "große and søn", None),
]


@query("golden_names", values("place INT, norm_name VARCHAR, norm_name_no_legal VARCHAR, legal_type VARCHAR", [(i, *r[1:]) for i, r in enumerate(NAMES)]))
def golden_names(spark, d):
    rows = given(spark, "place int, business_name string, business_address string, country string", [(i, r[0], "", "US") for i, r in enumerate(NAMES)])
    return records.normalized(rows).select("place", "norm_name", "norm_name_no_legal", "legal_type")


# Web names without signs between their words; the words of the other names are the vocabulary.
VOCABULARY = ["Birch Bridge of Tucson", "Iron River Bakery", "The Quick Print Shop", "Bridge Club"]
GLUED = [
    ("birchbridgetucson.com", "birch bridge tucson"),
    ("https://www.ironriverbakery.com/menu", "iron river bakery"),
    ("quickprintshop.net", "quick print shop"),
    ("zzyxw.com", "zzyxw"),
    ("quickzzyxw.org", "quick zzyxw"),
    ("Iron River", "iron river"),
    ("birchbridge.com | Real Name", "real name"),
    (None, ""),
]


@query("golden_segmentation", values("place INT, norm_name VARCHAR", [(i, r[1]) for i, r in enumerate(GLUED)]))
def golden_segmentation(spark, d):
    rows = given(spark, "place int, business_name string, business_address string, country string", [(i, r[0], "", "US") for i, r in enumerate(GLUED)])
    costs = text.word_costs(given(spark, "business_name string", [(v,) for v in VOCABULARY]).unionByName(rows.select("business_name")), "business_name")
    return records.normalized(rows, costs=costs).select("place", "norm_name")


ADDRESS_PARTS = ["norm_address", "addr_street_number", "addr_street_name", "addr_unit", "addr_landmark", "addr_city", "addr_state", "addr_postal_code"]
# (address, country, the parts that are stated)
ADDRESSES = [
    ("100 Main Rd, Apt 4B, 2nd Fl, West Blvd, North Pkwy", "US", {"norm_address": "100 Main road, apartment 4B, 2nd floor, West boulevard, North parkway"}),
    ("P.O. Box 1234, Ste 400", "US", {"norm_address": "po box 1234, suite 400"}),
    ("Mulund Link Road, Near Fortis Hospital, Bhandup West, Mumbai", "India", {"addr_landmark": "Near Fortis Hospital", "norm_address": "Mulund Link Road, Bhandup West, Mumbai"}),
    ("Mahodadhi Bhawan (Next To Iter College) Panchasakha Nagar", "India", {"addr_landmark": "Next To Iter College"}),
    ("Karauli, Rajasthan, Pani Ki Tanki Ke Pas Choubepada", "India", {"addr_landmark": "Pani Ki Tanki Ke Pas"}),
    ("1795 Westchester Drive, High Point, NC", "US", {"addr_street_number": "1795", "addr_street_name": "Westchester Drive", "addr_state": "NC", "addr_city": "High Point"}),
    ("IA, Iowa City, 1064 Newton Rd, Unit 11", "US", {"addr_state": "IA", "addr_city": "Iowa City", "addr_street_number": "1064", "addr_unit": "Unit 11"}),
    ("1 Ivanhoe Ave, PO Box 6009, Cincinnati, Ohio", "US", {"addr_state": "OH", "addr_city": "Cincinnati", "addr_unit": "po box 6009", "addr_street_number": "1"}),
    ("##8 Willow Oak Lane, Fl. 0, Saint Louis, Missouri 63101", "US", {"addr_street_number": "8", "addr_state": "MO", "addr_postal_code": "63101", "addr_unit": "floor 0"}),
    ("2505, Tower 1, Oak, Near Fortis Hospital, Mumbai, Maharashtra 400078", "India", {"addr_street_number": "2505", "addr_state": "Maharashtra", "addr_postal_code": "400078", "addr_landmark": "Near Fortis Hospital"}),
    ("Door No 183, 41St Cross, Jayanagar, Bangalore, Karnataka 560041", "India", {"addr_street_number": "door no 183", "addr_state": "Karnataka", "addr_postal_code": "560041", "addr_street_name": "41St Cross"}),
    ("KH NO. -570/13, NEW DELHI, WEST DELHI, Delhi 110041", "India", {"addr_street_number": "khasra no -570/13", "addr_state": "Delhi", "addr_postal_code": "110041"}),
    ("175 Boulevard du President Franklin Roosevelt, Bordeaux, Nouvelle-Aquitaine 33000", "France", {"addr_street_number": "175", "addr_city": "Bordeaux", "addr_postal_code": "33000", "addr_state": "Nouvelle-Aquitaine"}),
    ("Nouvelle-Aquitaine, La Teste-de-Buch, 5 bis Rue Pierre Dignac 33260", "France", {"addr_street_number": "5 bis", "addr_city": "La Teste-de-Buch", "addr_postal_code": "33260"}),
    ("63 R. DE DIEPPE, LILLE, Hauts-de-France 59000", "France", {"addr_street_number": "63", "addr_street_name": "rue DE DIEPPE", "addr_city": "LILLE", "addr_postal_code": "59000"}),
    (None, "US", {"norm_address": "", "addr_city": "-", "addr_state": "-"}),
    ("", "India", {"norm_address": "", "addr_street_number": "-"}),
    ("nan", "US", {"norm_address": "", "addr_postal_code": "-"}),
]


@query("golden_addresses", values("place INT, part VARCHAR, value VARCHAR", [(i, part, v) for i, (_, _, want) in enumerate(ADDRESSES) for part, v in want.items()]))
def golden_addresses(spark, d):
    """The stated parts of each address; a part that isn't there is a hyphen."""
    rows = given(spark, "place int, business_name string, business_address string, country string", [(i, "", a, c) for i, (a, c, _) in enumerate(ADDRESSES)])
    stated = given(spark, "place int, part string", [(i, part) for i, (_, _, want) in enumerate(ADDRESSES) for part in want])
    found = records.normalized(rows).unpivot("place", ADDRESS_PARTS, "part", "value")
    return stated.join(found, ["place", "part"]).select("place", "part", F.coalesce("value", F.lit("-")).alias("value"))


NUMBERS = [("#1040 Main St, Unit 5b", "1040", "5B"), ("##1047 Oak", "1047", None), ("No #5, Park", "5", None), ("H No 522, Lane", "522", None), ("Office No 407, Plot 45", "45", "407"), ("<missing address>", None, None), (None, None, None)]


@query("golden_street_units", values("place INT, street_number VARCHAR, unit VARCHAR", [(i, *r[1:]) for i, r in enumerate(NUMBERS)]))
def golden_street_units(spark, d):
    rows = given(spark, "place int, a string", [(i, r[0]) for i, r in enumerate(NUMBERS)])
    return apply(rows, addresses.number_program("a", "_n_")).selectExpr("place", "_n_num AS street_number", "_n_unit AS unit")


# (text, its Latin letters)
SCRIPTS = [
    ("Größe élève", "Grosse eleve"), ("москва", "moskva"), ("Жизнь Щука Юлия", "Zhizn Shchuka Iuliia"), ("Ελλάδα", "Ellada"), ("Ψυχή", "Psukhe"), ("שלום", "shlvm"),
    ("محمد", "mhmd"), ("پاکستان", "pakstan"), ("서울", "seoul"), ("한국", "hanguk"), ("ひらがな カタカナ", "hiragana katakana"), ("दिल्ली", "dillii"), ("北京", " u5317  u4eac "), ("plain", "plain"), (None, None),
]


@query("golden_transliteration", values("place INT, latin VARCHAR", [(i, r[1]) for i, r in enumerate(SCRIPTS)]))
def golden_transliteration(spark, d):
    rows = given(spark, "place int, t string", [(i, r[0]) for i, r in enumerate(SCRIPTS)])
    return rows.select("place", text.transliterated(F.col("t")).alias("latin"))


# (name, all its phonetic keys in order)
SOUNDS = [
    ("johnson electric", "META1:JNSN,META2:ELKTRK_JNSN,SND1:J525"),
    ("knight school", "META1:NT,META2:NT_SKL,SND1:K523"),
    ("shri philip", "META1:XR,META2:FLP_XR,PFX_META1:FLP,PFX_SND1:P410,SND1:S600"),
    ("the of", "META2:0_OF,PFX_META1:OF,PFX_SND1:O100,SND1:T000"),
    ("12 34", ""),
    (None, ""),
]


@query("golden_phonetic_keys", values("place INT, keys VARCHAR", [(i, r[1]) for i, r in enumerate(SOUNDS)]))
def golden_phonetic_keys(spark, d):
    rows = given(spark, "place int, n string", [(i, r[0]) for i, r in enumerate(SOUNDS)])
    return keys.phonetic_key_column(rows, "n", least=2).select("place", F.array_join(F.array_sort("phonetic_keys"), ",").alias("keys"))


# (name, all its token keys in order)
TOKENS = [
    ("johnson electric motors", "ACRO:jem,G3:ect,G3:ele,G3:lec,G3:ctr,G4:elec,G4:lect,G4:ectr,LONG:electric,PRE5:johns,PRE6:johnso,TOK1:electric,TOK2:electric_johnson,TOK2_PRE3:ele_joh,TOK:electric,TOK:johnson,TOK:motors"),
    (None, ""),
]


@query("golden_token_keys", values("place INT, keys VARCHAR", [(i, ",".join(sorted(x for x in r[1].split(",") if x))) for i, r in enumerate(TOKENS)]))
def golden_token_keys(spark, d):
    rows = given(spark, "place int, n string", [(i, r[0]) for i, r in enumerate(TOKENS)])
    return keys.token_key_column(rows, "n").select("place", F.array_join(F.array_sort("token_keys"), ",").alias("keys"))


# (name beyond ASCII, the keys of its words in Latin letters)
SCRIPT_TOKENS = [
    ("groß bau", "XLAT_TOK:bau,XLAT_TOK:gross"),
    ("москва банк", "XLAT_TOK:bank,XLAT_TOK:moskva"),
    ("Ελλάδα foods", "XLAT_TOK:ellada,XLAT_TOK:foods"),
    ("서울 빵집", "XLAT_TOK:ppangjip,XLAT_TOK:seoul"),
    ("שלום", "XLAT_TOK:shlvm"),
    ("محمد trading", "XLAT_TOK:mhmd,XLAT_TOK:trading"),
    ("plain name", ""),
]


@query("golden_script_keys", values("place INT, keys VARCHAR", [(i, r[1]) for i, r in enumerate(SCRIPT_TOKENS)]))
def golden_script_keys(spark, d):
    rows = given(spark, "place int, n string", [(i, r[0]) for i, r in enumerate(SCRIPT_TOKENS)])
    own = F.filter("token_keys", lambda k: k.startswith("XLAT_TOK:"))
    return keys.token_key_column(rows, "n").select("place", F.array_join(F.array_sort(own), ",").alias("keys"))


# (left, right, Levenshtein, Jaro-Winkler, token sort, token set), to four places
PAIRS = [
    ("martha", "marhta", 0.6667, 0.9611, 0.8333, 0.8333),
    ("dixon", "dicksonx", 0.5, 0.8133, 0.6154, 0.6154),
    ("kitten", "sitting", 0.5714, 0.746, 0.6154, 0.6154),
    ("apple inc", "inc apple", 0.1111, 0.3148, 1.0, 1.0),
    ("fuzzy was a bear", "fuzzy fuzzy was a bear", 0.7273, 0.908, 0.8421, 1.0),
    ("", "a", 0.0, 0.0, 0.0, 0.0),
    ("same text", "same text", 1.0, 1.0, 1.0, 1.0),
]


@query("golden_similarities", values("place INT, levenshtein DOUBLE, jaro_winkler DOUBLE, token_sort DOUBLE, token_set DOUBLE", [(i, *r[2:]) for i, r in enumerate(PAIRS)]))
def golden_similarities(spark, d):
    rows = given(spark, "place int, l string, r string", [(i, *r[:2]) for i, r in enumerate(PAIRS)])
    a, b = F.col("l"), F.col("r")
    kinds = {"levenshtein": similarity.levenshtein_similarity, "jaro_winkler": similarity.jaro_winkler_similarity, "token_sort": similarity.token_sort_similarity, "token_set": similarity.token_set_similarity}
    return rows.select("place", *(F.round(f(a, b).cast("double"), 4).alias(n) for n, f in kinds.items()))
