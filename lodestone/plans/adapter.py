"""Business records made from the driver's documents, the same way in both engines.

Every document is a record of one of three sources.  Its last words are the name, with a legal affix by its id;
its address follows a template of its country.  Records whose names start from the same four words are the same
business: the ground truth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.dialect import DUCK, SPARK, Dialect, Program, apply, ctes

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _address(d: Dialect) -> str:
    n, k = "CAST(100 + doc_id % 900 AS VARCHAR(9))", "CAST(1 + doc_id % 20 AS VARCHAR(9))"
    two = "CAST(10 + doc_id % 90 AS VARCHAR(9))"
    forms = {
        ("US", 0): f"concat({n}, ' ', word, ' Rd, Apt ', {k}, ', Iowa City, IA 522', {two})",
        ("US", 1): f"concat('IA, Iowa City, ', {n}, ' ', word, ' Ave, Unit ', {k})",
        ("US", 2): f"concat('##', {n}, ' ', word, ' Lane, Fl. ', {k}, ', Beverly Hills, California 902', {two})",
        ("US", 3): f"concat('P.O. Box ', {n}, ', Ste ', {k}, ', ', word, ', west virginia')",
        ("India", 0): f"concat('Door No ', {n}, ', 41St Cross, ', word, ' Nagar, Bangalore, Karnataka 5600', {two})",
        ("India", 1): f"concat('Plot No ', {n}, ', ', word, ' Road, Near Fortis Hospital, Mumbai, Maharashtra 4000', {two})",
        ("India", 2): f"concat({n}, '/', {k}, ', ', word, ' Colony, Pani Ki Tanki Ke Pas, Jaipur, Rajasthan')",
        ("India", 3): f"concat('H No ', {n}, ', ', word, ' (Next To Iter College), Hyderabad, Telangana, 5000', {two})",
        ("France", 0): f"concat({n}, ' bis Rue ', word, ', Bordeaux, Nouvelle-Aquitaine 330', {two})",
        ("France", 1): f"concat({n}, ' R. DE ', word, ', LILLE, Hauts-de-France 590', {two})",
    }
    cases = [("doc_id % 29 = 0", "NULL"), ("doc_id % 31 = 0", "'nan'")]
    cases += [(f"country = '{c}' AND doc_id % {4 if c != 'France' else 2} = {r}", f) for (c, r), f in forms.items() if c == "France" or c in ("US", "India")]
    return d.cases(cases, f"concat({n}, ' ', word, ' Place, Office No ', {k}, ', ', country, ' 101', {two})")


def _remainders(d: Dialect) -> str:
    # Within a country ids share a parity, so the template follows the id's half.
    return _address(d).replace("doc_id % 4 =", "(doc_id // 2) % 4 =" if d is DUCK else "(doc_id div 2) % 4 =")


ENTITIES: Program = [
    {"words": lambda d: d.filter(d.split(d.replace_all("coalesce(text, '')", "[ßæœøÆŒØ\\x00-\\x08]", "ss"), r"\s+"), "x <> ''")},
    {
        "head": lambda d: d.join(d.cut("words", f"greatest({d.size('words')} - 3, 1)", d.size("words")), " "),
        "word": lambda d: f"coalesce({d.find(d.fold_accents(f'coalesce({d.at("words", f"greatest({d.size(chr(119) + "ords")}, 1)")}, {d.text("Main")})'), '[A-Za-z]{3,}')}, 'Main')",
        "country": lambda d: "CASE WHEN lang = 'en' AND doc_id % 2 = 0 THEN 'US' WHEN lang = 'en' THEN 'India' WHEN lang = 'fr' THEN 'France' WHEN lang = 'de' THEN 'Germany' ELSE 'Spain' END",
        "entity_id": lambda d: "concat('S', CAST(1 + doc_id % 3 AS VARCHAR(9)), '-', CAST(doc_id AS VARCHAR(20)))",
        "src": lambda d: "CAST(1 + doc_id % 3 AS INT)",
    },
    {
        "business_name": lambda d: "CASE doc_id % 9 WHEN 1 THEN concat(head, ' LLC') WHEN 2 THEN concat(head, ' Inc.') WHEN 3 THEN concat(head, ' Pvt. Ltd.') WHEN 4 THEN concat('<< ', head, ' SARL') "
        "WHEN 5 THEN concat(head, ' & Co') WHEN 6 THEN concat('LLC ', head) WHEN 7 THEN concat('Shri ', head, ' MD') WHEN 8 THEN concat('www.', word, '-shop.com | ', head) ELSE head END",
        "business_address": _remainders,
        "truth": lambda d: "lower(head)",
    },
]
ENTITY_COLUMNS = ["entity_id", "src", "country", "business_name", "business_address", "truth", "doc_id"]


#: Characters at a text's end among which its last words are looked for.
TAIL = 256


def ending(text: Column) -> Column:
    """The end of a text where it shows its last four words whole (behind a fifth one), else the text: the records take no more of it."""
    end = F.right(text, F.lit(TAIL))
    return F.when(end.rlike(r"\S\s+\S+\s+\S+\s+\S+\s+\S"), end).otherwise(text)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", ending(F.col("text")).alias("text"), "lang"), ENTITIES).select(*ENTITY_COLUMNS)


ENTITIES_SQL = f"WITH {ctes('SELECT doc_id, text, lang FROM documents', ENTITIES, 'e')} SELECT {', '.join(ENTITY_COLUMNS)} FROM e{len(ENTITIES)}"


def truth_pairs(entities_: DataFrame) -> DataFrame:
    """(source1_entity_id, candidate_entity_id) of records that are the same business."""
    q = entities_.filter("src = 1").select("truth", F.col("entity_id").alias("source1_entity_id"))
    c = entities_.filter("src <> 1").select("truth", F.col("entity_id").alias("candidate_entity_id"))
    return q.join(c, "truth").drop("truth")


TRUTH_SQL = "SELECT q.entity_id AS source1_entity_id, c.entity_id AS candidate_entity_id FROM ent q JOIN ent c ON q.truth = c.truth WHERE q.src = 1 AND c.src <> 1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["DUCK", "ENTITIES_SQL", "SPARK", "TRUTH_SQL", "entities", "table", "truth_pairs"]
