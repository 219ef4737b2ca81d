"""Queries on single records: scans, names, addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import addresses, keys, names
from lodestone.functions.dialect import DUCK, Program, apply, ctes
from lodestone.plans.adapter import ENTITIES_SQL, entities, table
from lodestone.plans.catalog import query
from lodestone.sources import readers
from lodestone.sources.staging import staged

NAMES, ADDRESSES = names.program(), addresses.program()
NORMALIZED: Program = [*NAMES, *ADDRESSES]


def over_entities(program: Program, select: str) -> str:
    """DuckDB SQL of a program over the records."""
    return f"WITH {ctes(ENTITIES_SQL, program, 's')} SELECT {select} FROM s{len(program)}"


def normalized(spark, d: str) -> DataFrame:
    """The records with all outputs of both normalisers."""
    df = entities(spark, d)
    own = df.columns
    return apply(df, NORMALIZED).select(*own, *names.OUTPUTS, *addresses.OUTPUTS)


def stored(spark, d: str, *columns: str) -> DataFrame:
    """``normalized``, or some columns of it, staged: what blocking and features start from.  Steps that no column needs are left out."""
    df = normalized(spark, d)
    return staged(df.select(*columns) if columns else df)


NORMALIZED_SQL = over_entities(NORMALIZED, ", ".join(["entity_id", "src", "country", "business_name", "business_address", "truth", "doc_id", *names.OUTPUTS, *addresses.OUTPUTS]))


def step(name: str, program: Program, **cols: str) -> None:
    """Registers a query that shows columns after some steps of a program."""
    shown = ", ".join(f"{x} AS {c}" for c, x in cols.items())
    spark_cols = [f"{x.replace('array_to_string', 'array_join')} AS {c}" for c, x in cols.items()]
    query(name, over_entities(program, f"entity_id, {shown}"))(lambda spark, d: apply(entities(spark, d), program).selectExpr("entity_id", *spark_cols))


def until(program: Program, column: str) -> Program:
    """The steps up to the one that makes a column."""
    return program[: 1 + next(i for i, layer in enumerate(program) if column in layer)]


step("name_clean", until(NAMES, "_clean"), clean_name="_clean")
step("name_domain", until(NAMES, "_named"), without_domain_parts="_parts", domain_words="_domain", named="_named")
step("name_ocr_fix", until(NAMES, "_ocr"), corrected="_ocr")
step("name_credentials", until(NAMES, "credential"), credential="credential", bare_name="_bare")
step("name_leading_affix", until(NAMES, "_front"), after_affix="_affix", affix_legal="_legal0", after_legal="_front", leading_legal="_legal1")
step("name_trade_symbols", until(NAMES, "_trade"), trade_name="_trade")
step("name_legal_form", until(NAMES, "_core"), core_name="_core", found_legal="_legal2")
step("name_normalize", NAMES, norm_name="norm_name", norm_name_no_legal="norm_name_no_legal", legal_type="legal_type", credential="credential", tokens="array_to_string(name_tokens, ' ')")
step("addr_clean", until(ADDRESSES, "_aclean"), clean_address="_aclean")
step("addr_expand", until(ADDRESSES, "_along"), long_address="_along")
step("addr_landmark", until(ADDRESSES, "addr_landmark"), landmark="addr_landmark", without_landmark="_aplain")
step("addr_unit", until(ADDRESSES, "_awork"), unit="addr_unit", without_unit="_awork")
step("addr_tokens", ADDRESSES, tokens="array_to_string(addr_tokens, ' ')")
for _kind in ("us", "india", "other"):
    _p = f"_a{_kind}_"
    step({"us": "addr_us", "india": "addr_india", "other": "addr_generic"}[_kind], ADDRESSES, number=f"{_p}number", street=f"{_p}street", city=f"{_p}city", state=f"{_p}state", postal=f"{_p}post")
step("addr_dispatch", ADDRESSES, kind="_akind", norm_address="norm_address", street_number="addr_street_number", street_name="addr_street_name", unit="addr_unit", landmark="addr_landmark", city="addr_city", state="addr_state", postal_code="addr_postal_code")

_NUMBERS = addresses.number_program("business_address", "_n_")
step("street_unit_parse", _NUMBERS, street_number="_n_num", street_value="CAST(_n_n AS DOUBLE)", unit="_n_unit")
step("state_canonical", [*until(ADDRESSES, "addr_state"), {"_st": lambda d: keys.canonical_state(d, "addr_state", "country")}], canonical_state="_st")
step("honorific_strip", [*NAMES, {"_h": lambda d: keys.without_honorifics(d, "business_name")}], stripped="_h")


@query("src_scan_cast", "SELECT CAST(c_custkey AS VARCHAR) AS entity_id, c_name AS business_name, CAST(c_nationkey AS VARCHAR) AS country, coalesce(c_mktsegment, '') AS segment FROM customer")
def src_scan_cast(spark, d):
    t = table(spark, d, "customer")
    return t.select(F.col("c_custkey").cast("string").alias("entity_id"), F.col("c_name").alias("business_name"), F.col("c_nationkey").cast("string").alias("country"), F.coalesce("c_mktsegment", F.lit("")).alias("segment"))


@query("src_union_corpus", f"SELECT entity_id, country, business_name FROM ({ENTITIES_SQL}) WHERE src <> 1")
def src_union_corpus(spark, d):
    e = entities(spark, d)
    part = lambda n: e.filter(F.col("src") == n).select("entity_id", "country", "business_name")
    return readers.corpus(part(2), part(3))


@query("src_id_prefix", f"SELECT regexp_extract(entity_id, '^([A-Za-z0-9]+-)', 1) AS prefix, count(*) AS n FROM ({ENTITIES_SQL}) GROUP BY 1")
def src_id_prefix(spark, d):
    from lodestone.operators import profile

    return profile.prefixes(entities(spark, d))


TRUTH_ROWS_SQL = (
    f"WITH ent AS MATERIALIZED ({ENTITIES_SQL}) SELECT q.entity_id AS source1_entity_id, "
    "coalesce(string_agg(c.entity_id, ',' ORDER BY c.entity_id), '') AS matched_entity_ids FROM ent q LEFT JOIN ent c ON q.truth = c.truth AND c.src <> 1 WHERE q.src = 1 GROUP BY 1"
)


def truth_rows(spark, d: str) -> DataFrame:
    """The ground truth as rows of comma separated lists."""
    e = entities(spark, d)
    lists = e.filter("src <> 1").groupBy("truth").agg(F.array_join(F.sort_array(F.collect_list("entity_id")), ",").alias("matched_entity_ids"))
    q = e.filter("src = 1").select("truth", F.col("entity_id").alias("source1_entity_id"))
    return q.join(lists, "truth", "left").select("source1_entity_id", F.coalesce("matched_entity_ids", F.lit("")).alias("matched_entity_ids"))


@query("gt_lists", TRUTH_ROWS_SQL)
def gt_lists(spark, d):
    return truth_rows(spark, d)


@query("gt_explode", f"SELECT source1_entity_id, unnest(list_distinct(list_filter(string_split(matched_entity_ids, ','), lambda x: trim(x) <> ''))) AS candidate_entity_id FROM ({TRUTH_ROWS_SQL})")
def gt_explode(spark, d):
    return readers.truth_pairs(readers.truth_lists(truth_rows(spark, d)))


@query("process_all", f"SELECT {', '.join(['entity_id', 'country', 'business_name', 'business_address', 'norm_name', 'norm_name_no_legal', 'legal_type', 'credential', 'norm_address', 'addr_street_number', 'addr_street_name', 'addr_unit', 'addr_landmark', 'addr_city', 'addr_state', 'addr_postal_code'])} FROM ({NORMALIZED_SQL})")
def process_all(spark, d):
    from lodestone.sources.writers import NORMALIZED as columns

    return normalized(spark, d).select(*columns)


__all__ = ["DUCK", "NORMALIZED_SQL", "normalized", "over_entities", "stored"]
