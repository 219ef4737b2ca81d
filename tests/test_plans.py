"""Registered queries against their oracle SQL on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from lodestone.plans import adapter, catalog

DATA = "/root/testdata/sf0.001"
CHECKED = [
    "name_normalize", "addr_dispatch", "street_unit_parse", "honorific_strip", "state_canonical", "gt_explode", "block_token_keys", "block_address_keys", "block_candidates_topk", "tfidf_idf",
    "feat_levenshtein", "feat_jaro_winkler", "feat_street_unit", "sample_stratified", "split_stratified", "avg_precision", "roc_auc", "macro_by_country", "threshold_sweep", "submission_left_join",
    "validate_duplicates", "validate_prefix", "validate_missing_extra", "profile_nulls", "profile_describe", "profile_top_tokens", "profile_patterns", "vector_knn",
    "block_soundex_keys", "threshold_two_stage", "golden_names", "golden_segmentation", "golden_addresses", "golden_street_units", "golden_transliteration", "golden_phonetic_keys",
    "golden_token_keys", "golden_script_keys", "golden_similarities",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([columns[i] for i in order], *([tuple(plain(r[i]) for i in order)] for r in data)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in adapter.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_equals_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    got = rows(df.columns, df.collect())
    want = duck.execute(catalog.oracle_sql()[name])
    assert got == rows([c[0] for c in want.description], want.fetchall())


def test_names_agree():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
