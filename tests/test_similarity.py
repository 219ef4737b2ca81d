import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import similarity as s

TEXT = st.text(alphabet="abcde é", max_size=12)


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT)
def test_bounds_symmetry_and_brute_force(a, b):
    assert s.common_length(a, b) == brute_common(a, b) == s.common_length(b, a)
    for f in (s.jaro_winkler, s.indel_ratio, s.token_set_ratio):
        assert 0 <= f(a, b) <= 1 + 1e-12
    assert s.jaro_winkler(a, a) == s.indel_ratio(a, a) == 1
    assert s.indel_ratio(a, b) == pytest.approx(s.indel_ratio(b, a))


@pytest.mark.parametrize(("a", "b", "want"), [("martha", "marhta", 0.9611111), ("dixon", "dicksonx", 0.8133333), ("", "", 1.0), ("", "a", 0.0)])
def test_jaro_winkler(a, b, want):
    assert s.jaro_winkler(a, b) == pytest.approx(want)


def test_token_ratios():
    assert s.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1.0
    assert s.token_set_ratio("", "a") == 0.0
    assert s.indel_ratio("kitten", "sitting") == pytest.approx(8 / 13)


def test_columns(spark):
    df = spark.createDataFrame([("apple computer", "apple computer"), ("", ""), ("apple inc", "inc apple"), ("abc", "abd")], "a string, b string")
    rows = df.select(*(c.alias(n) for n, c in s.string_features(F.col("a"), F.col("b"), "name").items())).collect()
    assert all(rows[0][k] == 1 for k in ("feat_name_levenshtein", "feat_name_jaro_winkler", "feat_name_token_sort", "feat_name_token_set", "feat_name_exact_match"))
    assert rows[0].feat_name_len_diff_ratio == 0 and rows[1].feat_name_exact_match == 1 and rows[1].feat_name_len_diff_ratio == 0
    assert rows[2].feat_name_token_sort == 1 and rows[2].feat_name_exact_match == 0
    assert rows[3].feat_name_levenshtein == pytest.approx(2 / 3)
