"""String similarities of record pairs: what Spark has as expressions, the rest as Arrow UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty texts are equal."""
    return F.when(a == b, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def length_difference(a: Column, b: Column) -> Column:
    return F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def equal(a: Column, b: Column) -> Column:
    return (a == b).cast("tinyint")


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda x: x != "")), " ")


def tokens(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(c, r"\s+"), lambda x: x != "")))


def jaro(a: str, b: str) -> float:
    """Jaro similarity: matches within half the longer length, and half the matches out of order."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    hit_a, hit_b, free = [], [], list(b)
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] == c:
                free[j] = None
                hit_a.append(c)
                hit_b.append(j)
                break
    if not hit_a:
        return 0.0
    m = len(hit_a)
    swapped = sum(c != b[j] for c, j in zip(hit_a, sorted(hit_b))) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a common start of up to four letters where it is over 0.7."""
    j = jaro(a, b)
    if j <= 0.7:
        return j
    common = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        common += 1
    return j + common * 0.1 * (1 - j)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit per letter of ``a`` (Hyyro's recurrence)."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 * common subsequence / total length; two empty texts are equal."""
    n = len(a) + len(b)
    return 2 * common_length(a, b) / n if n else 1.0


def token_set_ratio(a: str, b: str) -> float:
    """The best indel ratio of the common words, alone and with either side's others; 1 if one side has no others."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not only_x or not only_y):
        return 1.0
    space = 1 if both else 0
    n, nx, ny = len(both), len(both) + space + len(only_x), len(both) + space + len(only_y)
    common = common_length(only_x, only_y)
    best = 2 * (n + space + common) / (nx + ny) if nx + ny else 0.0
    if both:
        best = max(best, 2 * n / (n + nx), 2 * n / (n + ny))
    return best


def _pairwise(fn) -> object:
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float] = {}
        out = []
        for p in zip(a, b):
            if p not in seen:
                seen[p] = 1.0 if p[0] == p[1] else fn(*p)
            out.append(seen[p])
        return pd.Series(out, dtype="float64")

    return run


_jaro_winkler, _indel, _token_set = _pairwise(jaro_winkler), _pairwise(indel_ratio), _pairwise(token_set_ratio)


def jaro_winkler_similarity(a: Column, b: Column) -> Column:
    return _jaro_winkler(a, b)


def token_sort_similarity(a: Column, b: Column) -> Column:
    """Indel ratio of the sorted words."""
    return F.when(a == b, F.lit(1.0)).otherwise(_indel(sorted_tokens(a), sorted_tokens(b)))


def token_set_similarity(a: Column, b: Column) -> Column:
    return _token_set(a, b)


def string_features(a: Column, b: Column, prefix: str) -> dict[str, Column]:
    """The six features of a pair of texts."""
    return {
        f"feat_{prefix}_levenshtein": levenshtein_similarity(a, b).cast("float"),
        f"feat_{prefix}_jaro_winkler": jaro_winkler_similarity(a, b).cast("float"),
        f"feat_{prefix}_token_sort": token_sort_similarity(a, b).cast("float"),
        f"feat_{prefix}_token_set": token_set_similarity(a, b).cast("float"),
        f"feat_{prefix}_len_diff_ratio": length_difference(a, b).cast("float"),
        f"feat_{prefix}_exact_match": equal(a, b),
    }
