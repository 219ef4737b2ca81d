"""The feature matrix of candidate pairs."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import addresses, pairwise, similarity
from lodestone.functions.dialect import apply
from lodestone.operators import tfidf

PAIR = ["source1_entity_id", "candidate_entity_id"]
#: The columns of the matrix, in order.
FEATURES = [
    "feat_name_levenshtein", "feat_name_jaro_winkler", "feat_name_token_sort", "feat_name_token_set",
    "feat_addr_levenshtein", "feat_addr_jaro_winkler", "feat_addr_token_sort", "feat_addr_token_set",
    "feat_name_tfidf_cosine", "feat_country_match", "feat_name_len_diff_ratio", "feat_addr_len_diff_ratio",
    "feat_name_exact_match", "feat_addr_exact_match", "exact_street_number_match", "street_number_numeric_distance", "unit_number_match",
]


def lookup(entities: DataFrame, name: str = "norm_name", address: str = "business_address", country: str = "country") -> DataFrame:
    """(entity_id, name, address, country) of entities, missing texts empty; addresses as they were given."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return entities.select("entity_id", text(name).alias("name"), text(address).alias("address"), text(country).alias("country"))


def with_sides(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` with the looked-up texts of both sides; ids unknown to a side get empty texts."""
    side = lambda x, id_, p: x.select(F.col("entity_id").alias(id_), *(F.col(c).alias(f"{p}_{c}") for c in x.columns if c != "entity_id"))
    out = pairs.join(side(left, PAIR[0], "l"), PAIR[0], "left").join(side(right, PAIR[1], "r"), PAIR[1], "left")
    return out.fillna("", [f"{p}_{c}" for p in "lr" for c in ("name", "address", "country")])


def numbers(entities: DataFrame) -> DataFrame:
    """A lookup with its addresses' street numbers and units, parsed once per distinct address."""
    distinct = apply(entities.select("address").distinct(), addresses.number_program("address", "_n_")).select("address", F.col("_n_num").alias("num"), F.col("_n_n").alias("n"), F.col("_n_unit").alias("unit"))
    return entities.join(distinct, "address")


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """``pairs`` with ``label``: whether the pair is true."""
    true = truth.select(*PAIR).distinct().withColumn("_true", F.lit(1))
    return pairs.join(true, PAIR, "left").withColumn("label", F.coalesce("_true", F.lit(0)).cast("tinyint")).drop("_true")


@dataclass
class FeatureExtractor:
    """Fitted by the idf of character trigrams of names."""

    max_features: int = 40_000
    ngram: int = 3
    idf: DataFrame | None = None

    def fit(self, names: DataFrame, col: str = "norm_name") -> FeatureExtractor:
        """``names``: a row a name; nulls are left out."""
        # Nulls have no gram.  Filtering a computed name would have the optimiser write its whole rule program out below it.
        counts = tfidf.gram_counts(names.select(F.monotonically_increasing_id().alias("id"), F.col(col).alias("t")), "id", "t", self.ngram)
        n = names.agg(F.count(col)).first()[0]
        return replace(self, idf=tfidf.idf(counts, n, max_features=self.max_features))

    def matrix(self, pairs: DataFrame, left: DataFrame, right: DataFrame, truth: DataFrame | None = None) -> DataFrame:
        """``PAIR``, ``FEATURES`` and, with ``truth``, ``label``; ``left`` and ``right`` are lookups."""
        if self.idf is None:
            raise RuntimeError("fit() comes before matrix()")
        cosine = tfidf.cosine(self.idf, self.ngram, self.max_features)
        pairs = pairs.select(*PAIR)
        own = lambda x, ids: x.join(ids.distinct(), "entity_id", "left_semi")
        left = own(left, pairs.select(F.col(PAIR[0]).alias("entity_id")))
        right = own(right, pairs.select(F.col(PAIR[1]).alias("entity_id")))
        left, right = self.sides(left), self.sides(right)
        out = self.of_sides(with_sides(pairs, left, right), cosine)
        return out if truth is None else label(out, truth)

    def sides(self, entities: DataFrame) -> DataFrame:
        """A lookup with all that ``of_sides`` reads."""
        return numbers(entities).join(tfidf.texts(entities, "entity_id", "name"), "entity_id")

    def of_sides(self, full: DataFrame, cosine=None) -> DataFrame:
        """``PAIR``, ``FEATURES`` and other columns of rows that hold both ``sides`` (l_, r_)."""
        cosine = cosine or tfidf.cosine(self.idf, self.ngram, self.max_features)
        a, b = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))
        parts = {
            **similarity.string_features(a("name"), b("name"), "name"),
            **similarity.string_features(a("address"), b("address"), "addr"),
            "feat_name_tfidf_cosine": cosine(F.col("l_text"), F.col("r_text")).cast("float"),
            "feat_country_match": similarity.equal(a("country"), b("country")),
            **{c: F.expr(x) for c, x in addresses.number_features("l_", "r_").items()},
        }
        rest = [c for c in full.columns if c not in PAIR and not c.startswith(("l_", "r_"))]
        return full.select(*PAIR, *(parts[c].alias(c) for c in FEATURES), *rest)


    def in_blocks(self, blocker, queries: DataFrame, left: DataFrame, right: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
        """``of_sides`` of a blocker's pairs, computed where the pairs are found; ``left`` and ``right``: ``sides``, and ``truth`` for ``label``.

        ``own``: columns of ``left`` to be shown, for which ``right`` has nulls.
        """
        left, right = (x.withColumn("text", F.lower(F.trim("text"))) for x in (left, right))
        full = blocker.sided_pairs(queries, left, right, self._measure(), ("num", "n", "unit", *own))
        parts = {c: F.expr(x) for c, x in addresses.number_features("l_", "r_").items()}
        rest = [c for c in full.columns if c not in (*PAIR, *FEATURES) and not c.startswith(("l_", "r_"))]
        return full.select(*PAIR, *(parts.get(c, F.col(c)).alias(c) for c in FEATURES), *rest, *(F.col(f"l_{c}").alias(c) for c in own))

    def _measure(self):
        cosine = tfidf.known_cosine(self.idf, self.ngram)
        kinds = {"levenshtein": "float", "jaro_winkler": "float", "token_sort": "float", "token_set": "float", "len_diff_ratio": "float", "exact_match": "tinyint"}
        fields = [f"feat_{p}_{k} {t}" for p in ("name", "addr") for k, t in kinds.items()] + ["feat_name_tfidf_cosine float", "feat_country_match tinyint"]

        def measure(left, right):
            cosines = cosine(left, right)
            texts = {c: (*tfidf.numbered(left[c]), *tfidf.numbered(right[c])) for c in ("name", "address", "country")}
            of = [pairwise.similarities(l, at, r, r_at) for at, l, r_at, r in (texts["name"], texts["address"])]
            at, l, r_at, r = texts["country"]
            twin = np.array([l.index(x) if x in l else -1 for x in r], np.int64)
            return lambda p, q: [*of[0](p, q), *of[1](p, q), cosines(p, q).astype(np.float32), (twin[r_at[q]] == at[p]).astype(np.int8)]

        return ", ".join(fields), measure


def summary(matrix: DataFrame) -> DataFrame:
    """Pairs, positives, negatives, share of positives in per cent and negatives per positive."""
    m = matrix.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)).alias("positives"))
    neg = F.col("pairs") - F.col("positives")
    return m.select("pairs", "positives", neg.alias("negatives"), F.when(F.col("pairs") > 0, 100.0 * F.col("positives") / F.col("pairs")).alias("positive_pct"), F.when(F.col("positives") > 0, neg / F.col("positives")).alias("imbalance"))
