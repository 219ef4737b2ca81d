"""Multi-strategy blocking: key tables, candidate scores, blocking quality.

The index is a table of (country, strategy, key, entity_id).  Keys of more than ``max_block_size`` entries are
dropped by a count per key and an anti join, before any pair is made; pairs are scored by blocks of queries
(``candidates``), and by one equi-join and a sum where TF-IDF neighbours add to the scores.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import keys
from lodestone.functions.dialect import SPARK
from lodestone.operators import candidates, tfidf
from lodestone.sources.staging import staged


@dataclass(frozen=True)
class BlockingConfig:
    """What takes part in blocking, and its limits."""

    enable_tfidf: bool = True
    top_k_tfidf: int = 20
    min_tfidf_sim: float = 0.20
    tfidf_ngram: int = 3
    tfidf_max_features: int = 40_000
    knn_engine: str = "exact"  # or "dense": a projection to ``dense_dim`` dimensions
    dense_dim: int = 128
    enable_token_overlap: bool = True
    min_token_len: int = 3
    enable_phonetic: bool = True
    min_phonetic_len: int = 3
    enable_address: bool = True
    max_block_size: int = 1200
    max_candidates_per_query: int = 200
    country_partition: bool = True

    @classmethod
    def production(cls, max_candidates: int = 25) -> BlockingConfig:
        """Without TF-IDF, and with few candidates."""
        return cls(enable_tfidf=False, max_candidates_per_query=max_candidates)


WEIGHTS = {"token": keys.TOKEN_WEIGHTS, "phonetic": keys.PHONETIC_WEIGHTS, "address": keys.ADDRESS_WEIGHTS}
KEY = ["country", "strategy", "key"]
#: What a near neighbour by TF-IDF adds to a pair's score.
TFIDF_WEIGHT = 3
#: The most large keys that are broadcast.
SENT_KEYS = 20_000


def inputs(config: BlockingConfig) -> list[str]:
    """The columns of normalised entities that blocking reads."""
    address = ["business_address", "addr_street_number", "addr_street_name", "addr_city", "addr_state", "addr_postal_code"]
    return ["entity_id", "country", "norm_name_no_legal", *(["norm_name"] if config.enable_tfidf else []), *(address if config.enable_address else [])]


def key_rows(df: DataFrame, config: BlockingConfig) -> DataFrame:
    """(country, strategy, key, weight, entity_id), a row per key of each normalised entity."""
    kinds = []
    df = keys.prepared(df.select(*inputs(config)), "norm_name_no_legal", config.enable_address)
    if config.enable_token_overlap:
        df, kinds = keys.token_key_column(df, "norm_name_no_legal", "_token", config.min_token_len), [*kinds, "token"]
    if config.enable_phonetic:
        df, kinds = keys.phonetic_key_column(df, "norm_name_no_legal", "_phonetic", config.min_phonetic_len), [*kinds, "phonetic"]
    if config.enable_address:
        df, kinds = keys.address_key_column(df, "_address"), [*kinds, "address"]
    none = F.array().cast("array<string>")

    def tag(kind: str):
        return F.transform(F.coalesce(f"_{kind}", none), lambda x: F.struct(F.lit(kind).alias("strategy"), x.alias("key")))

    tagged = [tag(k) for k in kinds]
    country = F.col("country") if config.country_partition else F.lit("ALL")
    # An inner explode would let the optimiser push a filter on the array below the layers that make it, writing all of them out again.
    rows = df.select("entity_id", country.alias("country"), F.explode_outer(F.concat(*tagged)).alias("k")).filter("k is not null").select("entity_id", "country", "k.strategy", "k.key")
    weight = F.expr("CASE strategy " + " ".join(f"WHEN '{k}' THEN {keys.weight(SPARK, 'key', WEIGHTS[k])}" for k in kinds) + " END")
    return rows.select(*KEY, weight.alias("weight"), "entity_id")


def without_large_blocks(index: DataFrame, most: int) -> DataFrame:
    """Rows of keys that at most ``most`` index rows have; the large keys alone are counted out and joined back."""
    large = staged(index.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(*KEY))
    # Few keys are sent to the rows, so that only those that stay are dealt out.
    return index.join(F.broadcast(large) if large.limit(SENT_KEYS + 1).count() <= SENT_KEYS else large, KEY, "left_anti")


def scored(query_keys: DataFrame, index: DataFrame) -> DataFrame:
    """(source1_entity_id, candidate_entity_id, score): the sum of the weights of shared keys, as often as they are shared."""
    q = query_keys.select(*KEY, "weight", F.col("entity_id").alias("source1_entity_id"))
    c = index.select(*KEY, F.col("entity_id").alias("candidate_entity_id"))
    return q.join(c, KEY).groupBy("source1_entity_id", "candidate_entity_id").agg(F.sum("weight").cast("long").alias("score"))


def top_candidates(pairs: DataFrame, most: int) -> DataFrame:
    """The ``most`` best candidates of each query by score, ties by id, with their ``rank``."""
    w = Window.partitionBy("source1_entity_id").orderBy(F.desc("score"), "candidate_entity_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


@dataclass
class MultiStrategyBlocker:
    """Candidates of query entities among corpus entities (both normalised)."""

    config: BlockingConfig = field(default_factory=BlockingConfig)
    index: DataFrame | None = None
    corpus: DataFrame | None = None

    def fit(self, corpus: DataFrame) -> MultiStrategyBlocker:
        """Indexes the corpus; its key table is staged, as it is counted, filtered and joined."""
        keys_ = staged(key_rows(corpus, self.config))
        return replace(self, corpus=corpus, index=without_large_blocks(keys_, self.config.max_block_size))

    def _check(self) -> None:
        if self.index is None:
            raise RuntimeError("fit() comes before block_queries()")

    def scores(self, queries: DataFrame) -> DataFrame:
        """All scored pairs, before the cap."""
        self._check()
        parts = scored(key_rows(queries, self.config), self.index)
        if self.config.enable_tfidf:
            near = tfidf.nearest(queries, self.corpus, "norm_name", self.config)
            bonus = near.select("source1_entity_id", "candidate_entity_id", F.lit(TFIDF_WEIGHT).cast("long").alias("score"))
            parts = parts.unionByName(bonus).groupBy("source1_entity_id", "candidate_entity_id").agg(F.sum("score").alias("score"))
        return parts

    def _rows(self, queries: DataFrame, left: DataFrame | None = None, right: DataFrame | None = None) -> DataFrame:
        self._check()
        # All rows of an id go to one block, by the least of its names.
        near = queries.groupBy("entity_id").agg(F.min(F.struct("country", "norm_name_no_legal")).alias("at")).select("entity_id", "at.country", "at.norm_name_no_legal")
        return candidates.rows(key_rows(queries, self.config), near, self.index, KEY, left, right)

    def block_pairs(self, queries: DataFrame) -> DataFrame:
        """(source1_entity_id, candidate_entity_id, score, rank)."""
        most = self.config.max_candidates_per_query
        if self.config.enable_tfidf:
            return top_candidates(self.scores(queries), most)
        return candidates.top(self._rows(queries), most, False, []).select("source1_entity_id", "candidate_entity_id", "score", "rank")

    def sided_pairs(self, queries: DataFrame, left: DataFrame, right: DataFrame, measure=None, shown: tuple[str, ...] = ()) -> DataFrame:
        """``block_pairs`` with the looked-up columns of both sides (l_, r_), a row for each pair of looked-up rows.

        ``left``, ``right``: entity_id and the same columns; of a column ``truth`` only ``label`` is shown, whether any rows of the pair agree on it.
        With ``measure`` (see ``candidates.top``), its columns instead of the looked-up ones but those ``shown``.
        """
        if self.config.enable_tfidf:
            raise ValueError("sided_pairs() is for blocking by keys alone")
        extra = list(shown) if measure else [c for c in left.columns if c not in ("entity_id", "truth")]
        return candidates.top(self._rows(queries, left, right), self.config.max_candidates_per_query, "truth" in left.columns, extra, measure)

    def block_queries(self, queries: DataFrame) -> DataFrame:
        """Every query with its ordered list of candidates, which may be empty."""
        return candidate_lists(queries.select(F.col("entity_id").alias("source1_entity_id")), self.block_pairs(queries))


def candidate_lists(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source1_entity_id, candidates): the ordered list of each id, empty without pairs."""
    lists = pairs.groupBy("source1_entity_id").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate_entity_id"))).alias("l"))
    empty = F.array().cast("array<string>")
    return ids.join(lists, "source1_entity_id", "left").select("source1_entity_id", F.coalesce(F.transform("l", lambda x: x["candidate_entity_id"]), empty).alias("candidates"))


def quality(queries: DataFrame, pairs: DataFrame, truth: DataFrame, corpus: DataFrame, by: str = "country") -> DataFrame:
    """A row for each value of ``by`` and one (null) for all: recalls and reduction, in per cent.

    ``queries`` and ``corpus``: (entity_id, by); ``pairs`` and ``truth``: (source1_entity_id, candidate_entity_id).
    """
    pair = ["source1_entity_id", "candidate_entity_id"]
    hits = truth.select(*pair).distinct().join(pairs.select(*pair).distinct().withColumn("hit", F.lit(1)), pair, "left")
    per_query = hits.groupBy("source1_entity_id").agg(F.count(F.lit(1)).alias("t"), F.count("hit").alias("h"))
    sizes = pairs.groupBy("source1_entity_id").agg(F.countDistinct("candidate_entity_id").alias("c"))
    return _quality(queries, per_query, sizes, corpus, by)


def judged_quality(queries: DataFrame, pairs: DataFrame, totals: DataFrame, corpus: DataFrame, by: str = "country") -> DataFrame:
    """``quality`` of ``pairs`` that are listed once, with ``label``; ``totals``: (source1_entity_id, t), the true pairs of each query."""
    sizes = pairs.groupBy("source1_entity_id").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("label").cast("long")).alias("h"))
    return _quality(queries, totals, sizes, corpus, by)


def _quality(queries: DataFrame, per_query: DataFrame, sizes: DataFrame, corpus: DataFrame, by: str) -> DataFrame:
    q = queries.select(F.col("entity_id").alias("source1_entity_id"), by)
    joined = q.join(per_query, "source1_entity_id", "left").join(sizes, "source1_entity_id", "left").fillna(0, ["t", "h", "c"])
    counts = corpus.rollup(by).agg(F.count(F.lit(1)).alias("n_corpus"))
    m = joined.rollup(by).agg(
        F.count(F.lit(1)).alias("n_queries"), F.sum("t").alias("true_pairs"), F.sum("h").alias("recalled_pairs"), F.sum("c").alias("candidate_pairs"),
        F.count_if(F.col("t") > 0).alias("matched_queries"), F.count_if(F.col("t") == 0).alias("singleton_queries"), F.count_if(F.col("h") > 0).alias("recalled_queries"),
    )
    pct = lambda a, b: F.when(b > 0, 100.0 * a / b).otherwise(F.lit(0.0))
    out = m.join(counts, m[by].eqNullSafe(counts[by]), "left").drop(counts[by])
    return out.select(
        by, "n_queries", "matched_queries", "singleton_queries", "true_pairs", "recalled_pairs", "candidate_pairs",
        pct(F.col("recalled_pairs"), F.col("true_pairs")).alias("pair_recall"), pct(F.col("recalled_queries"), F.col("matched_queries")).alias("entity_recall"),
        (F.col("candidate_pairs") / F.col("n_queries")).alias("avg_candidates"), (100.0 * (1 - F.col("candidate_pairs") / (F.col("n_queries") * F.col("n_corpus")))).alias("reduction_ratio"),
    )


def ceiling(pair_recall: float) -> float:
    """The best F0.5 that an ideal ranker reaches at a recall (0 to 1)."""
    return 1.25 * pair_recall / (0.25 + pair_recall) if pair_recall else 0.0


def ablation(blocker: MultiStrategyBlocker, queries: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """(strategy, candidate_pairs, recalled_pairs) of each strategy alone and of all together.

    ``truth``: pairs; without it, queries and corpus have a column ``truth`` whose equal values are true pairs.
    """
    blocker._check()
    if truth is None:
        return candidates.by_strategy(blocker._rows(queries, *(x.select("entity_id", "truth") for x in (queries, blocker.corpus))))
    q = key_rows(queries, blocker.config).select(*KEY, F.col("entity_id").alias("source1_entity_id"))
    c = blocker.index.select(*KEY, F.col("entity_id").alias("candidate_entity_id"))
    pair = ["source1_entity_id", "candidate_entity_id"]
    per = q.join(c, KEY).select("strategy", *pair).distinct()
    every = per.unionByName(per.select(F.lit("union").alias("strategy"), *pair).distinct())
    hit = truth.select(*pair).distinct().withColumn("hit", F.lit(1))
    return every.join(hit, pair, "left").groupBy("strategy").agg(F.count(F.lit(1)).alias("candidate_pairs"), F.count("hit").alias("recalled_pairs"))
