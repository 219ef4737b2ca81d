"""Character n-gram TF-IDF as tables of (id, gram, weight): idf, vocabulary, cosines, nearest neighbours.

Words are padded with a space on either side and n-grams don't cross words; idf is ln((1 + N) / (1 + df)) + 1 and
vectors have length 1.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.sources.staging import staged

#: What Spark's split takes as space.
SPACE = re.compile(r"\s+", re.ASCII)
#: Query texts that meet a country's corpus in one task.
QUERY_BLOCK = 2048
#: The largest vocabulary that is broadcast.
SENT_GRAMS = 200_000


def gram_counts(df: DataFrame, id_col: str, text_col: str, n: int = 3) -> DataFrame:
    """(id, gram, tf)."""
    words = df.select(F.col(id_col).alias("id"), F.explode_outer(F.split(F.lower(F.trim(F.coalesce(text_col, F.lit("")))), r"\s+")).alias("w")).filter("w <> ''")
    padded = words.withColumn("w", F.concat(F.lit(" "), "w", F.lit(" ")))
    grams = padded.select("id", F.explode_outer(F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - n + 1, F.lit(1))), lambda i: F.col("w").substr(i, F.lit(n)))).alias("gram"))
    return grams.groupBy("id", "gram").agg(F.count(F.lit(1)).alias("tf"))


def idf(counts: DataFrame, n_docs: int, *, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """(gram, df, idf) of grams in at least ``min_df`` texts, at most ``max_features`` of the largest total count."""
    table = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    if max_features is not None:
        table = table.orderBy(F.desc("total"), "gram").limit(max_features)
    return table.select("gram", "df", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))


def weights(counts: DataFrame, idf_table: DataFrame) -> DataFrame:
    """(id, gram, weight), of length 1 per id."""
    raw = counts.join(idf_table.select("gram", "idf"), "gram").select("id", "gram", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "gram", (F.col("w") / F.col("norm")).alias("weight"))


def pair_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame, out: str = "cosine") -> DataFrame:
    """``pairs`` (source1_entity_id, candidate_entity_id) with the cosine of their vectors, 0 without a common gram."""
    pair = ["source1_entity_id", "candidate_entity_id"]
    a = left.select(F.col("id").alias("source1_entity_id"), "gram", F.col("weight").alias("wa"))
    b = right.select(F.col("id").alias("candidate_entity_id"), "gram", F.col("weight").alias("wb"))
    dots = pairs.select(*pair).distinct().join(a, "source1_entity_id").join(b, ["candidate_entity_id", "gram"]).groupBy(*pair).agg(F.sum(F.col("wa") * F.col("wb")).alias(out))
    return pairs.join(dots, pair, "left").withColumn(out, F.least(F.greatest(F.coalesce(out, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(entity_id, text): all texts of an id as one, with the grams of all."""
    return df.groupBy(F.col(id_col).alias("entity_id")).agg(F.array_join(F.collect_list(text_col), " ").alias("text"))


def grams(text_: str, place: dict[str, int], n: int) -> dict[int, int]:
    """How often a text has each gram that has a place; the text is lower-case and trimmed."""
    count: dict[int, int] = {}
    for w in SPACE.split(text_):
        if w:
            w = f" {w} "
            for i in range(max(len(w) - n + 1, 1)):
                if (k := place.get(w[i : i + n])) is not None:
                    count[k] = count.get(k, 0) + 1
    return count


def distinct_grams(text_col: str, n: int = 3) -> Column:
    """The grams of a lower-case text, each once, in the order in which they first come."""
    words = F.filter(F.split(text_col, r"\s+"), lambda w: w != "")
    own = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: w.substr(i, F.lit(n)))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: own(F.concat(F.lit(" "), w, F.lit(" "))))))


def block_cosine(texts_: DataFrame, n_docs: int, n: int = 3, most: int | None = None) -> tuple[DataFrame, Callable]:
    """Lookups and the measure that ``candidates.top`` needs for cosines, 0 without a common gram; idf over all of ``texts_``.

    ``texts_``: (entity_id, text), an id once, lower-case.  Up to ``most`` grams are broadcast with their numbers of texts;
    of a larger vocabulary each text carries the numbers of its own grams.  Either way no row is made for a gram of a pair.
    """
    most = SENT_GRAMS if most is None else most
    table = texts_.select(F.explode_outer(distinct_grams("text", n)).alias("gram")).filter("gram is not null").groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rows = table.limit(most + 1).toArrow()
    sent = None
    if len(rows) <= most:
        sent = texts_.sparkSession.sparkContext.broadcast((rows["gram"].to_pylist(), rows["df"].to_numpy()))
    else:
        each = texts_.select("entity_id", F.posexplode_outer(distinct_grams("text", n)).alias("at", "gram")).join(table, "gram")
        own = each.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "df"))), lambda x: x["df"]).alias("dfs"))
        texts_ = staged(texts_.join(own, "entity_id", "left"))
    place: dict[str, int] = {}

    def measure(left: pa.Table, right: pa.Table):
        if sent is not None and not place:
            place.update((g, i) for i, g in enumerate(sent.value[0]))
        numbers = _Numbers() if sent is None else place
        weight = lambda df: np.log((1.0 + n_docs) / (1.0 + df)) + 1

        def vectors(side: pa.Table) -> tuple[np.ndarray, _Vectors]:
            code = pa.chunked_array(side["text"].chunks, pa.string()).combine_chunks().dictionary_encode()
            at = code.indices.to_numpy()
            if sent is not None:
                return at, _Vectors(code.dictionary.to_pylist(), numbers, weight(sent.value[1]), n)
            first = np.unique(at, return_index=True)[1]
            dfs = side["dfs"].combine_chunks().take(pa.array(first)).flatten().to_numpy()
            return at, _Vectors(code.dictionary.to_pylist(), numbers, weight(dfs), n, own=True)

        (l_at, l), (r_at, r) = vectors(left), vectors(right)
        return _cosines(l_at, l, r_at, r, len(numbers))

    return texts_, measure


def _cosines(l_at: np.ndarray, l: _Vectors, r_at: np.ndarray, r: _Vectors, vocabulary: int):
    """A function of row numbers of both sides to the cosines of their texts (numbered by ``l_at`` and ``r_at``)."""
    row = np.zeros(vocabulary)
    l_start, r_start = (np.cumsum(x.size) - x.size for x in (l, r))

    def values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b, out = l_at[a], r_at[b], np.zeros(len(a))
        cuts = [0, *(np.flatnonzero(np.diff(a)) + 1).tolist(), len(a)] if len(a) else []
        for lo, hi in zip(cuts, cuts[1:]):
            own = slice(l_start[a[lo]], l_start[a[lo]] + l.size[a[lo]])
            row[l.gram[own]] = l.weight[own]
            some, back = np.unique(b[lo:hi], return_inverse=True)
            size = r.size[some]
            at = np.arange(size.sum()) + np.repeat(r_start[some] - np.cumsum(size) + size, size)
            out[lo:hi] = np.bincount(np.repeat(np.arange(len(some)), size), weights=row[r.gram[at]] * r.weight[at], minlength=len(some))[back]
            row[l.gram[own]] = 0.0
        return np.clip(out, 0.0, 1.0)

    return values


def numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, list[str]]:
    """(number of each text, distinct texts) of a looked-up column."""
    code = pa.chunked_array(column.chunks, pa.string()).combine_chunks().dictionary_encode()
    return code.indices.to_numpy(), code.dictionary.to_pylist()


def known_cosine(idf_table: DataFrame, n: int = 3):
    """A measure for ``candidates.top`` by a fitted idf, which is broadcast; lookups have a lower-case ``text``."""
    rows = idf_table.select("gram", "idf").toArrow()
    sent = idf_table.sparkSession.sparkContext.broadcast((rows["gram"].to_pylist(), rows["idf"].to_numpy()))
    place: dict[str, int] = {}

    def measure(left: pa.Table, right: pa.Table):
        if not place:
            place.update((g, i) for i, g in enumerate(sent.value[0]))
        (l_at, l), (r_at, r) = numbered(left["text"]), numbered(right["text"])
        return _cosines(l_at, _Vectors(l, place, sent.value[1], n), r_at, _Vectors(r, place, sent.value[1], n), len(place))

    return measure


def cosine(idf_table: DataFrame, n: int = 3, most: int = 200_000):
    """A function of two text columns: the cosine of their vectors, 0 without a common gram; None where ``idf_table`` has over ``most`` rows.

    The table is broadcast; a batch's texts become vectors once each, so no row is made for a gram of a pair.
    """
    rows = idf_table.select("gram", "idf").limit(most + 1).toArrow()
    if len(rows) > most:
        return None
    sent = idf_table.sparkSession.sparkContext.broadcast((rows["gram"].to_pylist(), rows["idf"].to_numpy()))
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    place: dict[str, int] = {}

    def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
        if (v := held.get(text)) is None:
            count = grams(text, place, n)
            at = np.fromiter(count, np.int64, len(count))
            w = np.fromiter(count.values(), np.float64, len(count)) * sent.value[1][at]
            if len(held) > 50_000:
                held.clear()
            v = held[text] = at, w / np.sqrt((w * w).sum())
        return v

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        if not place:
            place.update((g, i) for i, g in enumerate(sent.value[0]))
        (ca, ua), (cb, ub) = pd.factorize(a), pd.factorize(b)
        left, right = [vector(x) for x in ua], [vector(x) for x in ub]
        size = np.array([len(x[0]) for x in right])
        row, out = np.zeros(len(place)), np.zeros(len(ca))
        order = np.argsort(ca, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(ca[order])) + 1):
            at, w = left[ca[own[0]]]
            row[at] = w
            some, back = np.unique(cb[own], return_inverse=True)
            some_full = np.flatnonzero(size[some])
            if len(some_full):
                rs = [right[k] for k in some[some_full]]
                dots = np.zeros(len(some))
                products = row[np.concatenate([x[0] for x in rs])] * np.concatenate([x[1] for x in rs])
                ends = np.cumsum(size[some[some_full]])
                dots[some_full] = np.add.reduceat(products, ends - size[some[some_full]])
                out[own] = dots[back]
            row[at] = 0.0
        return pd.Series(np.clip(out, 0.0, 1.0))

    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return lambda a, b: run(plain(a), plain(b))


def similar(left: DataFrame, right: DataFrame, k: int, least: float, by: str = "country", heavy: int = 2000) -> DataFrame:
    """(source1_entity_id, candidate_entity_id, similarity): the ``k`` most similar vectors of each left one within ``by``.

    Exact.  Candidates come from grams that at most ``heavy`` right vectors of a group have; the product over the
    other grams is at most the product of the two vectors' lengths over them, so only candidates whose bound
    reaches ``least`` are completed, and left vectors whose light part is too short for that are held against
    the heavy grams, too.
    """
    r = right.select(by, F.col("id").alias("candidate_entity_id"), "gram", F.col("weight").alias("wb"))
    q = left.select(by, F.col("id").alias("source1_entity_id"), "gram", F.col("weight").alias("wa"))
    many = r.groupBy(by, "gram").agg(F.count(F.lit(1)).alias("n")).withColumn("light", F.col("n") <= heavy).drop("n")
    tagged = q.join(many, [by, "gram"])
    # A left vector whose heavy part is shorter than ``least`` can't reach it by heavy grams alone.
    whole = tagged.groupBy("source1_entity_id").agg(F.sqrt(F.sum(F.when(~F.col("light"), F.col("wa") * F.col("wa")).otherwise(0.0))).alias("heavy_length"))
    start = tagged.join(whole, "source1_entity_id").filter(F.col("light") | (F.col("heavy_length") >= least))
    pair = ["source1_entity_id", "candidate_entity_id"]
    found = start.join(r, [by, "gram"]).select(*pair).distinct()
    dots = found.join(q.drop(by), "source1_entity_id").join(r.drop(by), ["candidate_entity_id", "gram"]).groupBy(*pair).agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))
    w = Window.partitionBy("source1_entity_id").orderBy(F.desc("similarity"), "candidate_entity_id")
    return dots.filter(F.col("similarity") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, corpus: DataFrame, name: str, config, digits: int | None = None) -> DataFrame:
    """(source1_entity_id, candidate_entity_id, similarity, rank): nearest corpus names of each query by TF-IDF cosine, the model
    fitted on each country's corpus; ranked by the similarity (rounded to ``digits``), ties by id.

    Names beyond ASCII count together with their transliteration.  Equal names are one text: a block of a country's query
    texts meets all its corpus texts, with the k smallest ids of each, in one task.  All texts of an id count as one.
    """
    country = F.col("country") if config.country_partition else F.lit("ALL")
    full = F.when(F.col(name).rlike(r"[^\x00-\x7F]"), F.concat_ws(" ", name, text.transliterated(F.col(name)))).otherwise(F.col(name))
    plain = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))

    def by_id(x: DataFrame) -> DataFrame:
        rows = x.select("entity_id", country.alias("country"), full.alias("t"))
        return staged(rows.groupBy("country", "entity_id").agg(plain(F.array_join(F.array_sort(F.collect_list("t")), " ")).alias("t")))

    c, q = by_id(corpus), by_id(queries)
    n, k = config.tfidf_ngram, config.top_k_tfidf
    texts_ = c.groupBy("country", "t").agg(F.count(F.lit(1)).alias("times"))
    size = c.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    counts = gram_counts(texts_.select(F.struct("country", "t", "times").alias("id"), "t"), "id", "t", n).select("id.country", "id.times", "gram", "tf")
    table = counts.groupBy("country", "gram").agg(F.sum("times").alias("df"), F.sum(F.col("tf") * F.col("times")).alias("total")).join(size, "country").filter(F.col("df") >= F.least(F.lit(2), F.col("n")))
    w = Window.partitionBy("country").orderBy(F.desc("total"), "gram")
    table = table.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= config.tfidf_max_features)
    model = staged(table.select("country", F.col("gram").alias("t"), (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf"), F.xxhash64("gram").alias("h")))
    # Blocks by hash in each country: as many as its query texts fill.
    asked = q.select("country", "t").distinct()
    blocks = asked.groupBy("country").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("blocks"))
    asked = asked.join(blocks, "country").select("country", F.pmod(F.xxhash64("t"), "blocks").cast("int").alias("block"), "t")
    first = Window.partitionBy("country", "t").orderBy("entity_id")
    held = c.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k).groupBy("country", "t").agg(F.array_sort(F.collect_list("entity_id")).alias("ids"))
    every = lambda x: x.join(blocks, "country").withColumn("block", F.explode_outer(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))).drop("blocks")
    kinds = [every(model).withColumn("kind", F.lit(0)), asked.withColumn("kind", F.lit(1)), every(held).withColumn("kind", F.lit(2))]
    rows = kinds[0].unionByName(kinds[1], allowMissingColumns=True).unionByName(kinds[2], allowMissingColumns=True)
    number = F.dense_rank().over(Window.orderBy("country", "block"))
    spread = asked.select("country", "block").distinct().withColumn("place", number - 1)
    most = max(1, spread.count())
    rows = rows.join(F.broadcast(spread), ["country", "block"]).select("place", "kind", "country", "t", "idf", "h", "ids").repartitionById(most, F.col("place")).sortWithinPartitions("place", "kind", "t")
    dim = config.dense_dim if config.knn_engine == "dense" else None
    found = rows.mapInArrow(_nearest(k, config.min_tfidf_sim, n, dim, digits), "country string, t string, candidate_entity_id string, similarity double, rank int")
    return q.withColumnRenamed("entity_id", "source1_entity_id").join(found, ["country", "t"]).select("source1_entity_id", "candidate_entity_id", "similarity", "rank")


def signs(h: np.ndarray, dim: int, seed: int = 42) -> np.ndarray:
    """A row for each hash of a gram: it adds to 8 of ``dim`` dimensions, by random signs.

    Inner products are kept up to an error of about 1 / sqrt(dim) without gathering a matrix anywhere.
    """
    out = np.zeros((len(h), dim))
    h = h.astype(np.int64).view(np.uint64)
    for k in range(8):
        x = (h ^ np.uint64(seed * 8 + k)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        sign = 1.0 - 2.0 * ((x >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
        np.add.at(out, (np.arange(len(h)), (x % np.uint64(dim)).astype(int)), sign / 8**0.5)
    return out


class _Numbers(dict):
    """Numbers grams as they are asked for."""

    def get(self, key: str, default: int | None = None) -> int:
        return self.setdefault(key, len(self))


class _Vectors:
    """Vectors of texts, of length 1, as (text, gram, weight) in order of the texts; those without a known gram are empty.

    ``idf_``: by gram, or (``own``) of each text's grams as they first come.
    """

    def __init__(self, texts_: list[str], place: dict[str, int], idf_: np.ndarray, n: int, own: bool = False) -> None:
        sizes, at, tf = [], [], []
        for t in texts_:
            count = grams(t, place, n)
            sizes.append(len(count))
            at += count
            tf += count.values()
        self.row = np.repeat(np.arange(len(texts_)), sizes)
        self.gram = np.array(at, dtype=np.int64)
        w = np.array(tf, dtype=np.float64) * (idf_ if own else idf_[self.gram])
        norm = np.sqrt(np.bincount(self.row, weights=w * w, minlength=len(texts_)))
        self.weight = w / norm[self.row]
        self.size, self.n = np.array(sizes, dtype=np.int64), len(texts_)

    def dense(self, projection: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, projection.shape[1]))
        for a in range(0, len(self.row), 65_536):
            np.add.at(out, self.row[a : a + 65_536], self.weight[a : a + 65_536, None] * projection[self.gram[a : a + 65_536]])
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1.0)


def _similarities(q: _Vectors, c: _Vectors, vocabulary: int, projection: np.ndarray | None):
    """(first query, similarities): a row a query, a column a corpus text, some queries at a time."""
    if projection is not None:
        a, b = q.dense(projection), c.dense(projection).T
        for i in range(0, q.n, 256):
            yield i, a[i : i + 256] @ b
        return
    order = np.argsort(c.gram, kind="stable")
    row, weight = c.row[order], c.weight[order]
    end = np.cumsum(np.bincount(c.gram, minlength=vocabulary))
    start = np.concatenate([[0], end[:-1]])
    last = np.cumsum(q.size)
    for i in range(q.n):
        own = slice(last[i] - q.size[i], last[i])
        spans = [slice(start[g], end[g]) for g in q.gram[own]]
        if spans:
            products = np.concatenate([weight[s] * w for s, w in zip(spans, q.weight[own])])
            yield i, np.bincount(np.concatenate([row[s] for s in spans]), weights=products, minlength=c.n)[None, :]


def _nearest(k: int, least: float, n: int, dim: int | None, digits: int | None):
    def blocks(batches):
        """(model, query texts, batches of corpus texts) of each place, the corpus read as it comes."""
        for b in batches:
            at = (b.column("place").to_numpy().astype(np.int64) * 3 + b.column("kind").to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else []
            for lo, hi in zip(cuts, cuts[1:]):
                yield int(at[lo]) // 3, int(at[lo]) % 3, b.slice(lo, hi - lo)

    def answer(country: str, asked: list[str], best: list) -> pa.RecordBatch:
        rows = [(t, c, s, r) for t, own in zip(asked, best) for r, (s, c) in enumerate(((-s, c) for s, c in own), 1)]
        cols = list(zip(*rows)) or [()] * 4
        kinds = [pa.string(), pa.string(), pa.float64(), pa.int32()]
        return pa.record_batch([pa.array([country] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["country", "t", "candidate_entity_id", "similarity", "rank"])

    def run(batches):
        place = None
        for at, kind, b in blocks(batches):
            if at != place:
                if place is not None:
                    yield answer(country, asked, best)
                place, country, asked, best, model, q = at, b.column("country")[0].as_py(), [], [], [], None
            if kind == 0:
                model.append(b)
            elif kind == 1:
                asked += b.column("t").to_pylist()
            else:
                if q is None:
                    m = pa.Table.from_batches(model) if model else b.slice(0, 0)
                    names = {g: i for i, g in enumerate(m["t" if model else "ids"].to_pylist())}
                    idf_ = np.asarray(m["idf"], dtype=np.float64)
                    projection = signs(np.asarray(m["h"]), dim) if dim and names else None
                    q, best = _Vectors(asked, names, idf_, n), [[] for _ in asked]
                ids = b.column("ids").to_pylist()
                c = _Vectors(b.column("t").to_pylist(), names, idf_, n)
                if not names:
                    continue
                for i, sims in _similarities(q, c, len(names), projection):
                    shown = sims if digits is None else np.round(sims, digits)
                    for j, (sim, own) in enumerate(zip(sims, shown), i):
                        # Ids of a text are equally near, so the k nearest texts (by their first ids) hold the k nearest ids.
                        bar = -best[j][-1][0] if len(best[j]) == k else -np.inf
                        hit = np.flatnonzero((sim >= least) & (own >= bar))
                        if len(hit) > k:
                            edge = np.partition(own[hit], len(hit) - k)[len(hit) - k]
                            hit = hit[own[hit] >= edge]
                        if len(hit):
                            near = sorted((-float(own[x]), ids[x][0], x) for x in hit)[:k]
                            best[j] = sorted(best[j] + [(s, y) for s, _, x in near for y in ids[x]])[:k]
        if place is not None:
            yield answer(country, asked, best)

    return run
