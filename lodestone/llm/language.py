"""Language identification by Bayesian evidence fusion.

The posterior of a language is the product of three kinds of evidence:

* the text's likelihood: a multinomial naive Bayes model over hashed byte n-grams, learned from a bounded
  sample of rows of known language; as n-grams overlap, a text counts as ``cap`` of them at most;
* the language that the markup declares, by how often pages of each language declare it;
* the prior of the host, smoothed towards that of its address suffix, and this towards that of the whole
  corpus.

The counts behind the last two are sums over all rows of the posteriors that the text alone gives, made by one
grouped aggregation; each row's own share is taken off again before it is judged (leave one out).

Null texts, hosts and declarations count as empty: an empty text has no likelihood, an empty declaration is
no evidence, rows without a host share one.  A row is accepted if its text has letters and its best language has
at least ``least`` of the posterior; other rows have the language ``und``.  Ties go to the language first in the
alphabet.  Without any row of known language nothing is accepted.  Repeated rows count as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import cut, fresh, map_slices, texts_of
from lodestone.llm.hashing import WORD, Buffer, sums_between

#: Tables of at most so many rows are broadcast; larger ones are joined by their key.
SMALL_ROWS = 20_000


@dataclass(frozen=True)
class Params:
    bits: int = 14
    grams: tuple[int, ...] = (2, 3, 4)
    max_rows: int = 4000  # rows of known language from which likelihoods are learned
    cap: float = 40.0  # n-grams that a text counts as, at most
    host: float = 20.0  # pseudo-counts of the suffix in a host's prior
    suffix: float = 50.0  # pseudo-counts of the corpus in a suffix's prior
    declared: float = 5.0  # pseudo-counts in the table of declarations
    least: float = 0.5


class Likelihood:
    """``table``: log-likelihood of each bucket's n-gram by language."""

    def __init__(self, langs: list[str], table: np.ndarray, p: Params) -> None:
        self.langs, self.table, self.p = langs, table, p

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods by text and language, and the number of each text's letters (bytes of words)."""
        buf = Buffer([t.encode("utf-8", "surrogatepass") for t in texts], lower=True)
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for h, a, b in _places(buf, self.p):
            for k in range(len(self.langs)):
                total[:, k] += sums_between(self.table[:, k][h], a, b)
            n += b - a
        total *= (np.minimum(n, self.p.cap) / np.maximum(n, 1))[:, None]
        return total, sums_between(LETTER[buf.bytes], buf.start, buf.end)


#: Bytes that are part of words, digits aside.
LETTER = (WORD & ~np.isin(np.arange(256), np.arange(48, 58))).astype(np.float64)


def _places(buf: Buffer, p: Params):
    shift = np.uint64(64 - p.bits)
    for n in p.grams:
        h = (buf.grams(n) >> shift).astype(np.int32)
        first = np.minimum(buf.start, len(h))
        yield h, first, np.clip(buf.end - n + 1, first, len(h))


def fit(docs: DataFrame, p: Params = Params(), *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Likelihood:
    """Likelihoods from the ``max_rows`` rows of smallest id hash; only counts per language reach the driver."""
    known = docs.filter(F.col(lang_col).isNotNull() & (F.col(lang_col) != "") & F.col(text_col).isNotNull())
    sample = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("k"))
    keys = sample.select("k").orderBy(F.xxhash64("k")).limit(p.max_rows)
    rows = sample.join(F.broadcast(keys.distinct()), "k", "left_semi").select("lang", "text")

    def counts(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = total.setdefault(lang, np.zeros(1 << p.bits))
                for h, a, b in _places(Buffer([text.encode("utf-8", "surrogatepass")], lower=True), p):
                    own += np.bincount(h[a[0] : b[0]], minlength=len(own)) / max(1, len(text)) ** 0.5
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array([x.astype(np.float64).tobytes() for x in total.values()], pa.binary())], names=["lang", "counts"])

    # The whole table is filtered in full parallelism; the bounded sample is then counted by eight tasks, so that
    # eight tables a language reach the driver.
    got = rows.repartition(8).mapInArrow(counts, "lang string, counts binary").collect()
    langs = sorted({r[0] for r in got})
    if not langs:
        return Likelihood(["und"], np.zeros((1 << p.bits, 1)), p)
    table = np.full((1 << p.bits, len(langs)), 0.1)
    for lang, raw in sorted((r[0], bytes(r[1])) for r in got):
        table[:, langs.index(lang)] += np.frombuffer(raw)
    return Likelihood(langs, np.log(table / table.sum(axis=0)), p)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fuse(model: Likelihood, loglik: np.ndarray, host: np.ndarray, suffix: np.ndarray, corpus: np.ndarray, declared: np.ndarray, has: np.ndarray, by_declared: np.ndarray) -> np.ndarray:
    """Posteriors, from soft counts by language that still hold each row's own share.

    ``host``, ``suffix``, ``declared``: counts of each row's host, suffix and declaration; ``corpus``: of all rows;
    ``by_declared``: of all rows that declare anything; ``has``: whether the row does.
    """
    p, own = model.p, softmax(loglik)
    less = lambda x: np.maximum(x - own, 0)
    share = lambda x: (x + 1) / (x + 1).sum(axis=1, keepdims=True)
    base = share(less(corpus[None, :]))
    s = less(suffix)
    s = (s + p.suffix * base) / (s.sum(axis=1, keepdims=True) + p.suffix)
    h = less(host)
    h = (h + p.host * s) / (h.sum(axis=1, keepdims=True) + p.host)
    said, all_said = less(declared), less(by_declared[None, :])
    rate = (said.sum(axis=1, keepdims=True) + 1) / (all_said.sum(axis=1, keepdims=True) + 2)
    odds = np.where(has[:, None], np.log((said + p.declared * rate) / (all_said + p.declared)), 0.0)
    return softmax(loglik + np.log(h) + odds)


def identify(df: DataFrame, model: Likelihood, *, text: Column, host: Column, suffix: Column, declared: Column, keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``lang_id`` (``und`` if not accepted), ``lang_best``, ``lang_confidence`` and ``lang_accepted``.

    ``keep``: the columns of ``df`` that the result has (all of them).  Columns by the four names give way; any other
    name may stand in ``df``.  The rows are read twice: once for the counts, once for the judgement.
    """
    new = ["lang_id", "lang_best", "lang_confidence", "lang_accepted"]
    df = df.drop(*new)
    own = df.columns if keep is None else list(keep)
    t, h, s, d, lik, letters, hv, sv, dv = fresh(df.columns, "t", "h", "s", "d", "lik", "letters", "hv", "sv", "dv")
    held = fresh(df.columns, *(f"c{i}" for i in range(len(own))))  # mapInArrow can't take names that hold a dot
    langs, sent = model.langs, df.sparkSession.sparkContext.broadcast(model)
    clean = lambda c: F.coalesce(c, F.lit(""))
    evidence = [clean(text).alias(t), clean(host).alias(h), clean(suffix).alias(s), clean(declared).alias(d)]
    names = [f"q{k}" for k in range(len(langs))]

    def soft(part: pa.RecordBatch) -> pa.RecordBatch:
        q = softmax(sent.value.of(texts_of(part.column(0)))[0])
        return pa.record_batch([*part.columns[1:], *(pa.array(q[:, k]) for k in range(q.shape[1]))], names=[h, s, d, *names])

    ddl = f"{h} string, {s} string, {d} string, " + ", ".join(f"{c} double" for c in names)
    # Sums of doubles depend on their order: whole millionths don't.
    whole = [F.sum(F.round(F.col(c) * 1e6).cast("long")).alias(c) for c in names]
    keyed = cut(df.select(*evidence).mapInArrow(map_slices(soft, t, 1 << 20), ddl).groupBy(h, s, d).agg(*whole))
    total = lambda *by: keyed.groupBy(*by).agg(*(F.sum(c).alias(c) for c in names))
    vector = F.array(*(F.col(c) / 1e6 for c in names))
    tables = {(h, s): cut(total(h, s).select(h, s, vector.alias(hv))), (s,): cut(total(s).select(s, vector.alias(sv))), (d,): cut(total(d).select(d, vector.alias(dv)))}
    one = lambda rows: np.array([x or 0 for x in rows.agg(*(F.sum(c) for c in names)).first()], dtype=np.float64) / 1e6
    corpus, said = one(keyed), one(keyed.filter(F.col(d) != ""))

    fields = [df.schema[c] for c in own]
    out_names = [*own, *new]
    schema = T.StructType([*fields, *(T.StructField(n, k) for n, k in zip(new, (T.StringType(), T.StringType(), T.DoubleType(), T.BooleanType())))])

    def judged(kept: list[pa.Array], declares: pa.Array, loglik: np.ndarray, n: np.ndarray, counts: list[pa.Array]) -> pa.RecordBatch:
        m = sent.value
        has = np.array([bool(x) for x in declares.to_pylist()], dtype=bool)
        host_counts, suffix_counts, declared_counts = (c.flatten().to_numpy().reshape(len(n), -1) for c in counts)
        post = fuse(m, loglik, host_counts, suffix_counts, corpus, declared_counts, has, said)
        best, top = post.argmax(axis=1), post.max(axis=1)
        good = (n > 0) & (top >= m.p.least) & (m.langs != ["und"])
        lang = [langs[k] for k in best]
        return pa.record_batch([*kept, pa.array([x if g else "und" for x, g in zip(lang, good)]), pa.array(lang), pa.array(top), pa.array(good)], names=out_names)

    sizes = {key: table.limit(SMALL_ROWS + 1).count() for key, table in tables.items()}

    def with_counts(rows: DataFrame) -> DataFrame:
        for key, table in tables.items():
            if sizes[key] == 1:  # one key for all rows: nothing to join
                rows = rows.withColumn(table.columns[-1], F.array(*(F.lit(x) for x in table.first()[-1])))
            else:  # beyond SMALL_ROWS: a join by the key, whose hot partitions Spark splits
                rows = rows.join(F.broadcast(table) if sizes[key] <= SMALL_ROWS else table, list(key))
        return rows

    rows = df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(own, held)), *evidence)
    if all(n <= SMALL_ROWS for n in sizes.values()):
        # The counts come to the rows by broadcast: one step computes likelihoods and judges.
        def both(part: pa.RecordBatch) -> pa.RecordBatch:
            loglik, n = sent.value.of(texts_of(part.column(len(own))))
            return judged(part.columns[: len(own)], part.column(len(own) + 1), loglik, n, part.columns[len(own) + 2 :])

        return with_counts(rows).select(*held, t, d, hv, sv, dv).mapInArrow(map_slices(both, t, 1 << 20), schema)

    # Rows are dealt by their host: likelihoods first, so that a text that isn't kept is not carried along.
    def likely(part: pa.RecordBatch) -> pa.RecordBatch:
        loglik, n = sent.value.of(texts_of(part.column(len(own))))
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, loglik.size + 1, loglik.shape[1], dtype=np.int32)), pa.array(loglik.ravel()))
        return pa.record_batch([*part.columns[: len(own)], *part.columns[len(own) + 1 :], vectors, pa.array(n)], names=[*held, h, s, d, lik, letters])

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                declares, ll, n, *counts = part.columns[len(own) :]
                yield judged(part.columns[: len(own)], declares, ll.flatten().to_numpy().reshape(part.num_rows, -1), n.to_numpy(), counts)

    inner = [T.StructField(c, f.dataType) for c, f in zip(held, fields)]
    inner += [T.StructField(c, T.StringType()) for c in (h, s, d)] + [T.StructField(lik, T.ArrayType(T.DoubleType())), T.StructField(letters, T.DoubleType())]
    rows = rows.mapInArrow(map_slices(likely, t, 1 << 20), T.StructType(inner))
    return with_counts(rows).select(*held, d, lik, letters, hv, sv, dv).mapInArrow(judge, schema)


def page_text(html: Column) -> Column:
    """A page's text without scripts, styles, comments, navigation, advertisements and tags."""
    h = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1\s*>|<!--.*?-->", " ")
    h = F.regexp_replace(h, r"(?is)<div\b[^>]*\bclass\s*=\s*[\"'][^\"'>]*\b(?:ads?|advert\w*|banner)\b[^>]*>.*?</div\s*>", " ")
    h = F.regexp_replace(h, r"(?s)<[^>]*>", " ")
    return F.regexp_replace(h, r"&#?\w{1,8};", " ")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def suffix_of(url: Column) -> Column:
    """The last label of the address."""
    return F.regexp_extract(host_of(url), r"\.([^.]+)$", 1)


def declared_in(html: Column) -> Column:
    """The primary language of the root element's lang attribute."""
    return F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))


def identify_pages(pages: DataFrame, model: Likelihood) -> DataFrame:
    """``identify`` over raw pages (url, html) for all their columns but html; ``host`` and ``declared`` are added."""
    url, html = F.col("url"), F.col("html")
    rows = pages.drop("host", "declared").withColumns({"host": host_of(url), "declared": declared_in(html)})
    return identify(rows, model, text=page_text(html), host=F.col("host"), suffix=suffix_of(url), declared=F.col("declared"), keep=[c for c in rows.columns if c != "html"])


def op1_bayesian_language(spark, sf_dir: str) -> DataFrame:
    pages, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "documents"))
    found = identify_pages(pages.select("page_id", "url", "html"), fit(docs))
    return found.select("page_id", "host", "declared", F.col("lang_id").alias("lang"), F.round("lang_confidence", 6).alias("confidence"), F.col("lang_accepted").alias("accepted"))
