"""Toxicity classifier: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of the vectors of three hashes: the whole word's and those of its first 4 and
6 bytes, so inflected forms of a known stem are met too.  Filters of several widths run over the words,
each filter's largest response in the document goes to a logistic layer, and numpy fits everything by
stochastic gradient descent (Adagrad steps) on a bounded sample of labelled rows.  Thresholds are
calibrated by language on all labelled rows that aren't held out: rows of the sample are scored by a model of
the sample's other parts, all further ones by the model itself, and counts by score are summed.  The language is
what the text's own function words say (the declared one is never an input), and the score is shifted so that
0.5 is the threshold.

Whole texts are scored, whatever their length.  Null and empty texts have no word: one padding position
stands for them.  Without labelled rows of both classes every score is below 0.5.  Labels, language,
source and id are never inputs of a score.  Repeated rows are scored alike, null ids stay null and count
as not held out; only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import map_slices, plain, texts_of
from lodestone.llm.hashing import WORD, Buffer, mixed

# Frequent function words by which a text's own language is told.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for it with as his on be at by had not are from this",
    "fr": "le les des du et est une dans qui que pour pas sur au avec ce il sont par ne aux",
    "de": "der die und das den von zu mit sich des auf für ist nicht ein eine dem auch als an",
    "es": "el los las del y por con una su para es al lo como más pero sus le ha este sí",
    "it": "il di che è un per non sono della una nel alla più dei anche gli come del questo ma",
    "pt": "o que não uma os em para com do da dos das se na no mais por ao ele foi",
    "nl": "het een van en dat niet zijn op te voor met aan er maar om dan zou wat ook naar",
    "pl": "się nie na jest że do to jak ale po co tak za od są przez jego dla tylko może",
}
LANGS = ["", *FUNCTION_WORDS]


@dataclass(frozen=True)
class Shape:
    """Buckets, vector length, filter widths and filters of each; bounds on the sample; the schedule."""

    bits: int = 15
    dim: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    max_rows: int = 2000  # of each class, for the filters
    max_words: int = 4000  # labelled texts of more words are left out of the sample (not out of calibration or scoring)
    folds: int = 3  # parts of the sample that are scored by models of the others
    least: int = 12  # rows of either class that a language needs for a threshold of its own
    epochs: int = 8
    batch: int = 32
    rate: float = 0.08
    seed: int = 11


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    words = [(w.encode(), k + 1) for k, lang in enumerate(FUNCTION_WORDS) for w in FUNCTION_WORDS[lang].split()]
    buf = Buffer([w for w, _ in words])
    h, k = buf.spans(buf.start, buf.end), np.array([k for _, k in words])
    order = np.argsort(h)
    return h[order], k[order]


@dataclass
class Words:
    """Word positions of texts: three buckets each (padding is bucket 0), texts' first and last places, languages."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lang: np.ndarray


_LANGUAGE = _language_table()


def words_of(texts: list[str], shape: Shape) -> Words:
    buf = Buffer([t.encode("utf-8", "surrogatepass") for t in texts], lower=True)
    a, b = buf.words(WORD)
    whole = buf.spans(a, b)
    shift = np.uint64(64 - shape.bits)
    prefix = [mixed(buf.spans(a, np.minimum(a + n, b)) + np.uint64(n)) for n in (4, 6)]
    ids = np.column_stack([np.maximum(h >> shift, 1).astype(np.int32) for h in (whole, *prefix)])
    first, last = np.searchsorted(a, buf.start), np.searchsorted(a, buf.end)
    known, of = _LANGUAGE
    at = np.minimum(np.searchsorted(known, whole), len(known) - 1)
    lang_of = np.where(known[at] == whole, of[at], 0)
    votes = np.stack([np.diff(np.concatenate([[0], np.cumsum(lang_of == k)])[np.column_stack([first, last])], axis=1)[:, 0] for k in range(1, len(LANGS))], axis=1) if len(texts) else np.zeros((0, 1))
    lang = np.where(votes.max(axis=1) > 0, votes.argmax(axis=1) + 1, 0) if len(texts) else np.zeros(0, dtype=int)
    # widest filter - 1 padding places after each text; an empty text has one more, its only position
    gap, n = max(shape.widths) - 1, last - first
    size = np.maximum(n, 1) + gap
    start = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    out = np.zeros((int(size.sum()), 3), dtype=np.int32)
    out[np.arange(len(ids)) + np.repeat(start - first, n)] = ids
    return Words(out, start, start + np.maximum(n, 1), lang)


@dataclass
class Net:
    shape: Shape
    emb: np.ndarray
    conv: dict[int, np.ndarray]
    conv_bias: dict[int, np.ndarray]
    out: np.ndarray
    bias: float = 0.0
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGS)))

    @classmethod
    def fresh(cls, shape: Shape) -> Net:
        rng = np.random.default_rng(shape.seed)
        emb = rng.normal(0, 0.1, (1 << shape.bits, shape.dim)).astype(np.float32)
        emb[0] = 0
        conv = {w: rng.normal(0, (w * shape.dim) ** -0.5, (w * shape.dim, shape.filters)).astype(np.float32) for w in shape.widths}
        bias = {w: np.full(shape.filters, 0.05, dtype=np.float32) for w in shape.widths}
        return cls(shape, emb, conv, bias, rng.normal(0, 0.3, len(shape.widths) * shape.filters).astype(np.float32))

    def windows(self, vectors: np.ndarray, w: int) -> np.ndarray:
        return np.lib.stride_tricks.as_strided(vectors, (len(vectors) - w + 1, w * self.shape.dim), vectors.strides, writeable=False)

    def pooled(self, words: Words) -> np.ndarray:
        """The largest response of each filter in each text."""
        if not len(words.start):
            return np.zeros((0, len(self.out)), dtype=np.float32)
        v = self.emb[words.hashes[:, 0]] + self.emb[words.hashes[:, 1]] + self.emb[words.hashes[:, 2]]
        parts = []
        for w in self.shape.widths:
            r = self.windows(v, w) @ self.conv[w]
            r = np.concatenate([r, np.full((len(v) - len(r) + 1, r.shape[1]), -np.inf, dtype=np.float32)])
            parts.append(np.maximum.reduceat(r, np.column_stack([words.start, words.end]).ravel(), axis=0)[::2] + self.conv_bias[w])
        return np.maximum(np.hstack(parts), 0)

    def logits(self, words: Words) -> np.ndarray:
        return self.pooled(words).astype(np.float64) @ self.out.astype(np.float64) + self.bias

    def logits_of(self, docs: list[np.ndarray]) -> np.ndarray:
        """The logits of texts given as word buckets."""
        gap, out = max(self.shape.widths) - 1, [np.empty(0)]
        pad = np.zeros((gap, 3), dtype=np.int32)
        for a in range(0, len(docs), 64):
            part = [d if len(d) else np.zeros((1, 3), dtype=np.int32) for d in docs[a : a + 64]]
            size = np.array([len(d) for d in part])
            start = np.concatenate([[0], np.cumsum(size + gap)[:-1]])
            out.append(self.logits(Words(np.concatenate([x for d in part for x in (d, pad)]), start, start + size, np.zeros(len(part), dtype=int))))
        return np.concatenate(out)

    def scores(self, texts: list[str]) -> np.ndarray:
        words = words_of(texts, self.shape)
        return 1 / (1 + np.exp(-np.clip(self.logits(words) - self.shift[words.lang], -30, 30)))


class Adagrad:
    def __init__(self, x: np.ndarray, rate: float) -> None:
        self.x, self.rate, self.seen = x, rate, np.full(x.shape, 1e-6, dtype=np.float32)

    def step(self, g: np.ndarray, at=slice(None)) -> None:
        self.seen[at] += g * g
        self.x[at] -= self.rate * g / np.sqrt(self.seen[at])


def fit(rows: list[tuple[int, np.ndarray]], shape: Shape) -> Net:
    """``rows``: (label, word buckets). Gradients reach only the places where a filter was largest."""
    net = Net.fresh(shape)
    y = np.array([r[0] for r in rows], dtype=np.float32)
    if len(np.unique(y)) < 2:
        net.out[:], net.bias = 0, -4.0
        return net
    rng, gap = np.random.default_rng(shape.seed), max(shape.widths) - 1
    opt = {"emb": Adagrad(net.emb, shape.rate), "out": Adagrad(net.out, shape.rate)}
    conv = {w: (Adagrad(net.conv[w], shape.rate), Adagrad(net.conv_bias[w], shape.rate)) for w in shape.widths}
    bias_seen = 1e-6
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))).astype(np.float32)
    dim, pad = shape.dim, np.zeros((gap, 3), dtype=np.int32)
    for _ in range(shape.epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), shape.batch):
            own = order[k : k + shape.batch]
            docs = [rows[i][1] if len(rows[i][1]) else pad[:1] for i in own]
            size = np.array([len(d) for d in docs])
            start = np.concatenate([[0], np.cumsum(size + gap)[:-1]])
            hashes = np.concatenate([x for d in docs for x in (d, pad)])
            v = net.emb[hashes].sum(axis=1)
            best, where = [], []
            for w in shape.widths:
                r = net.windows(v, w) @ net.conv[w] + net.conv_bias[w]
                at = np.stack([r[s : s + n].argmax(axis=0) + s for s, n in zip(start, size)])
                where.append(at)
                best.append(r[at, np.arange(shape.filters)])
            h = np.maximum(np.hstack(best), 0)
            keep = (rng.random(h.shape) > 0.3).astype(np.float32) / 0.7
            z = np.clip((h * keep) @ net.out + net.bias, -30, 30)
            d = (1 / (1 + np.exp(-z)) - y[own]) * weight[own] / len(own)
            dh = d[:, None] * net.out[None, :] * keep * (h > 0)
            opt["out"].step((h * keep).T @ d)
            bias_seen += float(d.sum()) ** 2
            net.bias -= shape.rate * float(d.sum()) / bias_seen**0.5
            rows_at, grads = [], []
            for j, w in enumerate(shape.widths):
                g = dh[:, j * shape.filters : (j + 1) * shape.filters]
                win = np.stack([v[where[j] + o] for o in range(w)], axis=2).reshape(len(own), shape.filters, w * dim)
                conv[w][0].step(np.einsum("df,dfx->xf", g, win))
                conv[w][1].step(g.sum(axis=0))
                back = (g[:, :, None] * net.conv[w].T[None]).reshape(len(own), shape.filters, w, dim)
                place = where[j][:, :, None] + np.arange(w)
                rows_at.append(hashes[place.ravel()].ravel())
                grads.append(np.repeat(back.reshape(-1, dim), 3, axis=0))
            at, inv = np.unique(np.concatenate(rows_at), return_inverse=True)
            total = np.zeros((len(at), dim), dtype=np.float32)
            np.add.at(total, inv, np.concatenate(grads))
            total[at == 0] = 0
            opt["emb"].step(total, at)
    return net


def threshold(z: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The logit above which the most rows are told right by F1, in the middle of the gap there, from counts by logit."""
    order = np.argsort(-z, kind="stable")
    z, clean, toxic = z[order], clean[order], toxic[order]
    hits = np.cumsum(toxic)
    f1 = 2 * hits / (hits + np.cumsum(clean) + toxic.sum())
    f1[:-1][z[:-1] == z[1:]] = -1
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


#: Logits are counted in steps of a sixteenth.
STEP = 16


def calibrate(net: Net, counts: list[tuple[int, int, int, int]]) -> None:
    """Thresholds by language from (language, label, logit in steps, rows); languages of few rows take the common one."""
    if not counts:
        return
    lang, y, z, n = np.array(counts, dtype=np.int64).T
    for k in (None, *range(len(LANGS))):
        own = np.ones(len(y), dtype=bool) if k is None else lang == k
        clean, toxic = n * (y == 0) * own, n * (y == 1) * own
        if min(clean.sum(), toxic.sum()) >= net.shape.least:
            net.shift[slice(None) if k is None else k] = threshold(z[own] / STEP, clean[own], toxic[own])


def held_out(id_col: str, mod: int = 5, rest: int = 0):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", shape: Shape = Shape()) -> Net:
    """Filters from ``max_rows`` rows of either class, thresholds from all labelled rows that aren't held out.

    What reaches the driver is bounded by rows and by words a row, and by counts by logit; of texts that repeat an id
    one goes into the sample.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("string").alias("k"), F.col(label_col).cast("int").alias("label")).distinct()
    h = F.xxhash64("k")
    sample = known.filter("label = 0").orderBy(h).limit(shape.max_rows).unionByName(known.filter("label = 1").orderBy(h).limit(shape.max_rows))
    texts = docs.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("text"))

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        w = words_of(texts_of(part.column(2)), shape)
        out: list[list] = [[], [], [], []]
        for k, label, a, b, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), w.start, w.end, w.lang):
            if b - a <= shape.max_words:
                for col, v in zip(out, (k, label, int(lang), w.hashes[a:b].astype(np.uint16).tobytes())):
                    col.append(v)
        return pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.int32(), pa.binary()))], names=["k", "label", "lang", "words"])

    each = texts.join(F.broadcast(sample), "k").select("k", "label", "text").mapInArrow(map_slices(rows, "text", 1 << 20), "k string, label int, lang int, words binary")
    got = each.groupBy("k", "label").agg(F.min(F.struct("words", "lang")).alias("x")).select("k", "label", "x.lang", "x.words").toLocalIterator()
    data = sorted((bytes(r[3]), r[1], r[2], r[0]) for r in got)
    words = [np.frombuffer(d[0], dtype=np.uint16).reshape(-1, 3).astype(np.int32) for d in data]
    net = fit([(d[1], w) for d, w in zip(data, words)], shape)
    # Copies are in one part, whatever their order.
    part_of = [xxhash.xxh64_intdigest(d[0]) % shape.folds for d in data]
    counts: Counter = Counter()
    for f in range(shape.folds):
        own = [i for i, x in enumerate(part_of) if x == f]
        other = fit([(data[i][1], words[i]) for i, x in enumerate(part_of) if x != f], shape)
        for i, z in zip(own, other.logits_of([words[i] for i in own])):
            counts[data[i][2], data[i][1], int(np.round(z * STEP))] += 1
    taken = docs.sparkSession.createDataFrame([(d[3], d[1]) for d in data], "k string, label int")
    rest = known.join(F.broadcast(taken), ["k", "label"], "left_anti")
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def logits(part: pa.RecordBatch) -> pa.RecordBatch:
        w = words_of(texts_of(part.column(1)), shape)
        return pa.record_batch([part.column(0), pa.array(w.lang, pa.int32()), pa.array(np.round(sent.value.logits(w) * STEP).astype(np.int64))], names=["k", "lang", "z"])

    if not rest.isEmpty():
        # Logits are joined with the labels, not texts: what is shuffled is a few bytes a row.
        scored = texts.filter("k is not null").mapInArrow(map_slices(logits, "text", 1 << 20), "k string, lang int, z long").join(rest, "k")
        for r in scored.groupBy("lang", "label", F.least(F.greatest("z", F.lit(-4096)), F.lit(4096)).alias("z")).count().collect():
            counts[r[0], r[1], r[2]] += r[3]
    calibrate(net, [(*k, n) for k, n in sorted(counts.items())])
    return net


def score(docs: DataFrame, net: Net, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score per row; its other columns stay, an older one of that name gives way."""
    docs = docs.drop(out_col)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    text_at, ddl = docs.columns.index(text_col), T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        s = sent.value.scores(texts_of(part.column(text_at)))
        return pa.record_batch([*part.columns, pa.array(s, pa.float64())], names=ddl.names)

    return plain(docs).mapInArrow(map_slices(one, f"c{text_at}", 1 << 20), ddl)


def op8_convolutional_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
