"""Quality classifier: supervised subword embeddings.

A document's features are its white-space delimited words and its byte n-grams, hashed into buckets; each
bucket has a learned vector (so have two marks, one of which stands with each word: whether the word
repeats the one before it), a document is the mean of its features' vectors, and a softmax layer gives
the class.  Stochastic gradient descent in numpy fits both on a bounded sample of labelled rows (the rows
of smallest id hash).  As the layers are linear, scoring needs one number a bucket: the projection of
its vector on the difference of the two classes' weights.

Whole texts are scored.  Null and empty texts have no feature and get the bias alone; without any
labelled row every score is 0.5.  Labels, language, source and id are never inputs of a score.  Repeated
rows are scored alike; null ids stay null and count as not held out.  Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import map_slices, plain, texts_of
from lodestone.llm.hashing import SPACE, Buffer, sums_between

FEATURES = "k string, label int, bucket binary, weight binary"


@dataclass(frozen=True)
class Shape:
    """Bucket count, vector length, n-gram lengths; the bounds on the training sample and the training schedule."""

    bits: int = 15
    dim: int = 12
    grams: tuple[int, ...] = (2, 3, 4)
    max_rows: int = 3000
    max_buckets: int = 8192  # labelled texts of more distinct buckets are left out of the sample (not out of scoring)
    epochs: int = 12
    batch: int = 64
    rate: float = 8.0
    seed: int = 7


def buckets(buf: Buffer, shape: Shape):
    """For each kind of feature: the bucket at each place, and the first and last place of each text."""
    shift = np.uint64(64 - shape.bits)
    for n in shape.grams:
        h = (buf.grams(n) >> shift).astype(np.int32)
        yield h, np.minimum(buf.start, len(h)), np.clip(buf.end - n + 1, np.minimum(buf.start, len(h)), len(h))
    a, b = buf.words(~SPACE)
    h = buf.spans(a, b)
    first, last = np.searchsorted(a, buf.start), np.searchsorted(a, buf.end)
    yield (h >> shift).astype(np.int32), first, last
    same = np.zeros(len(h), dtype=bool)
    same[1:] = h[1:] == h[:-1]
    same[first[first < last]] = False
    yield np.where(same, 1, 0).astype(np.int32), first, last


def sparse_rows(texts: list[str], shape: Shape) -> list[tuple[bytes, bytes]]:
    """Distinct buckets (16 bit) and their shares of each text's features."""
    buf = Buffer([t.encode("utf-8", "surrogatepass") for t in texts])
    kinds = list(buckets(buf, shape))
    out = []
    for i in range(len(texts)):
        count = np.bincount(np.concatenate([h[a[i] : b[i]] for h, a, b in kinds]), minlength=1)
        at = np.flatnonzero(count)
        out.append((at.astype(np.uint16).tobytes(), (count[at] / max(1, count.sum())).astype(np.float32).tobytes()))
    return out


class Model:
    """``vector``: a number a bucket; ``bias``: the logit of a text without features."""

    def __init__(self, vector: np.ndarray, bias: float, shape: Shape) -> None:
        self.vector, self.bias, self.shape = vector, bias, shape

    def scores(self, texts: list[str]) -> np.ndarray:
        buf = Buffer([t.encode("utf-8", "surrogatepass") for t in texts])
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for h, a, b in buckets(buf, self.shape):
            total += sums_between(self.vector[h], a, b)
            n += b - a
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -30, 30)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], shape: Shape) -> Model:
    """Gradient descent over mini-batches; ``rows`` are (label, buckets, shares)."""
    rng = np.random.default_rng(shape.seed)
    size = 1 << shape.bits
    y = np.array([r[0] for r in rows], dtype=np.int64)
    if len(np.unique(y)) < 2:
        return Model(np.zeros(size), 0.0 if not len(y) else (2.0 if y[0] else -2.0), shape)
    emb = rng.uniform(-1 / shape.dim, 1 / shape.dim, (size, shape.dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (shape.dim, 2)).astype(np.float32), np.zeros(2, dtype=np.float32)
    # Rare classes weigh as much as common ones.
    weight = (len(y) / (2 * np.bincount(y, minlength=2)))[y].astype(np.float32)
    steps, step = shape.epochs * -(-len(y) // shape.batch), 0
    for _ in range(shape.epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), shape.batch):
            own = order[k : k + shape.batch]
            at, inv = np.unique(np.concatenate([rows[i][1] for i in own]), return_inverse=True)
            x = np.zeros((len(own), len(at)), dtype=np.float32)
            x[np.repeat(np.arange(len(own)), [len(rows[i][1]) for i in own]), inv] = np.concatenate([rows[i][2] for i in own])
            hidden = x @ emb[at]
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p *= weight[own, None] / len(own)
            rate = shape.rate * (1 - step / steps)
            d_emb = x.T @ (p @ out.T)
            out -= rate * 0.1 * (hidden.T @ p)
            bias -= rate * 0.1 * p.sum(axis=0)
            emb[at] -= rate * len(at) ** 0.5 * d_emb
            step += 1
    diff = (out[:, 1] - out[:, 0]).astype(np.float64)
    return Model(emb.astype(np.float64) @ diff, float(bias[1] - bias[0]), shape)


def held_out(id_col: str, mod: int, rest: int):
    """Whether crc32 of the id as text leaves ``rest`` on division by ``mod``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", shape: Shape = Shape()) -> Model:
    """A model of at most ``shape.max_rows`` labelled rows that aren't held out.

    What reaches the driver is bounded by rows and by bytes a row; of texts that repeat an id one is taken.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col, 3, 1))
    pairs = known.select(F.col(id_col).cast("string").alias("k"), F.col(label_col).cast("int").alias("label")).distinct()
    sample = pairs.orderBy(F.xxhash64("k"), "label").limit(shape.max_rows)
    joined = docs.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("text")).join(F.broadcast(sample), "k").select("k", "label", "text")

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        own = sparse_rows(texts_of(part.column(2)), shape)
        keep = pa.array([i for i, (a, _) in enumerate(own) if len(a) <= 2 * shape.max_buckets], pa.int64())
        part = pa.record_batch([*part.columns[:2], pa.array([a for a, _ in own], pa.binary()), pa.array([b for _, b in own], pa.binary())], names=["k", "label", "bucket", "weight"])
        return part.take(keep)

    each = joined.mapInArrow(map_slices(rows, "text", 1 << 20), FEATURES).groupBy("k", "label").agg(F.min(F.struct("bucket", "weight")).alias("x"))
    data = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in each.select("label", "x.*").toLocalIterator())
    return fit([(y, np.frombuffer(a, dtype=np.uint16).astype(np.int64), np.frombuffer(b, dtype=np.float32)) for y, a, b in data], shape)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score per row; its other columns stay, an older one of that name gives way."""
    docs = docs.drop(out_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text_at, ddl = docs.columns.index(text_col), T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        s = sent.value.scores(texts_of(part.column(text_at)))
        return pa.record_batch([*part.columns, pa.array(s, pa.float64())], names=ddl.names)

    return plain(docs).mapInArrow(map_slices(one, f"c{text_at}", 1 << 20), ddl)


def op4_subword_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
