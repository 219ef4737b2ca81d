"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments; each has a mean and a deviation.  Per segment of w components,
Cauchy-Schwarz on the centred parts bounds the squared distance of two vectors from below by
w * ((mean difference)^2 + (deviation difference)^2), and with the vectors' norms that bounds their inner
product from above.  Bounds are tried coarse to fine (4, 16, then 32 segments); only the survivors' exact
integer products are computed.  What a query must beat is its k-th best exact score so far; before the scan that
is its k-th best among a bounded sample of the candidates.  A level that a task has seen prune next to nothing is
left out for the next chunks: the bounds are there to save products, the result is exact without any.

Vectors that are null, empty, of another dimension than most queries' or that hold null or non-finite
components take no part.  Components become ``floor(256 x)``.  Ties go to the smaller id.  Rows that repeat an id
are rows of their own: each is a query with k results, and of the candidates only the query's own row is left
out.  Empty tables give empty results.

Queries are read in blocks of bounded size, each sent to all candidate partitions in a job of its own; every
task keeps k + 1 rows a query and Spark merges them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut

FOUND = "query long, query_id long, vec_id long, score long, own boolean"
_FOUND_ARROW = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("own", pa.bool_())])


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id`` and ``v``, the components as whole numbers; rows without a finite vector are left out."""
    x = F.col(vec_col)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return (
        df.filter(x.isNotNull() & (F.size(x) > 0) & F.col(id_col).isNotNull() & ~F.exists(x, bad))
        .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"))
    )


def matrix(col: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows of dimension ``dim`` as a matrix, and which rows they are."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(n == (dim if dim is not None else (n[0] if len(n) else 0)))
    return col.take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).reshape(len(keep), -1), keep


class Resolution:
    """Segment sums that turn bounds for all pairs of two sets of vectors into one matrix product."""

    def __init__(self, dim: int, segments: int) -> None:
        self.cuts = np.unique(np.linspace(0, dim, min(segments, dim) + 1).astype(int))
        self.width = np.diff(self.cuts)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """sqrt(width) * (means, deviations) by segment."""
        total = np.add.reduceat(x, self.cuts[:-1], axis=1)
        squares = np.add.reduceat(x * x, self.cuts[:-1], axis=1)
        mean = total / self.width
        dev = np.sqrt(np.maximum(squares / self.width - mean * mean, 0))
        return np.hstack([mean, dev]) * np.sqrt(np.hstack([self.width, self.width]))


def dots(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Products of pairs of rows, in slices."""
    return np.concatenate([np.einsum("ij,ij->i", a[rows[k : k + 65536]], b[cols[k : k + 65536]]) for k in range(0, len(rows), 65536)] or [np.empty(0)])


class TopK:
    """The best k candidates of each query, over blocks of candidates.

    ``floor``: a score that each query's k-th best is known to reach.  ``pairs``, ``tried`` and ``exact`` count what the
    bounds were asked and what was left to multiply.
    """

    def __init__(self, q: np.ndarray, k: int, levels: tuple[int, ...] = (4, 16, 32), floor: np.ndarray | None = None) -> None:
        self.q, self.k = q, k
        self.levels = [Resolution(q.shape[1], s) for s in levels]
        self.stats = [r(q) for r in self.levels]
        self.norm = (q * q).sum(axis=1)
        self.floor = np.full(len(q), -np.inf) if floor is None else floor
        self.score = np.full((len(q), k), -np.inf)
        self.vec = np.full((len(q), k), np.iinfo(np.int64).max)
        self.exact = self.pairs = 0
        self.asked, self.cut = np.zeros(len(levels)), np.zeros(len(levels))

    def _survivors(self, x: np.ndarray) -> np.ndarray:
        """Pairs (query, candidate) that no bound excludes, as a matrix of truth values."""
        norm = (x * x).sum(axis=1)
        least = np.maximum(self.floor, self.score[:, -1]) - 1e-9 * (self.norm + norm.max(initial=0)) - 1e-6
        alive, known = np.ones((len(self.q), len(x)), dtype=bool), bool(np.isfinite(least).all())
        for i, level in enumerate(self.levels):
            # Tried at first and at every 16th chunk, else only where it has paid.
            if self.asked[i] and self.cut[i] < 0.05 * self.asked[i] and self.chunks % 16:
                continue
            before = int(alive.sum())
            # Half of (|q|^2 + |x|^2 - lower bound of the squared distance) >= q.x; the distance bound is |sq - sx|^2.
            if before * 8 > alive.size:
                alive &= self.stats[i] @ level(x).T >= least[:, None]
            else:
                rows, cols = np.nonzero(alive)
                alive[rows, cols] = dots(self.stats[i], level(x), rows, cols) >= least[rows]
            if known:
                self.asked[i] += before
                self.cut[i] += before - int(alive.sum())
        self.chunks += known
        return alive

    chunks = 0

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        alive = self._survivors(x)
        rows, cols = np.nonzero(alive)
        self.pairs += alive.size
        self.exact += len(rows)
        # Exact products of the survivors: where they are dense, by one product of the rows and columns that have any.
        score = (self.q @ x.T)[rows, cols] if len(rows) * 8 > alive.size else dots(self.q, x, rows, cols)
        keep = score >= np.maximum(self.floor, self.score[:, -1])[rows]
        rows, cols, score = rows[keep], cols[keep], score[keep]
        if not len(rows):
            return
        all_rows = np.concatenate([np.repeat(np.arange(len(self.q)), self.k), rows])
        all_score = np.concatenate([self.score.ravel(), score])
        all_vec = np.concatenate([self.vec.ravel(), ids[cols]])
        order = np.lexsort((all_vec, -all_score, all_rows))
        starts = np.searchsorted(all_rows[order], np.arange(len(self.q)))
        pick = order[starts[:, None] + np.arange(self.k)]
        self.score, self.vec = all_score[pick], all_vec[pick]

    def rows(self, ids: np.ndarray, first: int) -> pa.RecordBatch:
        """What was found; ``first`` is the first query's number.  ``own``: as if the query's own row."""
        r, c = np.nonzero(np.isfinite(self.score))
        own = (self.vec[r, c] == ids[r]) & (self.score[r, c] == self.norm[r])
        return pa.record_batch([pa.array(first + r), pa.array(ids[r]), pa.array(self.vec[r, c]), pa.array(self.score[r, c].astype(np.int64)), pa.array(own)], schema=_FOUND_ARROW)


def _scan(block, k: int, chunk: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, floor, first = block.value
        top = TopK(q, k, floor=floor)
        for batch in batches:
            for a in range(0, batch.num_rows, chunk):
                part = batch.slice(a, chunk)
                x, keep = matrix(part.column(1), q.shape[1])
                if len(x):
                    top.add(part.column(0).to_numpy()[keep], x)
        yield top.rows(ids, first)

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, *, block: int = 4096, chunk: int = 2048, seeds: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best candidates of each query row.

    Both have ``vec_id`` and ``v`` (see ``integer_vectors``); queries are rows of ``candidates``, too, or of ids that it has not.
    ``block`` queries at a time (block x dimension doubles: the bound on what is broadcast) meet all
    candidates; ``seeds`` candidates at most are read beforehand for the scores that a query must beat.
    """
    spark = candidates.sparkSession
    parts: list[DataFrame] = []
    sample: dict[int, list] = {}
    for row in candidates.select("v").limit(seeds).collect():
        sample.setdefault(len(row[0]), []).append(row[0])

    def flush(ids: list[int], vecs: list, first: int) -> None:
        q = np.array(vecs, dtype=np.float64)
        floor = np.full(len(q), -np.inf)
        if len(seen := sample.get(q.shape[1], [])) > k:
            floor = -np.partition(-(q @ np.array(seen, dtype=np.float64).T), k, axis=1)[:, k]
        send = spark.sparkContext.broadcast((np.array(ids, dtype=np.int64), q, floor, first))
        parts.append(cut(candidates.select("vec_id", "v").mapInArrow(_scan(send, k + 1, chunk), FOUND)))
        send.destroy()

    held: dict[int, tuple[list, list]] = {}  # by dimension
    n = 0
    for row in queries.select("vec_id", "v").toLocalIterator():
        ids, vecs = held.setdefault(len(row[1]), ([], []))
        ids.append(row[0])
        vecs.append(row[1])
        if sum(len(x) for x, _ in held.values()) == block:
            for ids, vecs in held.values():
                flush(ids, vecs, n)
                n += len(ids)
            held = {}
    for ids, vecs in held.values():
        flush(ids, vecs, n)
        n += len(ids)
    found = parts[0] if parts else spark.createDataFrame([], FOUND)
    for part in parts[1:]:
        found = found.unionByName(part)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k + 1)
    # One row that looks like the query's own is it; rows that are equal to it stay.
    own = F.min(F.when(F.col("own"), F.col("place"))).over(Window.partitionBy("query"))
    rank = F.col("place") - F.when(F.col("place") > F.col("own_place"), 1).otherwise(0)
    ranked = best.withColumn("own_place", own).filter("own_place IS NULL OR place <> own_place").withColumn("rank", rank.cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_segment_topk(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors, 5)
