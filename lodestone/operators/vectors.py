"""Exact nearest neighbours of float vectors by cosine, in blocks of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.staging import staged


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): vectors that aren't null or empty, without null or non-finite components, and not of length 0."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(vec_col)
    rows = df.filter(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v")).filter(F.exists("v", lambda x: x != 0))


class Best:
    """The ``k`` best candidates of each query, ties to the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.sim = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, sim: np.ndarray, ids: np.ndarray) -> None:
        """``sim``: a row a query, a column a candidate.  Only what reaches a query's last place is sorted."""
        rows, cols = np.nonzero((sim >= self.sim[:, -1:]) & (sim > -np.inf))
        if not len(rows):
            return
        every = np.concatenate([np.repeat(np.arange(len(self.sim)), self.k), rows])
        all_sim, all_id = np.concatenate([self.sim.ravel(), sim[rows, cols]]), np.concatenate([self.id.ravel(), ids[cols]])
        order = np.lexsort((all_id, -all_sim, every))
        pick = order[np.searchsorted(every[order], np.arange(len(self.sim)))[:, None] + np.arange(self.k)]
        self.sim, self.id = all_sim[pick], all_id[pick]


FOUND = "query long, query_id long, neighbour_id long, cosine double"


def _near(sent, k: int, chunk: int):
    def run(batches):
        first, ids, q = sent.value
        best = Best(len(ids), k)
        for batch in batches:
            size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(size == q.shape[1])
            for a in range(0, len(at), chunk):
                own = pa.array(at[a : a + chunk])
                m = batch.column(1).take(own).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                theirs = batch.column(0).take(own).to_numpy()
                sim = q @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T
                sim[ids[:, None] == theirs[None, :]] = -np.inf
                best.add(sim, theirs)
        r, c = np.nonzero(np.isfinite(best.sim))
        yield pa.record_batch([pa.array(first + r), pa.array(ids[r]), pa.array(best.id[r, c]), pa.array(best.sim[r, c])], names=["query", "query_id", "neighbour_id", "cosine"])

    return run


def cosine_neighbours(queries: DataFrame, corpus: DataFrame, k: int, block: int = 4096, chunk: int = 1024) -> DataFrame:
    """(query_id, rank, neighbour_id, cosine) of the ``k`` nearest corpus vectors of other ids, for each row of ``queries``.

    Both are ``usable``; rows that repeat an id are queries of their own.  ``block`` queries at a time (the bound on what
    is broadcast) meet every partition of the corpus in a job of its own; a task holds ``block`` x ``chunk`` similarities
    and keeps k rows a query.
    """
    spark = corpus.sparkSession
    parts: list[DataFrame] = []
    n, held = 0, {}

    def flush() -> None:
        nonlocal n, held
        for ids, vecs in held.values():
            q = np.array(vecs)
            sent = spark.sparkContext.broadcast((n, np.array(ids, dtype=np.int64), q / np.linalg.norm(q, axis=1, keepdims=True)))
            parts.append(staged(corpus.select("id", "v").mapInArrow(_near(sent, k, chunk), FOUND)))
            sent.destroy()
            n += len(ids)
        held = {}

    for row in queries.select("id", "v").toLocalIterator():
        ids, vecs = held.setdefault(len(row[1]), ([], []))
        ids.append(row[0])
        vecs.append(row[1])
        if sum(len(x) for x, _ in held.values()) == block:
            flush()
    flush()
    found = parts[0] if parts else spark.createDataFrame([], FOUND)
    for part in parts[1:]:
        found = found.unionByName(part)
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "cosine")
