"""Connected components of an edge list, and joins that split hot keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, release, tidy

#: A key is hot if it holds this share of all rows, so that there are at most so many; below FLOOR rows none is.
HOT_KEYS, FLOOR = 4096, 256
#: Edges that one task contracts at a time (16 bytes each).
BLOCK = 1 << 19
#: Rows that are worth a task of their own.
ROWS = 2000


@dataclass(frozen=True)
class Hot:
    """Keys that hold at least a 4096th of ``total`` rows (none: no frame)."""

    keys: DataFrame | None
    total: int


def hot_keys(counted: DataFrame, key: str, n: str) -> Hot:
    """The hot keys of ``counted``, a frame computed already in which each key stands once and ``n`` counts its rows."""
    total, most = counted.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    least = max(FLOOR, -(-total // HOT_KEYS))
    return Hot(counted.filter(F.col(n) >= least).select(key) if most >= least else None, total)


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, a union, in no more partitions than a shuffle makes (else each step over it would add to them), or than its rows need."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(most if rows is None else max(1, min(most, -(-rows // ROWS))))


def spread(left: DataFrame, right: DataFrame, key: str, hot: Hot, how: str = "inner") -> DataFrame:
    """``left`` joined (inner or left) with ``right``, in which a key stands once, without gathering a hot key's rows.

    The rows of hot keys stay where they are and meet the few rows of ``right`` that belong to them by broadcast
    (4096 at most, as a hot key holds a 4096th of ``left``); all others are joined by the key.
    """
    if hot.keys is None:
        return few(left.join(right, key, how), hot.total)
    keys = F.broadcast(hot.keys)
    light = left.join(keys, key, "left_anti").join(right, key, how)
    heavy = left.join(keys, key, "left_semi").join(F.broadcast(right.join(keys, key, "left_semi")), key, how)
    return few(light.unionByName(heavy), hot.total)


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of an edge list, and for each the smallest one that its edges reach."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a task as stars: each node points to the smallest that the task's edges reach, block by block."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def stars() -> tuple[np.ndarray, np.ndarray]:
        node, root = smallest_reachable(*(np.concatenate(x) for x in zip(*held)))
        return node[node != root], root[node != root]

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
        if size >= 2 * BLOCK:
            u, v = stars()
            held, size = [(u, v)], len(u)
            if size >= BLOCK:  # hardly anything in common: on to the next block
                yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])
                held, size = [], 0
    if held:
        u, v = stars()
        yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])
    release()


def _mark(e: DataFrame) -> tuple[int, int]:
    row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``edges`` (a, b: long).

    Every round first contracts blocks of about half a million edges, each in one task, to stars; where there is one
    block, that is all.  Else large and small stars alternate over all edges, which point from the larger to the smaller
    end.  Large star: each edge's smaller end gives way to that end's own smallest neighbour; small star: all smaller
    neighbours of a node point to the smallest of them.  The joins split nodes of very many edges; edges are cut after
    every step.  Loops and repeated edges change nothing.
    """
    e = cut(few(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    mark, n = None, e.count()
    while n:
        blocks = -(-n // BLOCK)
        e = cut(e.coalesce(blocks).mapInArrow(_contract, "u long, v long"))
        if blocks == 1:
            break
        e = cut(e.distinct())
        down = cut(e.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
        up = e.groupBy("u").agg(F.min("v").alias("m"))
        large = cut(spread(e, up.withColumnRenamed("u", "v"), "v", hot_keys(down, "v", "n"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = spread(large, low, "u", hot_keys(low, "u", "n")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(few(small.unionByName(low.select("u", F.col("m").alias("v")))).distinct())
        before, mark = mark, _mark(e)
        n = mark[0]
        del up, down, large, low, small
        tidy(edges.sparkSession)
        if mark == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
