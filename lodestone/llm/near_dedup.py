"""Near duplicates by chosen-path set similarity join.

1. Every text becomes the set of its word shingles (64-bit hashes).  Texts with equal sets are one class;
   each class has a signature of minwise tokens.
2. Chosen paths: independent trees branch the classes by some of their minwise tokens, two tokens a step, so
   that a shared line alone seldom brings texts together.  Classes that chose the same tokens meet in a node.
   A node of at most ``leaf`` classes is compared exhaustively on signatures.
   In a larger node every class is held against a pivot: those alike enough are tied to it, the closest
   of them leave, all others branch on by further tokens.  By the triangle inequality of the Jaccard
   distance, a class that leaves has its links among classes tied to the same pivot.  After the last level
   all of a node is tied together.  So each link lies, but for odds that ``Params`` gives, inside a
   connected group of ties, and ties grow with the classes, not with their pairs.
3. Links are confirmed on full sets inside each group: small groups in one task, breadth first over an
   inverted index; large ones in blocks against pivots, then everything outside the largest component so found
   against all blocks, so that each pair is either compared or already connected.  Blocks give spanning forests.
4. Connected components of the confirmed links; the smallest id of each stays.

Null and empty texts have an empty set and are linked with nothing; texts of fewer words than a shingle
are one shingle.  Rows that repeat an id share its component.  A null id takes no part: its component
is null and it is kept.  Empty tables give empty results; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import by_key, cut, map_slices, release, sliced, tidy
from lodestone.llm.graph import components, hot_keys, spread
from lodestone.llm.hashing import SPACE, Buffer, mixed


@dataclass(frozen=True)
class Params:
    """Shingle length, similarity in hundredths, signature length, trees, branches of a root and of a node, leaf size, levels, group size.

    Odds at the threshold, two classes of similarity 0.8: they share a path of two tokens with probability 0.64, so
    one of 20 root branches in all but 1.4 of 10^9 cases, and one of 2 further branches in 87 of 100.  All trees use one
    signature: fewer than 45 % of its 64 tokens agree, which would keep the two untied in every leaf, with odds 1.9 in
    10^10.  A class that leaves a large node (75 % alike to its pivot) has its links at 0.55 or more to the pivot; in the
    worst case such a link misses its tie (35 %) with odds 7 in 10^4, in each tree whose node is large.
    """

    words: int = 5
    percent: int = 80
    tokens: int = 64
    trees: int = 5
    roots: int = 4
    branches: int = 2
    leaf: int = 192
    levels: int = 6
    group: int = 256
    shingles: int = 8192  # of a group that count as much as one class
    pivots: int = 32
    tie: float = 0.45  # least share of equal tokens at which two classes of a leaf are tied
    attach: float = 0.35  # ... at which a class of a large node is tied to the pivot
    leave: float = 0.75  # ... from which on it needn't branch on


#: At a similarity of 0.85: 16 root branches miss a pair with odds 1.2 in 10^9, half of the tokens with odds 9 in 10^12.
AT_85 = Params(percent=85, trees=4, tie=0.5, leave=0.7)


_ODD = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: words between ASCII white space, A-Z in lower case."""
    buf = Buffer([t.encode("utf-8", "surrogatepass") for t in texts], lower=True)
    a, b = buf.words(~SPACE)
    h = buf.spans(a, b)
    first, last = np.searchsorted(a, buf.start), np.searchsorted(a, buf.end)
    if len(h) >= n:
        s = h[: len(h) - n + 1] * _ODD[0]
        for k in range(1, n):
            s += h[k : len(h) - n + 1 + k] * _ODD[k]
        s = mixed(s)
    out = []
    for x, y in zip(first.tolist(), last.tolist()):
        if y - x >= n:
            own = np.unique(s[x : y - n + 1])
        elif y > x:
            own = mixed((h[x:y] * _ODD[: y - x]).sum(dtype=np.uint64, keepdims=True) + _ODD[100 + y - x])
        else:
            own = np.empty(0, dtype=np.uint64)
        out.append(own)
    return out


def signature(s: np.ndarray, tokens: int) -> np.ndarray:
    """For each of ``tokens`` hash functions the least 32-bit value over the set."""
    best = np.full(tokens, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(s), 4096):
        best = np.minimum(best, ((s[a : a + 4096, None] * _ODD[None, 128 : 128 + tokens]) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return best


SIGNED = "doc_id long, n long, h1 long, h2 long, sig binary"


def signed(docs: DataFrame, p: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: size and 128-bit hash of the set, and the signature (null for an empty set)."""

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets([t or "" for t in part.column(1).to_pylist()], p.words)
        hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype=np.int64).reshape(-1, 2)
        sig = [signature(s, p.tokens).tobytes() if len(s) else None for s in sets]
        return pa.record_batch([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(sig, pa.binary())], names=["doc_id", "n", "h1", "h2", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(map_slices(one, "text", 1 << 20), SIGNED)


def _sigs(col: pa.ChunkedArray | pa.Array, tokens: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint32).reshape(-1, tokens)


def _forest(alike: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each place of a symmetric matrix."""
    label = np.full(len(alike), -1)
    for i in range(len(alike)):
        if label[i] < 0:
            label[i], todo = i, [i]
            while todo:
                new = np.flatnonzero(alike[todo.pop()] & (label < 0))
                label[new] = i
                todo += new.tolist()
    return label


def _large(p: Params, last: bool):
    """Rows of large nodes (node, rep, sig, pivot, pivot's sig): ties (kind 0: pivot, rep) and branches (kind 1: node, rep, sig)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, rep, pivot = (batch.column(c).to_numpy() for c in (0, 1, 3))
            sig = _sigs(batch.column(2), p.tokens)
            share = (sig == _sigs(batch.column(4), p.tokens)).mean(axis=1)
            tied = np.flatnonzero(share >= (0 if last else p.attach))
            yield pa.record_batch([pa.array(np.zeros(len(tied), dtype=np.int32)), pa.array(pivot[tied]), pa.array(rep[tied]), pa.nulls(len(tied), pa.binary())], names=["kind", "a", "b", "sig"])
            on = np.flatnonzero(share < (0 if last else p.leave))
            key, own = node.view(np.uint64)[on], batch.column(2).take(pa.array(on))
            for j in range(p.branches):
                at = mixed(key * _ODD[110] + np.uint64(j))
                child = at * _ODD[111]
                for k in (0, 1):
                    coord = ((at >> np.uint64(16 * k)) % np.uint64(p.tokens)).astype(np.int64)
                    child = mixed(child + sig[on, coord].astype(np.uint64) * _ODD[112 + k])
                yield pa.record_batch([pa.array(np.ones(len(on), dtype=np.int32)), pa.array(child.view(np.int64)), pa.array(rep[on]), own], names=["kind", "a", "b", "sig"])

    return run


def _leaves(p: Params):
    """Ties inside each leaf, from rows sorted by its key (key, rep, n, sig)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in by_key(batches):
            rep, n, sig = t.column(1).to_numpy(), t.column(2).to_numpy(), _sigs(t.column(3), p.tokens)
            alike = (sig[:, None, :] == sig[None, :, :]).mean(axis=2) >= p.tie
            alike &= 100 * np.minimum(n[:, None], n[None, :]) >= p.percent * np.maximum(n[:, None], n[None, :])
            label = _forest(alike)
            other = np.flatnonzero(label != np.arange(len(rep)))
            a += rep[label[other]].tolist()
            b += rep[other].tolist()
            if len(a) > 50_000:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def ties(classes: DataFrame, p: Params) -> DataFrame:
    """Edges (a, b) whose connected groups hold every link between ``classes`` (rep, n, sig)."""
    place = lambda c: F.substring("sig", 4 * c + 1, 4)
    roots = [F.xxhash64(F.lit(k), place(2 * k % p.tokens), place((2 * k + 1) % p.tokens)) for k in range(p.trees * p.roots)]
    count = F.count(F.lit(1)).alias("size")
    nodes = classes.select(F.explode(F.array(*roots)).alias("node"), "rep")
    shared = cut(nodes.groupBy("node").agg(count).filter("size > 1"))
    met = cut(spread(nodes, shared, "node", hot_keys(shared, "node", "size")))
    leaves, found = [met.filter(F.col("size") <= p.leaf).select("node", "rep")], []
    # Signatures travel with the rows of large nodes alone.
    rows = met.filter(F.col("size") > p.leaf).select("node", "rep").join(classes.select("rep", "sig"), "rep").select("node", "rep", "sig")
    for level in range(p.levels):
        pivot = F.min(F.struct(F.xxhash64("node", "rep").alias("h"), F.col("rep").alias("pivot"), F.col("sig").alias("pivot_sig"))).alias("m")
        size = cut(rows.groupBy("node").agg(count, pivot).filter("size > 1").select("node", "size", "m.pivot", "m.pivot_sig"))
        met = cut(spread(rows, size, "node", hot_keys(size, "node", "size")))
        leaves.append(met.filter(F.col("size") <= p.leaf).select("node", "rep"))
        large = met.filter(F.col("size") > p.leaf).select("node", "rep", "sig", "pivot", "pivot_sig")
        if large.isEmpty():
            break
        out = cut(large.mapInArrow(_large(p, level == p.levels - 1), "kind int, a long, b long, sig binary"))
        found.append(out.filter("kind = 0").select("a", "b"))
        rows = out.filter("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("rep"), "sig")
        del size, met, large, out
        tidy(classes.sparkSession)
    members = leaves[0]
    for x in leaves[1:]:
        members = members.unionByName(x)
    # Most leaves repeat the members of another tree's leaf: each list is compared once.
    lists = members.groupBy("node").agg(F.sort_array(F.collect_set("rep")).alias("m")).filter(F.size("m") > 1).select("m").distinct()
    dealt = lists.select(F.xxhash64("m").alias("key"), F.explode("m").alias("rep")).join(classes, "rep").select("key", "rep", "n", "sig")
    out = dealt.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_leaves(p), "a long, b long")
    for x in found:
        out = out.unionByName(x)
    return out


class Overlaps:
    """Sets of a block, with the owners of every shingle."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.n, self.percent = np.array([len(s) for s in sets], dtype=np.int64), percent
        all_ = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
        order = np.argsort(all_, kind="stable")
        self.shingles, self.owner = all_[order], np.repeat(np.arange(len(sets)), self.n)[order]

    def linked(self, s: np.ndarray) -> np.ndarray:
        """Whether each set of the block is similar enough to ``s``."""
        lo, hi = np.searchsorted(self.shingles, s, "left"), np.searchsorted(self.shingles, s, "right")
        size = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        both = np.bincount(self.owner[at], minlength=len(self.n))
        return (100 * both >= self.percent * (self.n + len(s) - both)) & (both > 0)


def confirmed(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the smallest place that is reachable over links; only sets not yet reached are compared on."""
    block, label = Overlaps(sets, percent), np.full(len(sets), -1)
    for i in range(len(sets)):
        if label[i] < 0:
            label[i], todo = i, [i]
            while todo:
                if (label >= 0).all():
                    break
                new = np.flatnonzero(block.linked(sets[todo.pop()]) & (label < 0))
                label[new] = i
                todo += new.tolist()
    return label


def _unpack(col: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in col.to_pylist()]


def _small_groups(p: Params):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches):
            rep, sets = t.column(1).to_numpy(), _unpack(t.column(2))
            label = confirmed(sets, p.percent)
            yield pa.record_batch([pa.array(rep), pa.array(rep[label])], names=["node", "component"])

    return run


class Forest:
    """Sets of places that are linked, over the members of a block."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, hit: np.ndarray) -> np.ndarray:
        """One of ``hit`` for each set that it touches; these become one."""
        if not len(hit):
            return hit
        roots, first = np.unique([self.root(x) for x in hit.tolist()], return_index=True)
        self.up[roots] = roots[0]
        return hit[first]


def _blocks(p: Params):
    """A spanning forest of the links between queries and members of each block (block key, asks, rep, set; members first).

    Members are indexed, then queries stream by.  A query is tied to one member of each set that its links touch, so
    edges grow with queries and members, not with links.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, forest, rep, members, sets = None, None, None, [], np.empty(0, np.int64), []
        for batch in batches:
            keys, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int8)
            own, col = batch.column(2).to_numpy(), batch.column(3)
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(asks) != 0)) + 1
            a, b = [], []
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if x == y:
                    continue
                if keys[x] != key:
                    key, block, rep, sets = keys[x], None, [], []
                new = _unpack(col.slice(x, y - x))
                if not asks[x]:
                    rep.append(own[x:y])
                    sets += new
                    continue
                if block is None:
                    block, forest, members, sets = Overlaps(sets, p.percent), Forest(len(sets)), np.concatenate(rep) if rep else np.empty(0, np.int64), []
                for i, s in zip(own[x:y].tolist(), new):
                    if len(members):
                        hit = members[forest.join(np.flatnonzero(block.linked(s)))]
                        a.append(np.full(len(hit), i))
                        b.append(hit)
            if a:
                yield pa.record_batch([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])
        release()

    return run


def _large_groups(members: DataFrame, p: Params) -> DataFrame:
    """Components inside groups of a size over ``p.group`` (grp, rep, size, set)."""
    members = members.withColumn("blocks", F.ceil(F.col("size") / p.group).cast("int"))
    dealt = members.select(F.xxhash64("grp", F.pmod(F.xxhash64("rep"), F.col("blocks"))).alias("key"), F.lit(False).alias("asks"), "rep", "set")

    def links(queries: DataFrame) -> DataFrame:
        sent = queries.select("grp", "rep", "set", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
        sent = sent.select(F.xxhash64("grp", F.col("k").cast("long")).alias("key"), F.lit(True).alias("asks"), "rep", "set")
        return cut(dealt.unionByName(sent).repartition("key").sortWithinPartitions("key", "asks", "rep").mapInArrow(_blocks(p), "a long, b long"))

    # The hash decides who is a pivot: about p.pivots of each group, chosen without gathering it.
    share = (F.xxhash64(F.lit("pivot"), "rep").cast("double") / 2.0**64 + 0.5) * F.col("size")
    known = cut(components(links(members.filter(share < p.pivots))))
    # The largest component that pivots connect is each group's main one; all else is held against all blocks.
    of = cut(members.select("grp", "rep").join(known.withColumnRenamed("node", "rep"), "rep"))
    counts = of.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("n"))
    best = cut(counts.groupBy("grp").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component"))["component"].alias("main")))
    main = spread(of, best.drop("n"), "grp", hot_keys(best, "grp", "n")).filter("component = main").select("rep")
    outside = cut(members.join(main, "rep", "left_anti"))
    tidy(members.sparkSession)
    return components(known.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(links(outside)))


def linked_classes(docs: DataFrame, classes: DataFrame, p: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``node`` (a class's rep) and ``component`` for all classes that have a link, and some that have none."""
    groups = cut(components(ties(classes, p)).select(F.col("node").alias("rep"), F.col("component").alias("grp")).join(classes.select("rep", "n"), "rep"))
    # A group counts by its classes or by its shingles, whichever says more: long texts make a group large, too.
    count = F.count(F.lit(1))
    size = cut(groups.groupBy("grp").agg(count.alias("rows"), F.greatest(count, F.ceil(F.sum("n") / p.shingles)).cast("long").alias("size")))
    wanted = cut(spread(groups.drop("n"), size.select("grp", "size"), "grp", hot_keys(size, "grp", "rows")))

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text", 1 << 20):
                own = shingle_sets([t or "" for t in part.column(3).to_pylist()], p.words)
                yield pa.record_batch([*part.columns[:3], pa.array([s.tobytes() for s in own], pa.binary())], names=["grp", "rep", "size", "set"])

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    full = wanted.join(texts, "rep").select("grp", "rep", "size", "text").mapInArrow(sets, "grp long, rep long, size long, set binary")
    full = cut(full)
    tidy(docs.sparkSession)
    small = full.filter(F.col("size") <= p.group).select("grp", "rep", "set").repartition("grp").sortWithinPartitions("grp", "rep")
    out = small.mapInArrow(_small_groups(p), "node long, component long")
    large = full.filter(F.col("size") > p.group)
    return out if large.isEmpty() else out.unionByName(_large_groups(large, p))


def near_duplicates(docs: DataFrame, p: Params = Params(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    rows = cut(signed(docs, p, id_col, text_col))
    own = rows.filter("doc_id is not null and n > 0")
    classes = cut(own.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    # Classes that share their smallest id (an id repeated with another text) are one by definition.
    comp = linked_classes(docs, classes.select("rep", "n", "sig"), p, id_col, text_col).groupBy("node").agg(F.min("component").alias("component"))
    of = classes.select("h1", "h2", "rep").join(comp, F.col("rep") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    return (
        rows.drop("sig").join(of, ["h1", "h2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op7_chosen_path(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), AT_85)
