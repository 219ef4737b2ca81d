"""Candidates of blocks of queries: each block meets the candidate lists of its keys in one task.

A join of query keys with index keys has a row for every shared key of every pair, and summing them deals all those
rows out again.  Here a block of queries of like names gets the list of each of its keys once, scores come from
counting in memory, and only what is answered leaves the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.staging import staged

#: Query keys of a block, about, and pairs of an output batch.
BLOCK_KEYS, BATCH = 32_768, 16_384
_CLASS, _SIDE, _ASK = 0, 1, 2


def rows(asked: DataFrame, near: DataFrame, index: DataFrame, key: list[str], left: DataFrame | None = None, right: DataFrame | None = None, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """What the blocks read, each in one task: classes of candidates, then looked-up rows of the queries, then query keys by query.

    ``asked``: (*key, strategy, weight, entity_id); ``near``: (entity_id, *columns), queries of near values share a block;
    ``index``: (*key, entity_id); ``left``, ``right``: lookups by entity_id with the same columns.

    A class is the candidates with the same asked keys and looked-up rows; a block gets it once, however many keys they share.
    """
    lists = staged(index.groupBy(*key).agg(F.collect_list("entity_id").alias("ids"))).withColumn("kid", F.monotonically_increasing_id())
    q = staged(asked.join(lists.select(*key, "kid"), key).select("entity_id", "strategy", "kid", F.col("weight").cast("int").alias("weight")))
    n = max(1, -(-q.count() // block_keys))
    by = [c for c in near.columns if c != "entity_id"]
    # Partitions by range are sampled: only once they are staged is a row's block settled.
    q = staged(q.join(near, "entity_id").repartitionByRange(n, *by, "entity_id").select(F.spark_partition_id().alias("block"), "entity_id", "strategy", "kid", "weight"))
    # The blocks of a key, and so of a class, as bits: no row is made for a candidate of a key in a block.
    places = staged(q.groupBy("kid", F.shiftright("block", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, block & 63)")).alias("bits")))
    listed = lists.select("kid", "ids").join(places.select("kid").distinct(), "kid", "left_semi")
    classes = listed.select("kid", F.explode_outer("ids").alias("entity_id")).groupBy("entity_id").agg(F.sort_array(F.collect_list("kid")).alias("kids"))
    same = ["kids"]
    if right is not None:
        own = right.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct(*(c for c in right.columns if c != "entity_id")))).alias("rows"))
        classes, same = classes.join(own, "entity_id", "left"), ["kids", "rows"]
    classes = staged(classes.groupBy(*same).agg(F.collect_list("entity_id").alias("ids"))).withColumn("class", F.monotonically_increasing_id())
    at = classes.select("class", F.explode_outer(F.array_distinct("kids")).alias("kid")).join(places, "kid").groupBy("class", "word").agg(F.bit_or("bits").alias("bits"))
    block = F.explode_outer(F.expr("transform(filter(sequence(0, 63), i -> (shiftright(bits, i) & 1) = 1), i -> cast(word * 64 + i as int))"))
    kinds = [classes.join(at, "class").select(block.alias("block"), *same, "ids").withColumn("kind", F.lit(_CLASS)), q.withColumn("kind", F.lit(_ASK))]
    if left is not None:
        kinds.append(q.select("block", "entity_id").distinct().join(left, "entity_id").withColumn("kind", F.lit(_SIDE)))
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k, allowMissingColumns=True)
    first = ["block", "kind", "kid", *same, "ids", "entity_id", "strategy", "weight"]
    most = q.agg(F.max("block")).first()[0] or 0
    return out.select(*first, *(c for c in out.columns if c not in first)).repartitionById(max(n, most + 1), F.col("block")).sortWithinPartitions("block", "kind", "entity_id")


def _by_block(batches) -> Iterator[pa.Table]:
    held, now = [], None
    for b in batches:
        if not b.num_rows:
            continue
        at = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and at[lo] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = at[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _ramp(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... ``size[0]`` times, then the same of the others."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


class _Side:
    """Looked-up rows of the ids of one side, by the id's number ``at``; an id may have several."""

    def __init__(self, table: pa.Table, at: np.ndarray, n: int) -> None:
        order = np.argsort(at, kind="stable")
        self.table = table.take(pa.array(order))
        self.n = np.bincount(at, minlength=n)
        self.start = np.cumsum(self.n) - self.n
        self.truth = None


class _Block:
    def __init__(self, table: pa.Table) -> None:
        kind = table["kind"].to_numpy()
        a, b = np.searchsorted(kind, [_SIDE, _ASK])
        classes, sides, asked = table.slice(0, a), table.slice(a, b - a), table.slice(b)
        ids, kids = _one(classes["ids"]), _one(classes["kids"])
        n_ids, n_kids = _sizes(ids), _sizes(kids)
        found = ids.flatten()
        order = pc.sort_indices(found)  # numbers in the order of ids: ties go to the smaller one
        self.candidates = found.take(order)
        number = np.empty(len(order), np.int64)
        number[order.to_numpy()] = np.arange(len(order))
        # The list of a key: the candidates of all classes that have it, as often as they do.
        kid = asked["kid"].to_numpy()
        known = np.unique(kid)
        flat = kids.flatten().to_numpy()
        own = np.flatnonzero(np.isin(flat, known))
        of = np.repeat(np.arange(len(n_kids)), n_kids)[own]
        at = np.repeat(np.searchsorted(known, flat[own]), n_ids[of])
        self.codes = number[_ramp((np.cumsum(n_ids) - n_ids)[of], n_ids[of])][np.argsort(at, kind="stable")]
        self.size = np.bincount(at, minlength=len(known))
        self.end = np.cumsum(self.size)
        self.at = np.searchsorted(known, kid)
        self.weight = asked["weight"].to_numpy()
        self.strategy = _one(asked["strategy"]).dictionary_encode()
        who = _one(asked["entity_id"]).dictionary_encode()
        self.queries = who.dictionary
        row = who.indices.to_numpy()
        self.first = [*np.flatnonzero(np.diff(row, prepend=-1)).tolist(), len(row)]
        self.left = self.right = None
        if "rows" in table.column_names:
            self.left = _Side(sides, pc.index_in(_one(sides["entity_id"]), value_set=self.queries).to_numpy(zero_copy_only=False), len(self.queries))
            held = _one(classes["rows"])
            n_rows, flat = _sizes(held), held.flatten()
            of = np.repeat(np.arange(len(n_ids)), n_ids)
            looked = pa.Table.from_arrays(flat.flatten(), names=[f.name for f in flat.type]).take(pa.array(_ramp((np.cumsum(n_rows) - n_rows)[of], n_rows[of])))
            self.right = _Side(looked, np.repeat(number, n_rows[of]), len(number))
            if "truth" in sides.column_names:
                both = pa.concat_arrays([_one(x.table["truth"]) for x in (self.left, self.right)]).dictionary_encode()
                truth = pc.fill_null(both.indices, -1).to_numpy(zero_copy_only=False)
                self.left.truth, self.right.truth = np.split(truth, [self.left.table.num_rows])

    def shared(self, at: np.ndarray) -> np.ndarray:
        """The candidates of some lists, one after the other."""
        return np.concatenate([self.codes[e - n : e] for e, n in zip(self.end[at].tolist(), self.size[at].tolist())]) if len(at) else self.codes[:0]

    def answers(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, candidates, scores), the best first; queries of the same keys are scored once."""
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        n = len(self.candidates)
        for i, (a, b) in enumerate(zip(self.first, self.first[1:])):
            order = np.argsort(self.at[a:b], kind="stable")
            at = self.at[a:b][order]
            if (key := at.tobytes()) not in known:
                sums = np.bincount(self.shared(at), weights=np.repeat(self.weight[a:b][order], self.size[at]), minlength=n)
                hit = np.flatnonzero(sums)
                rank = hit - sums[hit].astype(np.int64) * n
                if len(rank) > most:
                    best = np.argpartition(rank, most - 1)[:most]
                    hit, rank = hit[best], rank[best]
                hit = hit[np.argsort(rank)]
                known[key] = hit, sums[hit].astype(np.int64)
            yield i, *known[key]

    def expanded(self, query: np.ndarray, candidate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, left row, right row): every pair with each looked-up row of both ids."""
        nr = self.right.n[candidate]
        total = self.left.n[query] * nr
        pair = np.repeat(np.arange(len(query)), total)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(total) - total, total)
        return pair, self.left.start[query][pair] + k // nr[pair], self.right.start[candidate][pair] + k % nr[pair]

    def true(self, query: np.ndarray, candidate: np.ndarray, e=None) -> np.ndarray:
        """Whether any rows of both ids have the same truth."""
        pair, l, r = e or self.expanded(query, candidate)
        a = self.left.truth[l]
        return np.bincount(pair, weights=(a == self.right.truth[r]) & (a >= 0), minlength=len(query)) > 0


def top(spec: DataFrame, most: int, judged: bool, extra: list[str], measure: tuple[str, Callable] | None = None) -> DataFrame:
    """The ``most`` best candidates of each query of ``rows``: (source1_entity_id, candidate_entity_id, score, rank), ``label``
    if ``judged``, and ``extra`` columns of both sides as l_ and r_, a row for each pair of looked-up rows.

    ``measure``: a column's name (or several columns as "name type, ...") and what makes, of the looked-up tables of a block, a
    function of left and right row numbers to its values (or a list of them): the looked-up columns then need not leave the task.
    """
    fields = "source1_entity_id string, candidate_entity_id string, score long, rank int" + (", label byte" if judged else "")
    several = bool(measure) and " " in measure[0]
    fields += f", {measure[0]}{'' if several else ' double'}" if measure else ""
    schema = T.StructType([*T._parse_datatype_string(fields).fields, *(T.StructField(f"{p}_{c}", spec.schema[c].dataType) for p in "lr" for c in extra)])

    def batch(b: _Block, held: list, measured: Callable | None) -> pa.RecordBatch:
        query = np.concatenate([np.full(len(c), i) for i, c, _ in held])
        rank = np.concatenate([np.arange(1, 1 + len(c), dtype=np.int32) for _, c, _ in held])
        candidate, score = (np.concatenate([x[k] for x in held]) for k in (1, 2))
        e = b.expanded(query, candidate) if judged or extra or measure else None
        cols = [query, candidate, score, rank, *([b.true(query, candidate, e).astype(np.int8)] if judged else [])]
        if extra or measure:
            found = measured(*e[1:]) if measure else []
            cols = [c[e[0]] for c in cols] + (found if several or not measure else [found])
        out = [b.queries.take(pa.array(cols[0])), b.candidates.take(pa.array(cols[1])), *map(pa.array, cols[2:])]
        out += [_one(side.table[c].take(pa.array(at))) for side, at in ((b.left, e and e[1]), (b.right, e and e[2])) for c in extra]
        return pa.record_batch(out, names=schema.names)

    def run(batches):
        for table in _by_block(batches):
            b, held, n = _Block(table), [], 0
            measured = measure[1](b.left.table, b.right.table) if measure else None
            for answer in b.answers(most):
                held.append(answer)
                n += len(answer[1])
                if n >= BATCH:
                    yield batch(b, held, measured)
                    held, n = [], 0
            if held:
                yield batch(b, held, measured)

    return spec.mapInArrow(run, schema)


def by_strategy(spec: DataFrame) -> DataFrame:
    """(strategy, candidate_pairs, recalled_pairs) of each strategy alone and of all together (``union``), without a cap; the
    lookups of ``rows`` have ``truth``."""

    def run(batches):
        for table in _by_block(batches):
            b = _Block(table)
            names = [*b.strategy.dictionary.to_pylist(), "union"]
            strategy = b.strategy.indices.to_numpy()
            count = np.zeros((len(names), 2), np.int64)
            for i, (lo, hi) in enumerate(zip(b.first, b.first[1:])):
                own = strategy[lo:hi]
                for k in range(len(names)):
                    at = b.at[lo:hi] if k == len(names) - 1 else b.at[lo:hi][own == k]
                    hit = np.flatnonzero(np.bincount(b.shared(at), minlength=len(b.candidates)))
                    if len(hit):
                        count[k] += len(hit), int(b.true(np.full(len(hit), i), hit).sum())
            some = np.flatnonzero(count[:, 0])
            yield pa.record_batch([pa.array([names[k] for k in some], pa.string()), pa.array(count[some, 0]), pa.array(count[some, 1])], names=["strategy", "candidate_pairs", "recalled_pairs"])

    found = spec.mapInArrow(run, "strategy string, candidate_pairs long, recalled_pairs long")
    return found.groupBy("strategy").agg(F.sum("candidate_pairs").alias("candidate_pairs"), F.sum("recalled_pairs").alias("recalled_pairs"))
