"""Gradient-boosted regression trees for two classes, by histograms that tasks hold and add up.

The rule is that of Spark's ``GBTClassifier`` (log loss 2 log(1 + exp(-2yF)), trees of least variance, the first one on the
labels and the others on the gradient, early stop by the validation rows).  There a level of a tree is a job that reads all
rows again; here the rows' bins go once to one barrier stage, whose tasks keep them and share only sums by node, feature and bin.
"""

from __future__ import annotations

import json
import math
import secrets
import socket
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bins of a feature, combined bins of a column that holds several, points of a sketch, rows of a chunk.
BINS, JOINT, POINTS, CHUNK = 64, 4096, 256, 65_536
#: Tasks of the barrier stage at most, and rows that are worth one.
TASKS, TASK_ROWS = 64, 50_000
#: A row counts 1 and a positive one this much more, so one sum has both numbers.
_POS = float(1 << 26)


@dataclass
class Trees:
    """Trees as lists by node: feature (-1 at a leaf), threshold, left child (the right one follows), value, gain."""

    nodes: list[dict[str, list]]
    shares: list[float]
    width: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sums of the trees for rows of features (a row a feature)."""
        out = np.zeros(x.shape[1])
        for t, share in zip(self.nodes, self.shares):
            f, cut, left, value = np.array(t["feature"]), np.array(t["threshold"]), np.array(t["left"]), np.array(t["value"])
            at, rows = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
            for _ in range(t["depth"]):
                inner = f[at] >= 0
                right = ~(x[f[at], rows] <= cut[at])
                at = np.where(inner, left[at] + right, at)
            out += share * value[at]
        return out

    def importances(self) -> np.ndarray:
        """Shares of the features in the gains, each tree counted alike."""
        total = np.zeros(self.width)
        for t in self.nodes:
            own = np.zeros(self.width)
            for f, gain in zip(t["feature"], t["gain"]):
                if f >= 0:
                    own[f] += gain
            total += own / (own.sum() or 1.0)
        return total / (total.sum() or 1.0)

    def score(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """``rows`` with ``prob``, the float probability of class 1."""
        nodes, shares, width = self.nodes, self.shares, self.width

        def run(batches):
            model = Trees(nodes, shares, width)
            for b in batches:
                prob = 1 / (1 + np.exp(-2 * model.margin(_values(b, columns))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prob.astype(np.float32))], names=[*b.schema.names, "prob"])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("prob", T.FloatType())]))


def _values(b: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    x = np.empty((len(columns), b.num_rows))
    for i, c in enumerate(columns):
        x[i] = b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
    return x


def _sketch(value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most ``POINTS`` of the values (in order), each with the number of rows up to it from the one before."""
    if len(value) <= POINTS:
        return value, n
    ends = np.cumsum(n)
    at = np.unique(np.searchsorted(ends, ends[-1] * np.arange(1, POINTS + 1) / POINTS).clip(0, len(value) - 1))
    return value[at], np.diff(ends[at], prepend=0)


def edges(rows: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """Of each feature the thresholds between its bins, by the quantiles of all rows."""

    def sketches(batches):
        held, n = [], 0

        def out():
            for i in range(len(columns)):
                v, k = _sketch(*np.unique(np.concatenate([x[i] for x in held]), return_counts=True))
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64())), pa.array([k.tolist()], pa.list_(pa.int64()))], names=["feature", "value", "n"])

        for b in batches:
            held.append(_values(b, columns))
            n += b.num_rows
            if n >= 8 * CHUNK:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    def merged(t: pa.Table) -> pa.Table:
        v, k = (np.concatenate([x.values.to_numpy() for x in t[c].combine_chunks()]) for c in ("value", "n"))
        value, back = np.unique(v, return_inverse=True)
        n = np.bincount(back, weights=k)
        if len(value) <= BINS:
            cuts = (value[1:] + value[:-1]) / 2
        else:
            ends = np.cumsum(n)
            cuts = np.unique(value[np.searchsorted(ends, ends[-1] * np.arange(1, BINS) / BINS)])
            cuts = cuts[cuts < value[-1]]
        return pa.table({"feature": t["feature"][:1], "cuts": pa.array([cuts[~np.isnan(cuts)].tolist()], pa.list_(pa.float64()))})

    found = rows.select(*columns).mapInArrow(sketches, "feature int, value array<double>, n array<long>").groupBy("feature").applyInArrow(merged, "feature int, cuts array<double>")
    out = {r.feature: np.array(r.cuts, np.float64) for r in found.collect()}
    return [out.get(i, np.zeros(0)) for i in range(len(columns))]


def _layout(sizes: list[int]) -> list[list[int]]:
    """The features of each column: the largest ones with the smallest ones, up to ``JOINT`` combined bins."""
    out: list[list[int]] = []
    for f in sorted(range(len(sizes)), key=lambda f: (-sizes[f], f)):
        for own in out:
            if math.prod(sizes[x] for x in own) * sizes[f] <= JOINT:
                own.append(f)
                break
        else:
            out.append([f])
    return out


def train(rows: DataFrame, columns: list[str], label: str, is_val: str, weight: float, params, slots: int) -> tuple[Trees, float]:
    """(trees, the mean loss of the validation rows); a positive row weighs ``weight``."""
    cuts = edges(rows, columns)
    sizes = [len(c) + 1 for c in cuts]
    layout = _layout(sizes)

    def packed(batches):
        from pyspark import TaskContext

        part, held, n, k = TaskContext.get().partitionId(), [], 0, 0

        def out():
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([n], pa.int32()), pa.array([np.concatenate(held, axis=1).tobytes()], pa.binary())], names=["part", "k", "n", "bins"])

        for b in batches:
            x = _values(b, columns)
            bins = np.zeros((len(layout) + 1, b.num_rows), np.uint16)
            for c, own in enumerate(layout):
                for f in own:
                    bins[c] = bins[c] * sizes[f] + np.searchsorted(cuts[f], x[f], side="left").astype(np.uint16)
            y, v = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.uint16) for c in (label, is_val))
            bins[-1] = y + 2 * v
            held.append(bins)
            n += b.num_rows
            if n >= CHUNK:
                yield out()
                held, n, k = [], 0, k + 1
        if n:
            yield out()

    chunks = rows.select(*columns, label, is_val).mapInArrow(packed, "part int, k int, n int, bins binary")

    def boost(batches):
        got = sorted((r["part"], r["k"], r["n"], r["bins"]) for b in batches for r in b.to_pylist())
        task = _Task(got, sizes, layout, weight, params, _Ring(BarrierTaskContext.get()))
        del got
        out = task.run([c.tolist() for c in cuts])
        if BarrierTaskContext.get().partitionId() == 0:
            yield pa.record_batch([pa.array([json.dumps(out)])], names=["model"])

    tasks = max(1, min(slots, TASKS))
    found = json.loads(chunks.repartition(tasks).mapInArrow(boost, "model string", barrier=True).collect()[0][0])
    return Trees(found["nodes"], found["shares"], len(columns)), found["loss"]


class _Ring:
    """Sums of arrays over the tasks of a barrier stage: the first task adds up, in order, and answers the others.

    Spark's own gathering takes a second a call; it is used once, to say where the first task listens.
    """

    def __init__(self, context: BarrierTaskContext) -> None:
        self.rank, hosts = context.partitionId(), [x.address.rsplit(":", 1)[0] for x in context.getTaskInfos()]
        self.others: list = [None] * (len(hosts) - 1)
        self.first = None
        if len(hosts) == 1:
            return
        if self.rank == 0:
            listener, token = socket.create_server(("", 0), backlog=len(hosts)), secrets.token_hex(16)
            context.allGather(f"{listener.getsockname()[1]} {token}")
            listener.settimeout(300)
            while None in self.others:
                s, _ = listener.accept()
                s.settimeout(300)
                f = s.makefile("rwb")
                said = f.read(40)
                if len(said) == 40 and said[:32] == token.encode() and 0 < int(said[32:]) < len(hosts):
                    self.others[int(said[32:]) - 1] = self._open(s, f)
            listener.close()
        else:
            port, token = context.allGather("")[0].split()
            s = socket.create_connection((hosts[0], int(port)), timeout=300)
            self.first = self._open(s, s.makefile("rwb"))
            self.first.write(token.encode() + b"%8d" % self.rank)
            self.first.flush()

    @staticmethod
    def _open(s: socket.socket, f):
        s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        s.settimeout(3600)
        return f

    @staticmethod
    def _read(f, like: np.ndarray) -> np.ndarray:
        got = f.read(like.nbytes)
        if len(got) != like.nbytes:
            raise ConnectionError("a task of the stage has gone")
        return np.frombuffer(got, np.float64).reshape(like.shape)

    def added(self, own: np.ndarray) -> np.ndarray:
        own = np.ascontiguousarray(own, np.float64)
        if self.first is not None:
            self.first.write(own.tobytes())
            self.first.flush()
            return self._read(self.first, own)
        for f in self.others:
            own = own + self._read(f, own)
        for f in self.others:
            f.write(own.tobytes())
            f.flush()
        return own


class _Task:
    """The rows of a task, and the trees that all tasks grow alike."""

    def __init__(self, chunks: list[tuple], sizes: list[int], layout: list[list[int]], weight: float, params, ring: _Ring) -> None:
        self.sizes, self.layout, self.weight, self.params, self.ring = sizes, layout, weight, params, ring
        n = sum(c[2] for c in chunks)
        self.seeds = [(c[0], c[1], c[2]) for c in chunks]
        self.bins = [np.empty(n, np.uint16) for _ in range(len(layout) + 1)]
        at = 0
        for _, _, k, blob in chunks:
            for own, x in zip(self.bins, np.frombuffer(blob, np.uint16).reshape(-1, k)):
                own[at : at + k] = x
            at += k
        flag = self.bins.pop()
        self.positive, self.val = (flag & 1).astype(bool), flag > 1
        self.place = {f: (c, math.prod(sizes[x] for x in own[i + 1 :])) for c, own in enumerate(layout) for i, f in enumerate(own)}
        self.margin = np.zeros(n)
        self.code = np.where(self.positive, 1 + _POS, 1.0)
        self.held = np.flatnonzero(self.val)

    def added(self, own: np.ndarray) -> np.ndarray:
        """The sum over all tasks."""
        return self.ring.added(own)

    def sums(self, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
        """(count, weight, target) by feature and bin of some rows."""
        out = np.zeros((3, len(self.sizes), max(self.sizes)))
        code, want = self.code[rows], target[rows]
        for own, column in zip(self.layout, self.bins):
            dims = [self.sizes[f] for f in own]
            at = column[rows].astype(np.int64)
            both, value = (np.bincount(at, weights=w, minlength=math.prod(dims)).reshape(dims) for w in (code, want))
            positive = np.floor(both / _POS)
            count = both - positive * _POS
            for i, f in enumerate(own):
                other = tuple(k for k in range(len(own)) if k != i)
                for k, x in enumerate((count, count + positive * (self.weight - 1), value)):
                    out[k, f, : dims[i]] = x.sum(other)
        return out

    def split(self, s: np.ndarray, features: np.ndarray) -> tuple[float, int, int] | None:
        """(gain, feature, last bin to the left) of the best split of a node."""
        total = s[:, 0].sum(-1)
        left = np.cumsum(s[:, features, :-1], -1)
        right = total[:, None, None] - left
        least = max(self.params.min_rows, 1)
        good = (left[0] >= least) & (right[0] >= least)
        if not good.any():
            return None
        gain = np.full(good.shape, -np.inf)
        gain[good] = left[2][good] ** 2 / left[1][good] + right[2][good] ** 2 / right[1][good] - total[2] ** 2 / total[1]
        best = int(np.argmax(gain))
        if gain.flat[best] <= 1e-9 * total[1]:
            return None
        return float(gain.flat[best]), int(features[best // gain.shape[1]]), best % gain.shape[1]

    def tree(self, round_: int, target: np.ndarray, share: float, cuts: list[list[float]]) -> dict:
        """Grows a tree and adds it to the margins of all rows."""
        p = self.params
        drawn = np.concatenate([np.random.default_rng([p.seed, round_, a, b]).random(n, np.float32) < p.row_share for a, b, n in self.seeds] or [np.zeros(0, bool)])
        drawn &= ~self.val
        try:
            some = max(1, math.ceil(float(p.column_share) * len(self.sizes)))
        except ValueError:
            some = len(self.sizes)
        out = {"feature": [-1], "threshold": [0.0], "left": [0], "value": [0.0], "gain": [0.0], "depth": 0}
        level = [(0, np.arange(len(self.val), dtype=np.int32))]
        known: dict[int, np.ndarray] = {}
        build, derived = [0], {}
        for depth in range(p.max_depth + 1):
            at = dict(level)
            if build:
                own = self.added(np.stack([self.sums(r[drawn[r]], target) for r in (at[i] for i in build)]))
                known |= dict(zip(build, own))
            for i, (parent, twin) in derived.items():
                known[i] = known[parent] - known[twin]
            following, build, derived = [], [], {}
            for i, rows in level:
                s = known[i]
                n, w, v = s[:, 0].sum(-1)
                out["value"][i] = float(v / w) if n > 0.5 else 0.0
                features = np.sort(np.random.default_rng([p.seed, round_, i, 1]).permutation(len(self.sizes))[:some])
                best = self.split(s, features) if depth < p.max_depth and n > 0.5 else None
                if best is None:
                    self.margin[rows] += share * out["value"][i]
                    continue
                gain, f, last = best
                c, stride = self.place[f]
                goes = (self.bins[c][rows] // np.uint16(stride)) % np.uint16(self.sizes[f]) <= last
                a = len(out["feature"])
                out["feature"][i], out["threshold"][i], out["left"][i], out["gain"][i] = f, cuts[f][last], a, gain
                for key, empty in (("feature", -1), ("threshold", 0.0), ("left", 0), ("value", 0.0), ("gain", 0.0)):
                    out[key] += [empty, empty]
                following += [(a, rows[goes]), (a + 1, rows[~goes])]
                few = a if s[0, f, : last + 1].sum() * 2 <= n else a + 1
                build.append(few)
                derived[2 * a + 1 - few] = (i, few)
                out["depth"] = depth + 1
            level = following
            if not level:
                break
        return out

    def loss(self) -> float:
        y = np.where(self.positive[self.held], 1.0, -1.0)
        w = np.where(self.positive[self.held], self.weight, 1.0)
        total, weight = self.added(np.array([(w * 2 * np.logaddexp(0, -2 * y * self.margin[self.held])).sum(), w.sum()]))
        return float(total / weight) if weight else math.nan

    def run(self, cuts: list[list[float]]) -> dict:
        p = self.params
        y = np.where(self.positive, 1.0, -1.0)
        w = np.where(self.positive, self.weight, 1.0)
        nodes, shares, best, keep = [], [], math.inf, 0
        for m in range(p.max_iter):
            target = y * w if m == 0 else w * 4 * y / (1 + np.exp(np.clip(2 * y * self.margin, -700, 700)))
            shares.append(1.0 if m == 0 else p.step)
            nodes.append(self.tree(m, target, shares[-1], cuts))
            now = self.loss()
            if math.isnan(now):
                keep = m + 1
            elif m > 0 and best - now < p.tolerance * max(now, 0.01):
                break
            elif now < best:
                best, keep = now, m + 1
        return {"nodes": nodes[:keep], "shares": shares[:keep], "loss": best if best < math.inf else None}


def slots(rows: DataFrame, n: int) -> int:
    """Tasks that can run side by side, and are worth it for ``n`` rows."""
    sc = rows.sparkSession.sparkContext
    inner = sc._jsc.sc()
    side = inner.maxNumConcurrentTasks(inner.resourceProfileManager().defaultResourceProfile())
    return max(1, min(int(side) or sc.defaultParallelism, -(-n // TASK_ROWS)))


__all__ = ["Trees", "edges", "slots", "train"]
