import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import graph
from lodestone.llm import near_dedup as nd
from lodestone.llm.graph import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def corpus(words):
    rng = random.Random(9)
    rows, line = [], " ".join(words(12, 1))
    for g in range(120):
        base = words(rng.randint(3, 160), 100 + g)
        for _ in range(rng.choice([1, 1, 1, 2, 4, 30 if g % 40 == 0 else 1])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                own[rng.randrange(len(own))] = rng.choice(["new", "Other", "w%d" % rng.randrange(99)])
            rows.append((line + "\n" if g % 2 else "") + "  ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("p", [nd.AT_85, nd.Params(percent=85, leaf=8, group=6, pivots=2, levels=3)])
def test_equals_brute_force(spark, words, p):
    rows = corpus(words)
    got = sorted(map(tuple, nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()))
    assert got == brute(rows)


def test_odd_rows(spark, odd):
    got = nd.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[None].component_id is None and by[None].kept
    assert all((by[i].n_shingles, by[i].component_id, by[i].kept) == (0, i, True) for i in (1, 2, 3))
    assert by[4].n_shingles == by[6].n_shingles == 1 and by[6].component_id == 6
    assert nd.near_duplicates(odd.limit(0)).count() == 0


def test_shingles_of_short_texts():
    a, b, c, d, e = nd.shingle_sets(["A b c d e", "a B  c\td\ne", "a b c d e f", "a b", ""])
    assert a.tolist() == b.tolist() and set(a) < set(c) and len(c) == 2 and len(d) == 1 and not len(e)
    assert nd.shingle_sets(["x y z 1 2"])[0].tolist() != nd.shingle_sets(["x y z 1 2"])[0].tolist()


def test_blocks_give_forests():
    """Members and queries that are all linked: one edge a query, and one for each member that joins the others."""
    base = np.arange(1000, dtype=np.uint64)
    rows = [(7, False, i, base.tobytes()) for i in range(50)] + [(7, True, 100 + i, base.tobytes()) for i in range(30)]
    rows += [(8, True, 5, base.tobytes())] + [(9, False, 1, base.tobytes()), (9, False, 2, (base + 5000).tobytes()), (9, True, 3, (base + 5000).tobytes()), (9, True, 4, (base + 9000).tobytes())]
    batch = pa.RecordBatch.from_pylist([dict(zip(("key", "asks", "rep", "set"), r)) for r in rows])
    for size in (1000, 7, 1):
        got = pa.Table.from_batches(nd._blocks(nd.Params())(batch.slice(a, size) for a in range(0, len(rows), size)))
        edges = list(zip(got["a"].to_pylist(), got["b"].to_pylist()))
        assert len(edges) == 50 + 29 + 1 and edges[-1] == (3, 2)
        assert {b for _, b in edges[:50]} == set(range(50)) and {a for a, _ in edges[49:-1]} == set(range(100, 130)) | {100}


def test_spread_joins_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(graph, "FLOOR", 10)
    left = spark.createDataFrame([(0 if i % 2 else i, i) for i in range(400)], "k long, x long")
    right = spark.createDataFrame([(i, -i) for i in range(0, 400, 4)], "k long, y long")
    hot = graph.hot_keys(left.groupBy("k").count(), "k", "count")
    assert hot.keys.collect() == [(0,)] and hot.total == 400 and graph.hot_keys(right.groupBy("k").count(), "k", "count").keys is None
    for how in ("inner", "left"):
        assert sorted(map(str, graph.spread(left, right, "k", hot, how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_smallest_reachable():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60):
        u, v = rng.integers(0, 50, (2, n))
        node, label = graph.smallest_reachable(u, v)
        want = {x: x for x in (*u.tolist(), *v.tolist())}
        for _ in range(n):
            for a, b in zip(u.tolist(), v.tolist()):
                want[a] = want[b] = min(want[a], want[b])
        assert dict(zip(node.tolist(), label.tolist())) == want


@pytest.mark.parametrize("block", [1 << 19, 64])
def test_components(spark, monkeypatch, block):
    """In one block, and by stars with hot nodes."""
    monkeypatch.setattr(graph, "FLOOR", 16)
    monkeypatch.setattr(graph, "BLOCK", block)
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)] + [(2000, 2001 + i) for i in range(90)] + [(2500, 2001 + i) for i in range(0, 90, 2)]
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got.get(x, x) == label[x] for x in label)
