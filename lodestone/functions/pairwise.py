"""Similarities of many pairs of texts at once: the same values as ``similarity``, a step a letter for all pairs together.

A text is a pattern of bits, a word of 64 letters at a time; pairs of as many words go through the bit-parallel rules
(Hyyro's and Myers') as columns of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Pairs of a step, and words of a table of patterns.
PAIRS, TABLE = 8192, 1 << 21
_ONE, _ALL = np.uint64(1), np.uint64(0xFFFF_FFFF_FFFF_FFFF)
_TOP = np.uint64(63)
#: What the pattern ``\s`` of Java takes for a space.
JAVA_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


class Letters:
    """Texts as rows of letters, numbered from 1 in an alphabet; 0 behind the end."""

    def __init__(self, texts: list[str], known: np.ndarray) -> None:
        self.size = np.array([len(t) for t in texts], np.int64)
        self.row = np.zeros((len(texts), max(1, self.size.max(initial=0))), np.uint32)
        self.row[np.arange(self.row.shape[1]) < self.size[:, None]] = np.searchsorted(known, points(texts)) + 1
        self.letters = len(known) + 1


def points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _low(n: np.ndarray, words: int) -> list[np.ndarray]:
    """Words with the lowest ``n`` bits set."""
    out = []
    for w in range(words):
        k = np.clip(n - 64 * w, 0, 64).astype(np.uint64)
        out.append(np.where(k == 64, _ALL, (_ONE << (k & _TOP)) - _ONE))
    return out


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    out, carry = [], None
    for x, y in zip(a, b):
        s = x + y
        over = s < x
        if carry is not None:
            s = s + carry
            over |= s < carry
        carry = over.astype(np.uint64)
        out.append(s)
    return out


class Steps:
    """Some pairs, longest text first: at each letter of the text, the bits of the pattern where it stands."""

    def __init__(self, pattern: Letters, p: np.ndarray, text: Letters, t: np.ndarray, words: int) -> None:
        self.words, self.text_size = words, text.size[t]
        (own, p), (used, t) = (np.unique(x, return_inverse=True) for x in (p, t))
        rows, n = pattern.row[own], pattern.letters
        table = np.zeros((words, len(own) * n), np.uint64)
        for j in range(int(pattern.size[own].max(initial=0))):
            some = np.flatnonzero(rows[:, j])
            table[j // 64][some * n + rows[some, j]] |= _ONE << np.uint64(j % 64)
        self.table, self.base, self.t = table, p * n, t
        self.spot = np.ascontiguousarray(text.row[used, : int(self.text_size.max(initial=0))].T)
        self.active = np.searchsorted(-self.text_size, -np.arange(1, int(self.text_size.max(initial=0)) + 1), side="right")

    def __iter__(self) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """(letter, number of pairs that have it, words of the pattern's bits)."""
        for j, k in enumerate(self.active.tolist()):
            at = self.base[:k] + self.spot[j][self.t[:k]]
            yield j, k, [w[at] for w in self.table]


def _parts(pattern: Letters, p: np.ndarray, text: Letters, t: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(pairs, words) of a like number of words, longest text first, few enough for a table."""
    words = np.maximum(1, -(-pattern.size[p] // 64))
    for w in np.unique(words).tolist():
        own = np.flatnonzero(words == w)
        todo = [own[i : i + PAIRS] for i in range(0, len(own), PAIRS)]
        while todo:
            some = todo.pop()
            rows = np.unique(p[some])
            if len(some) > 1 and len(rows) > 1 and len(rows) * pattern.letters * w > TABLE:
                some = some[np.argsort(p[some], kind="stable")]
                todo += [some[: len(some) // 2], some[len(some) // 2 :]]
                continue
            yield some[np.argsort(-text.size[t[some]], kind="stable")], w


def _count(words: list[np.ndarray]) -> np.ndarray:
    return sum(np.bitwise_count(w).astype(np.int64) for w in words)


def distance(a: Letters, l: np.ndarray, b: Letters, r: np.ndarray) -> np.ndarray:
    """Levenshtein distances of the texts ``l`` of ``a`` and ``r`` of ``b``."""
    out = np.zeros(len(l), np.int64)
    for own, n in _parts(a, l, b, r):
        size = a.size[l[own]]
        score = np.where(size == 0, b.size[r[own]], size)
        up, down = [np.full(len(own), _ALL) for _ in range(n)], [np.zeros(len(own), np.uint64) for _ in range(n)]
        last = ((size - 1) & 63).astype(np.uint64)
        for _, k, eq in Steps(a, l[own], b, r[own], n):
            pv, mv = [x[:k] for x in up], [x[:k] for x in down]
            xh = [(s ^ p) | e for s, p, e in zip(_add([e & p for e, p in zip(eq, pv)], pv), pv, eq)]
            ph = [m | ~(x | p) for m, x, p in zip(mv, xh, pv)]
            mh = [p & x for p, x in zip(pv, xh)]
            change = ((ph[-1] >> last[:k]) & _ONE).astype(np.int64) - ((mh[-1] >> last[:k]) & _ONE).astype(np.int64)
            score[:k] += np.where(size[:k] > 0, change, 0)
            c, d = _ONE, np.uint64(0)
            for w in range(n):
                x, p, m = eq[w] | mv[w], (ph[w] << _ONE) | c, (mh[w] << _ONE) | d
                c, d = ph[w] >> _TOP, mh[w] >> _TOP
                up[w][:k], down[w][:k] = m | ~(x | p), p & x
        out[own] = score
    return out


def common(a: Letters, l: np.ndarray, b: Letters, r: np.ndarray, keep_a: np.ndarray | None = None, keep_b: np.ndarray | None = None) -> np.ndarray:
    """Lengths of longest common subsequences; ``keep_a``, ``keep_b``: words of the letters of a pair that count."""
    out = np.zeros(len(l), np.int64)
    for own, n in _parts(a, l, b, r):
        full = _low(a.size[l[own]], n)
        state = [np.full(len(own), _ALL) for _ in range(n)]
        kept = None if keep_a is None else [keep_a[own, w] for w in range(n)]
        for j, k, eq in Steps(a, l[own], b, r[own], n):
            if kept is not None:
                on = np.uint64(0) - ((keep_b[own[:k], j // 64] >> np.uint64(j % 64)) & _ONE)
                eq = [e & x[:k] & on for e, x in zip(eq, kept)]
            s = [x[:k] for x in state]
            both = [x & e for x, e in zip(s, eq)]
            for w, x in enumerate(_add(s, both)):
                state[w][:k] = x | (s[w] & ~both[w])
        out[own] = _count([~s & f for s, f in zip(state, full)])
    return out


def indel(a: Letters, l: np.ndarray, b: Letters, r: np.ndarray) -> np.ndarray:
    n = a.size[l] + b.size[r]
    return np.where(n > 0, 2 * common(a, l, b, r) / np.maximum(n, 1), 1.0)


def jaro_winkler(a: Letters, l: np.ndarray, b: Letters, r: np.ndarray) -> np.ndarray:
    """Of texts that differ: equal ones have no rule of their own here."""
    out = np.zeros(len(l))
    for own, n in _parts(b, r, a, l):
        x, y = l[own], r[own]
        la, lb = a.size[x], b.size[y]
        reach = np.maximum(la, lb) // 2 - 1
        taken = [np.zeros(len(own), np.uint64) for _ in range(n)]
        hit = np.zeros((int(la.max(initial=0)), len(own)), bool)
        for i, k, eq in Steps(b, y, a, x, n):
            hi, lo = _low(np.clip(i + reach[:k] + 1, 0, lb[:k]), n), _low(np.clip(i - reach[:k], 0, None), n)
            found = np.zeros(k, bool)
            for w in range(n):
                free = eq[w] & hi[w] & ~lo[w] & ~taken[w][:k]
                free = np.where(found, np.uint64(0), free)
                taken[w][:k] |= free & (np.uint64(0) - free)
                found |= free != 0
            hit[i, :k] = found
        m = _count(taken)
        who, i = np.nonzero(hit.T)
        bits = np.unpackbits(np.stack(taken, 1).view(np.uint8), axis=1, bitorder="little")
        j = np.nonzero(bits)[1]
        swapped = np.bincount(who, weights=a.row[x[who], i] != b.row[y[who], j], minlength=len(own)).astype(np.int64) // 2
        some = m > 0
        one, la, lb = np.where(some, m, 1), np.maximum(la, 1), np.maximum(lb, 1)
        jaro = np.where(some, (m / la + m / lb + (m - swapped) / one) / 3, 0.0)
        w = min(4, a.row.shape[1], b.row.shape[1])
        p, q = a.row[x, :w], b.row[y, :w]
        start = np.cumprod((p == q) & (p > 0), axis=1).sum(1)
        out[own] = np.where(jaro > 0.7, jaro + start * 0.1 * (1 - jaro), jaro)
    return out


class Words:
    """The distinct words of texts in order, joined by a space: numbers, sizes and the letters of each."""

    def __init__(self, texts: list[str], known: np.ndarray, number: dict[str, int]) -> None:
        words = [sorted(set(t.split())) for t in texts]
        self.n = np.array([len(w) for w in words], np.int64)
        most = max(1, self.n.max(initial=0))
        self.letters = Letters([" ".join(w) for w in words], known)
        self.code, self.size = np.full((len(texts), most), -1, np.int64), np.zeros((len(texts), most), np.int64)
        for i, w in enumerate(words):
            self.code[i, : len(w)] = [number.setdefault(x, len(number)) for x in w]
            self.size[i, : len(w)] = [len(x) for x in w]
        self.start = np.cumsum(self.size + 1, axis=1) - self.size - 1
        self.words = max(1, -(-self.letters.row.shape[1] // 64))

    def kept(self, at: np.ndarray, only: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words of bits, length) of the words ``only`` of the texts ``at``, joined by a space."""
        bits = np.zeros((len(at), self.words), np.uint64)
        first = np.ones(len(at), bool)
        for k in range(only.shape[1]):
            some = np.flatnonzero(only[:, k])
            if not len(some):
                continue
            s, e = self.start[at[some], k], self.start[at[some], k] + self.size[at[some], k]
            s = s - ~first[some]
            for w, (x, y) in enumerate(zip(_low(e, self.words), _low(s, self.words))):
                bits[some, w] |= x & ~y
            first[some] = False
        return bits, _count(list(bits.T))


def token_set(x: Words, l: np.ndarray, y: Words, r: np.ndarray) -> np.ndarray:
    out = np.zeros(len(l))
    for i in range(0, len(l), PAIRS):
        out[i : i + PAIRS] = _token_set(x, l[i : i + PAIRS], y, r[i : i + PAIRS])
    return out


def _token_set(x: Words, l: np.ndarray, y: Words, r: np.ndarray) -> np.ndarray:
    a, b = x.code[l, : x.n[l].max(initial=1)], y.code[r, : y.n[r].max(initial=1)]
    in_b, in_a = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for k in range(b.shape[1]):
        same = (a == b[:, k, None]) & (a >= 0)
        in_b |= same
        in_a[:, k] = same.any(1)
    (bits_x, only_x), (bits_y, only_y) = x.kept(l, (a >= 0) & ~in_b), y.kept(r, (b >= 0) & ~in_a)
    shared = in_b.sum(1)
    n = (x.size[l, : a.shape[1]] * in_b).sum(1) + np.maximum(shared - 1, 0)
    space = (shared > 0).astype(np.int64)
    out = np.zeros(len(l))
    none = (x.n[l] == 0) | (y.n[r] == 0)
    whole = ~none & (shared > 0) & ((only_x == 0) | (only_y == 0))
    out[whole] = 1.0
    rest = np.flatnonzero(~none & ~whole)
    s = common(x.letters, l[rest], y.letters, r[rest], bits_x[rest], bits_y[rest])
    n, space = n[rest], space[rest]
    nx, ny = n + space + only_x[rest], n + space + only_y[rest]
    best = 2 * (n + space + s) / np.maximum(nx + ny, 1)
    best = np.where(space > 0, np.maximum(best, np.maximum(2 * n / (n + nx), 2 * n / (n + ny))), best)
    out[rest] = best
    return out


def similarities(left: list[str], l: np.ndarray, right: list[str], r: np.ndarray):
    """A function of pairs (numbers of ``l`` and of ``r``) to the six features of ``similarity.string_features``, in their order.

    ``left`` and ``right``: distinct texts; ``l`` and ``r``: the texts of the rows that pairs name.
    """
    place = {t: i for i, t in enumerate(left)}
    twin = np.array([place.get(t, -1) for t in right], np.int64)
    known = np.unique(np.concatenate([points(left), points(right), points([" "])]))
    a, b = Letters(left, known), Letters(right, known)
    in_order = lambda texts: Letters([" ".join(sorted(w for w in JAVA_SPACE.split(t) if w)) for t in texts], known)
    sa, sb = in_order(left), in_order(right)
    number: dict[str, int] = {}
    wa, wb = Words(left, known, number), Words(right, known, number)

    def values(p: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
        x, y = l[p], r[q]
        pair, back = np.unique(x * len(right) + y, return_inverse=True)
        x, y = pair // len(right), pair % len(right)
        same = twin[y] == x
        other = np.flatnonzero(~same)
        x, y = x[other], y[other]
        longest = np.maximum(np.maximum(a.size[x], b.size[y]), 1)
        out = []
        for v in (1 - distance(a, x, b, y) / longest, jaro_winkler(a, x, b, y), indel(sa, x, sb, y), token_set(wa, x, wb, y), np.abs(a.size[x] - b.size[y]) / longest):
            full = np.ones(len(pair)) if len(out) < 4 else np.zeros(len(pair))
            full[other] = v
            out.append(full[back].astype(np.float32))
        return [*out, same[back].astype(np.int8)]

    return values
