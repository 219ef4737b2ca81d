"""Rolling hashes of words and character n-grams over many texts at once, in numpy.

With an odd base B, ``P[i] = sum of byte_j * B^j for j < i`` (modulo 2^64) gives the hash of any span as
``(P[end] - P[start]) * B^-start``: the same bytes hash alike wherever they stand.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, kept for the process and grown by doubling."""
    p = _powers[name]
    while len(p) < n:
        p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
    _powers[name] = p
    return p[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes with all bits stirred; the low bits of a rolling hash alone are poor."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters and digits and all bytes of longer characters belong to words.
WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)


class Buffer:
    """Texts joined as bytes; ``start`` and ``end`` are each text's place."""

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        size = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64) if len(texts) else np.empty(0, np.int64)
        self.end = self.start + size
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        if lower:
            self.bytes = LOWER[self.bytes]
        n = len(self.bytes)
        # A byte counts as its value + 1: zero bytes change a hash, too.
        terms = (self.bytes.astype(np.uint64) + np.uint64(1)) * _power("up", BASE, n)
        self.sums = np.empty(n + 1, dtype=np.uint64)
        self.sums[0] = 0
        np.cumsum(terms, out=self.sums[1:])

    def grams(self, n: int) -> np.ndarray:
        """The hash of the n bytes from each position on (texts' last n - 1 positions reach beyond them)."""
        if len(self.bytes) < n:
            return np.empty(0, dtype=np.uint64)
        return mixed((self.sums[n:] - self.sums[:-n]) * _power("down", INVERSE, len(self.bytes) - n + 1) + np.uint64(n))

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The hashes of the bytes from ``a`` to ``b``."""
        return mixed((self.sums[b] - self.sums[a]) * _power("down", INVERSE, len(self.bytes) + 1)[a])

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes that ``inside`` (by byte value) holds; runs end where texts do."""
        mark = inside[self.bytes]
        mark[self.end] = False  # the line feed after each text
        edge = np.diff(np.concatenate([[0], mark.view(np.int8), [0]]))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def sums_between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of values[a:b] for each pair, each added up on its own."""
    if not len(a):
        return np.zeros(0)
    padded = np.append(values, 0.0)
    out = np.add.reduceat(padded, np.column_stack([a, np.maximum(b, a)]).ravel())[::2]
    return np.where(b > a, out, 0.0)
