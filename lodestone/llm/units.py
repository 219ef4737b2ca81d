"""Token ids of texts, put together from the remembered ids of their units (words, as a rule)."""

from __future__ import annotations

import numpy as np

from lodestone.llm.common import release


class UnitCache:
    """Ids as packed little-endian unsigned 32-bit integers.

    ``split`` gives the units whose ids, joined, are the text's, or None for a text to be encoded
    ``whole``; ``learn`` fills in the ids of new units.  There are two generations of about ``most``
    units; those in use move to the young one, and the old one is dropped when the young one is full.
    """

    _open: dict[tuple[type, str], UnitCache] = {}

    def __init__(self, most: int = 320_000) -> None:
        self.most, self.units, self.old = most, {}, {}

    @classmethod
    def of(cls, path: str):
        """One per process and vocabulary; Spark reuses its Python processes."""
        if (cls, path) not in cls._open:
            cls._open[cls, path] = cls(path)
        return cls._open[cls, path]

    def split(self, text: str) -> list[str] | None:
        raise NotImplementedError

    def whole(self, text: str) -> bytes:
        raise NotImplementedError

    def learn(self, new: set[str]) -> None:
        raise NotImplementedError

    def store(self, tok, units: list[str], keys: list[str] | None = None) -> None:
        """Encodes each unit apart and remembers its ids (under its key)."""
        for a in range(0, len(units), 8192):
            part = units[a : a + 8192]
            e = tok.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.asarray(e.ids, dtype="<u4").tobytes()
            at = (4 * np.searchsorted(np.asarray(e.word_ids, dtype=np.int64), np.arange(len(part) + 1))).tolist()
            for w, x, y in zip((keys or units)[a : a + 8192], at, at[1:]):
                self.units[w] = ids[x:y]

    def end(self) -> None:
        """At the end of a partition only the young generation stays."""
        self.old = {}
        release()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        new = set().union(*[s for s in split if s])
        if len(self.units) > self.most:
            self.old, self.units = self.units, {}
        new.difference_update(self.units)
        if kept := new & self.old.keys():
            self.units.update((w, self.old[w]) for w in kept)
            new -= kept
        if new:
            self.learn(new)
        get = self.units.__getitem__
        return [self.whole(t) if s is None else b"".join(map(get, s)) for t, s in zip(texts, split)]
