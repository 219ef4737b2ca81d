"""Licence scans: a trained paragraph classifier, confirmed against templates.

A paragraph is a run of lines that aren't blank.  Single lines of a longer paragraph, and runs of its lines that
each look like a licence, are looked at, too: so a one-line notice is found beside prose, and a notice wrapped at any width.
The features are hashed word 1- to 3-grams; a sparse softmax regression over licence families and a class ``unknown``
is trained in numpy on variations of the families' own wording (whole, edited, cut into lines) and on paragraphs of the
corpus that share no word trigram with any template (a bounded sample).  How improbable ``unknown`` must be for a
piece to be believed a licence is calibrated on held-out variations and paragraphs.

A believed piece is confirmed by the templates.  Long ones: four fifths of the shorter side's word trigrams agree.
Short notices: one sentence holds all of one and not much else; after a notice of three words or less the sentence ends
(so "All rights reserved by the hotel for refusing guests" is none).  Where another family's template agrees better (the
licences of one publisher differ in a number), that family is reported.  A long template's hit speaks for the whole
paragraph or run, a short one's for the smallest piece that holds it.

Whole texts are scanned.  Null and empty texts have no paragraph and no licence.  Equal texts give equal rows,
repeated rows stay, null ids stay null; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_slices, texts_of
from lodestone.llm.hashing import SPACE, WORD, Buffer, mixed

# Customary wording by which works are put under the common licences.
NOTICES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, without warranties or conditions of any kind, either express or implied.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "has waived all copyright and related or neighboring rights to this work"),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3.",
    ),
    "LGPL-3.0": (
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Proprietary": (
        "All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "This document is confidential and proprietary.",
    ),
}
# Names of the licences in running text, and their registered short names.
NAMES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "the GNU AGPL v3"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License"),
    "CC-BY-4.0": ("CC BY 4.0", "the Creative Commons Attribution 4.0 License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 License"),
    "CC0-1.0": ("CC0 1.0", "the CC0 1.0 Universal dedication"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU GPL v2", "the GPLv2"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU GPL v3", "the GPLv3"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "the GNU LGPL v3"),
    "MIT": ("the MIT License", "the MIT Licence", "an MIT License"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"),
}
VERBS = ("Licensed under", "Released under", "Distributed under", "Available under", "Under the terms of")
TEMPLATES: dict[str, tuple[str, ...]] = {
    f: (*NOTICES[f], *(f"{v} {n}" for n in NAMES.get(f, ()) for v in VERBS), *(f"{v} {f}" for v in ("SPDX-License-Identifier:", "License:", "Licence:") if f in NAMES)) for f in NOTICES
}
FAMILIES = ["unknown", *TEMPLATES]


@dataclass(frozen=True)
class Params:
    bits: int = 13
    grams: int = 3
    variations: int = 24  # of each template
    negatives: int = 4000  # paragraphs of the corpus in the sample, at most
    longest: int = 4000  # characters; longer paragraphs are left out of the sample (not out of scanning)
    short: int = 10  # words up to which a template counts as short
    epochs: int = 20
    rate: float = 12.0
    decay: float = 1e-5
    false_rate: float = 0.0005  # of unknown held-out paragraphs believed, at most
    contained: float = 0.8  # share of the shorter side's trigrams that must agree
    seed: int = 3


def word_hashes(texts: list[bytes]) -> tuple[Buffer, np.ndarray, np.ndarray]:
    """The texts, the places of their words and the words' hashes."""
    buf = Buffer(texts, lower=True)
    a, b = buf.words(WORD)
    return buf, a, buf.spans(a, b)


def grams_of(h: np.ndarray, unit: np.ndarray, p: Params) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n the hashes of the word n-grams inside units (``unit`` of each word, ascending), with their unit."""
    out = []
    for n in range(1, min(p.grams, len(h)) + 1):
        g = h[: len(h) - n + 1] * np.uint64(2 * n + 1)
        for k in range(1, n):
            g = mixed(g + h[k : len(h) - n + 1 + k] + np.uint64(k))
        same = unit[: len(unit) - n + 1] == unit[n - 1 :]
        out.append((mixed(g)[same], unit[: len(unit) - n + 1][same]))
    return out


def one_piece(text: str, p: Params) -> list[tuple[np.ndarray, np.ndarray]]:
    """The n-grams of a text taken as one piece."""
    _, a, h = word_hashes([text.encode("utf-8", "surrogatepass")])
    return grams_of(h, np.zeros(len(a), dtype=np.int64), p)


def trigrams(text: str, p: Params) -> np.ndarray:
    """Distinct hashes of the word trigrams of a text; of fewer words, of the longest n-gram."""
    return np.unique(next((h for h, _ in reversed(one_piece(text, p)) if len(h)), np.empty(0, dtype=np.uint64)))


def line_places(buf: Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line, and the number of its paragraph (blank lines have one of their own)."""
    end = np.flatnonzero(buf.bytes == 10)  # line feeds, those after the texts among them
    start = np.concatenate([[0], end[:-1] + 1]).astype(np.int64)
    solid = np.concatenate([[0], np.cumsum(~SPACE[buf.bytes])])
    blank = solid[end] == solid[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = blank[1:] | blank[:-1]
    new[np.searchsorted(start, buf.start)] = True
    return start, end, np.cumsum(new) - 1


_SENTENCE = re.compile(r"(?<=[.;!?])\s+")
_WORDS = re.compile(r"[^\W_]+")


@dataclass
class Model:
    weight: np.ndarray  # buckets x classes
    bias: np.ndarray
    least: float
    p: Params

    def __post_init__(self) -> None:
        self.long: list[list[np.ndarray]] = [[] for _ in FAMILIES]
        self.short: list[list[list[str]]] = [[] for _ in FAMILIES]
        for family, texts in TEMPLATES.items():
            for t in texts:
                words = _WORDS.findall(t.lower())
                if len(words) <= self.p.short:
                    self.short[FAMILIES.index(family)].append(words)
                else:
                    self.long[FAMILIES.index(family)].append(trigrams(t, self.p))

    def probabilities(self, grams: list[tuple[np.ndarray, np.ndarray]], units: int) -> np.ndarray:
        """The classes' probabilities of each unit; those without words are unknown."""
        logits, n = np.zeros((units, len(FAMILIES))), np.zeros(units)
        for _, unit in grams:
            n += np.bincount(unit, minlength=units)
        for h, unit in grams:
            at = (h >> np.uint64(64 - self.p.bits)).astype(np.int64)
            for a in range(0, len(at), 1 << 18):
                rows = unit[a : a + (1 << 18)]
                first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                logits[rows[first]] += np.add.reduceat(self.weight[at[a : a + (1 << 18)]], first, axis=0)
        z = logits / np.maximum(n, 1)[:, None] ** 0.5 + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        prob = e / e.sum(axis=1, keepdims=True)
        prob[n == 0] = np.eye(len(FAMILIES))[0]
        return prob

    def scan(self, texts: list[str]) -> tuple[list[list[tuple[int, int, str, float, float]]], list[int]]:
        """Per text: (start, end, family, probability, agreement) of each confirmed piece, in code points; its number of paragraphs."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        buf, at, h = word_hashes(raw)
        start, end, para = line_places(buf)
        line = np.searchsorted(end, at)
        lines = self.probabilities(grams_of(h, line, self.p), len(start))
        whole = self.probabilities(grams_of(h, para[line], self.p), int(para[-1]) + 1) if len(start) else lines
        first = np.flatnonzero(np.diff(para, prepend=-1))  # the first line of each paragraph
        last = np.append(first[1:], len(para)) - 1
        believed = lambda prob: 1 - prob[:, 0] >= self.least
        pieces = [(k, k, lines[k]) for k in np.flatnonzero(believed(lines)).tolist()]
        pieces += [(int(first[k]), int(last[k]), whole[k]) for k in np.flatnonzero(believed(whole) & (last > first)).tolist()]
        like = np.append(lines[:, 0] < 0.5, False)
        edges = np.flatnonzero(like[1:-1] & (~like[:-2] | (para[1:] != para[:-1]))) + 1 if len(para) > 1 else np.empty(0, np.int64)
        for k in ([0] if len(para) and like[0] else []) + edges.tolist():
            j = k
            while like[j + 1] and para[j + 1] == para[k]:
                j += 1
            if j > k and (k, j) != (first[para[k]], last[para[k]]):
                prob = self.probabilities(one_piece(buf.bytes[start[k] : end[j]].tobytes().decode("utf-8", "replace"), self.p), 1)
                if believed(prob)[0]:
                    pieces.append((k, j, prob[0]))
        found: list[list] = [[] for _ in texts]
        for k, j, prob in pieces:
            family, agree, long, same = self.confirmed(buf.bytes[start[k] : end[j]].tobytes().decode("utf-8", "replace"), prob)
            if family:
                found[int(np.searchsorted(buf.start, start[k], side="right")) - 1].append((-same, end[j] - start[k], start[k], end[j], family, long, agree, prob))
        out = []
        for doc, hits in enumerate(found):
            taken: list[tuple] = []
            # The piece that shares most with a template goes first; of equal ones the smallest.
            for _, _, a, b, family, long, agree, prob in sorted(hits, key=lambda x: x[:3]):
                if all(b <= x or y <= a or (family != f and not (long and other)) for x, y, f, other, *_ in taken):
                    taken.append((a, b, family, long, float(prob[family]), agree))
            places = lambda x: len(raw[doc][: x - buf.start[doc]].decode("utf-8", "surrogatepass"))  # noqa: E731, B023
            out.append([(places(a), places(b), FAMILIES[f], prob, agree) for a, b, f, _, prob, agree in sorted(taken)])
        solid = np.bincount(np.searchsorted(buf.start, start[first[self._solid(buf, start, end)[first]]], side="right") - 1, minlength=len(texts)) if len(texts) else []
        return out, [int(x) for x in solid]

    @staticmethod
    def _solid(buf: Buffer, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        count = np.concatenate([[0], np.cumsum(~SPACE[buf.bytes])])
        return count[end] > count[start]

    def confirmed(self, piece: str, prob: np.ndarray) -> tuple[int, float, bool, int]:
        """The family that templates confirm (0: none), how far it agrees, whether a long template says so, and n-grams in common."""
        own, best = trigrams(piece, self.p), (0, 0.0, False, 0)
        for f in np.argsort(-prob)[:5].tolist():
            for t in self.long[f] if f else ():
                same = len(np.intersect1d(own, t))
                agree = same / max(1, min(len(own), len(t)))
                if agree >= self.p.contained and 2 * len(own) >= len(t) and (same, agree) > (best[3], best[1]):
                    best = (f, agree, True, same)
        if best[0]:
            return best
        for words in (_WORDS.findall(x) for x in _SENTENCE.split(piece.lower())):
            for f in range(1, len(FAMILIES)):
                for t in self.short[f]:
                    if len(t) > best[3] and self.says(words, t):
                        best = (f, 1.0, False, len(t))
        return best

    @staticmethod
    def says(words: list[str], short: list[str]) -> bool:
        """Whether a sentence holds the short notice and not much else."""
        n = len(short)
        if len(words) > 2 * n + 6:
            return False
        return any(words[i : i + n] == short and (n > 3 or len(words) - i - n <= 1) for i in range(len(words) - n + 1))


def variations(p: Params) -> tuple[list[str], list[int]]:
    """Templates as licences are quoted: words dropped, added or doubled, lines cut out; the wording itself first."""
    rng = np.random.default_rng(p.seed)
    extra = "the this file work project code copyright c 2019 2020 2021 2022 2023 2024 and see for details notice by author holder contributors inc source text is it".split()
    lines, labels = [], []
    for family, texts in TEMPLATES.items():
        for t in texts:
            whole = t.split()
            for k in range(p.variations * (4 if len(whole) > p.short else 1)):
                words = list(whole)
                if k >= p.variations // 4:
                    if len(words) > p.short and k % 2:
                        a = rng.integers(0, len(words) - 4)
                        words = words[a : a + rng.integers(5, 15)]
                    words = [w for w in words if rng.random() > 0.04]
                    for _ in range(rng.integers(0, 5)):
                        words.insert(int(rng.choice([0, len(words)])), str(rng.choice(extra)))
                lines.append(" ".join(words))
                labels.append(FAMILIES.index(family))
    every = " ".join(t for ts in TEMPLATES.values() for t in ts).split()
    for _ in range(20 * len(FAMILIES)):  # single words of licences alone are no licence
        lines.append(" ".join(rng.choice(every, rng.integers(1, 12))))
        labels.append(0)
    return lines, labels


def fit(negatives: list[str], p: Params = Params()) -> Model:
    """Softmax regression by stochastic gradient descent; a fifth of all rows is held out to calibrate."""
    lines, labels = variations(p)
    y = np.array([*labels, *[0] * len(negatives)])
    lines = [*lines, *negatives]
    size, k = 1 << p.bits, len(FAMILIES)
    rows = []
    for line in lines:
        at = np.concatenate([h for h, _ in one_piece(line, p)] or [np.empty(0, dtype=np.uint64)])
        rows.append((at >> np.uint64(64 - p.bits)).astype(np.int64))
    rng = np.random.default_rng(p.seed)
    order = rng.permutation(len(rows))
    train, test = order[: len(order) * 4 // 5], order[len(order) * 4 // 5 :]
    w, bias = np.zeros((size, k)), np.zeros(k)
    share = np.bincount(y[train], minlength=k).astype(np.float64)
    weight = (share.sum() / (k * np.maximum(share, 1)))[y] ** 0.5

    def logits(own):
        n = np.array([len(rows[i]) for i in own])
        at, scale = np.concatenate([rows[i] for i in own]), 1 / np.maximum(n, 1) ** 0.5
        doc = np.repeat(np.arange(len(own)), n)
        z = np.tile(bias, (len(own), 1))
        np.add.at(z, doc, w[at] * scale[doc, None])
        return z, at, doc, scale

    for epoch in range(p.epochs):
        rng.shuffle(train)
        for a in range(0, len(train), 64):
            own = train[a : a + 64]
            z, at, doc, scale = logits(own)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            d = e / e.sum(axis=1, keepdims=True)
            d[np.arange(len(own)), y[own]] -= 1
            d *= weight[own, None] / len(own)
            rate = p.rate / (1 + 0.3 * epoch)
            np.add.at(w, at, -rate * d[doc] * scale[doc, None])
            bias -= rate * d.sum(axis=0)
            w *= 1 - rate * p.decay
    z = logits(test)[0]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    prob = e / e.sum(axis=1, keepdims=True)
    # The corpus' own paragraphs calibrate; loose words of licences, where there are none.
    own = (y[test] == 0) & ((test >= len(labels)) | (not negatives))
    top = (1 - prob[:, 0])[own]
    least = max(0.5, float(np.quantile(top, 1 - p.false_rate)) if len(top) else 0.5)
    return Model(w.astype(np.float32), bias, min(least, 0.95), p)


def train(docs: DataFrame, p: Params = Params(), *, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Negatives: one line and one paragraph of each of the ``p.negatives`` documents of smallest id hash, without a template's trigram."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = lambda xs, tag: F.try_element_at(xs, (F.pmod(F.xxhash64(F.lit(tag), "k"), F.greatest(F.size(xs), F.lit(1))) + 1).cast("int"))
    solid = lambda xs: F.filter(xs, lambda x: (F.trim(x) != "") & (F.length(x) <= p.longest))
    lines, paragraphs = solid(F.split(text, "\n")), solid(F.split(text, r"\n\s*\n"))
    keys = docs.select(F.col(id_col).alias("k")).filter("k is not null").distinct().orderBy(F.xxhash64("k"), "k").limit(p.negatives)
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col)).join(F.broadcast(keys), "k", "left_semi")
    # Of texts that repeat an id one stands for them.
    picked = rows.select("k", F.struct(some(lines, "line").alias("line"), some(paragraphs, "paragraph").alias("paragraph")).alias("x")).groupBy("k").agg(F.min("x").alias("x"))
    known = np.unique(np.concatenate([trigrams(t, p) for ts in TEMPLATES.values() for t in ts]))
    got = {t for r in picked.select("x.*").toLocalIterator() for t in r if t}
    return fit(sorted(t for t in got if not np.isin(trigrams(t, p), known).any()), p)


FOUND = "doc_id long, n_paragraphs long, found array<struct<start:int,end:int,family:string,probability:double,agreement:double>>"
_FOUND_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("agreement", pa.float64())]))


def scan(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the number of paragraphs, and the confirmed ones: place, family, probability, agreement with a template."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(part.column(1))
        found, n = sent.value.scan(texts)
        names = ("start", "end", "family", "probability", "agreement")
        return pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array([[dict(zip(names, x)) for x in f] for f in found], _FOUND_ARROW)], names=["doc_id", "n_paragraphs", "found"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(map_slices(one, "text", 1 << 20), FOUND)


def op10_license_paragraphs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, train(docs))
    return found.select(
        "doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct("found.family")), ",").alias("licenses"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["start"], x["end"], x["family"])), ",").alias("spans"),
    )
