"""License scans: sparse logistic regression on word n-grams per paragraph, confirmed by comparison with templates.

A paragraph is a line with a word, or, where lines are wrapped, a run of lines. Its features are the words and word pairs of
the templates that it holds (lower-case letters and digits; words that nearly every text has are no features by themselves). One multinomial regression gives a
probability to each licence family and to *unknown*. It is trained on the templates, on variants of them (parts of them,
and templates within ordinary words) and, for unknown, on paragraphs of at most ``TRAIN_DOCS`` documents that do not speak
of licences, on sentences about licences that grant none and on notices that are denied ("not licensed under"); the words
that deny are features beside the templates'. A temperature, fitted on every fourth example, which is kept
out of the fit, calibrates the probabilities; under ``SURE`` a paragraph is unknown.

A predicted family is confirmed if a template of its has at least ``ALIKE`` of its word pairs in the paragraph. Lines are also
read on over their ends: a run of lines, without an empty one between, that each hold a pair
of one template (pairs over line ends count with the later line) is joined, scored and confirmed as one paragraph. Runs may
be of any length; of lines and runs that share a line the one with the larger part of its template counts. Weights
exist for template n-grams alone, so a paragraph without any has the bias as its score: it is unknown, and only the others
are scored.

Null and empty texts have no paragraphs and no licences. Repeated rows are scanned each for itself. Long texts are read
whole, by chunks of lines. Extra columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import binary, bounded, table

TRAIN_DOCS = 400
SURE = 0.6
ALIKE = 0.5
BLANK = b"\x20\x09\x0b\x0c\x0d"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PLAIN = frozenset(b"the a an of to and or in is for with by be as on at this that it are was from not".split())

# The public wording of licence notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-only"),
    "GPL-2.0": ("Licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "SPDX-License-Identifier: GPL-2.0-only"),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "BSD": ("Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "Proprietary": ("Copyright. All rights reserved.", "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited."),
}
NONE = ("The license of the driver was checked at the gate.", "He asked for a version of the work with a source.", "A fishing license is free for the public.", "General terms of the public library.", "The author is permitted to use the copy.", "Version 3 of the form follows version 2.")
#: How a notice is denied: put before a template, or around it, they make examples of unknown.
DENIALS = ("This file is not {}", "This work was never {}", "It is no longer {}", "Nothing here is {}", "This is neither {}", "The text cannot be {}", "{} does not apply to this file.")
FAMILIES = tuple(TEMPLATES)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def grams(own: list[bytes]) -> list[bytes]:
    return own + [a + b" " + b for a, b in zip(own, own[1:], strict=False)]


_DENIES = frozenset(b"not never no longer nothing neither cannot apply".split())


def denied() -> list[str]:
    """Each notice of the form "Licensed under ..." in every denial."""
    return [d.format(t[0].lower() + t[1:].rstrip(".") if not d.startswith("{") else t.rstrip(".")) for own in TEMPLATES.values() for t in own if t.startswith(("Licensed", "Released", "This work is licensed")) for d in DENIALS]


class Model:
    def __init__(self):
        own = {g for t in TEMPLATES.values() for x in t for g in grams(words(x.encode())) if g not in _PLAIN}
        # Pairs and words by which a notice is denied are features too.
        every = sorted(own | {g for x in denied() for g in grams(words(x.encode())) if _DENIES & set(g.split())})
        self.place = {g: i for i, g in enumerate(every)}
        self.weight = np.zeros((len(every), len(FAMILIES) + 1))
        self.bias = np.zeros(len(FAMILIES) + 1)
        self.heat = 1.0
        #: Single words without which no template n-gram occurs, and templates as sets of pairs.
        self.words = frozenset(g for g in own if b" " not in g)
        self.whole = [(f, frozenset(self.place[g] for g in grams(words(x.encode())) if b" " in g)) for f, family in enumerate(FAMILIES) for x in TEMPLATES[family]]
        self.holders: dict[int, list[int]] = {}
        for t, (_, pairs) in enumerate(self.whole):
            for g in pairs:
                self.holders.setdefault(g, []).append(t)
        self.pairs = [[frozenset(g for g in grams(words(x.encode())) if b" " in g) for x in TEMPLATES[f]] for f in FAMILIES]

    def vector(self, own: list[bytes]) -> list[int]:
        return sorted({i for g in grams(own) if (i := self.place.get(g)) is not None})

    def scores(self, vectors: list[list[int]]) -> np.ndarray:
        out = np.array([self.weight[v].sum(0) / max(1.0, len(v) ** 0.5) for v in vectors]).reshape(-1, len(self.bias)) + self.bias
        out = out / self.heat
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)

    def fit(self, examples: list[tuple[list[int], int]], rounds: int = 200) -> Model:
        kept, held = [e for k, e in enumerate(examples) if k % 4], examples[::4]
        x, y = self._matrix(kept)
        hot = np.eye(len(self.bias))[y]
        m = [np.zeros_like(self.weight), np.zeros_like(self.bias)]
        v = [np.zeros_like(self.weight), np.zeros_like(self.bias)]
        for r in range(1, rounds + 1):
            p = x @ self.weight + self.bias
            p = np.exp(p - p.max(1, keepdims=True))
            d = hot - p / p.sum(1, keepdims=True)
            for k, (g, own) in enumerate(((x.T @ d / len(y) - 1e-4 * self.weight, self.weight), (d.mean(0), self.bias))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                own += 0.1 * (m[k] / (1 - 0.9**r)) / (np.sqrt(v[k] / (1 - 0.999**r)) + 1e-8)
        x, y = self._matrix(held)
        raw = x @ self.weight + self.bias

        def loss(heat: float) -> float:
            z = raw / heat
            top = z.max(1)
            return float((np.log(np.exp(z - top[:, None]).sum(1)) + top - z[np.arange(len(y)), y]).mean())

        self.heat = min((0.25 * 1.15**k for k in range(24)), key=loss)
        return self

    def _matrix(self, examples: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(examples), len(self.place)))
        for k, (v, _) in enumerate(examples):
            x[k, v] = 1 / max(1.0, len(v) ** 0.5)
        return x, np.array([c for _, c in examples])

    def judge(self, paragraphs: list[bytes]) -> list[tuple[int, float, float] | None]:
        """For each paragraph the family, its probability and the largest part of a template of it that the paragraph holds;
        None is unknown."""
        split = [words(p) for p in paragraphs]
        vectors = [self.vector(w) if not self.words.isdisjoint(w) else [] for w in split]
        some = [k for k, v in enumerate(vectors) if v]
        out: list[tuple[int, float, float] | None] = [None] * len(paragraphs)
        if some:
            p = self.scores([vectors[k] for k in some])
            for k, family, sure in zip(some, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                if family < len(FAMILIES) and sure >= SURE:
                    own = set(grams(split[k]))
                    out[k] = family, sure, max(len(t & own) / len(t) for t in self.pairs[family])
        return out

    def hits(self, lines: list[bytes]) -> list[tuple[int, float, float]]:
        """The confirmed hits of lines and of runs of lines; of those that share lines the one with the larger part of its
        template, and of equal ones the shorter."""
        found: list[tuple[float, int, int, tuple[int, float, float] | None, int]] = []
        places = [k for k, x in enumerate(lines) if x.strip(BLANK)]
        for at in range(0, len(places), 1000):
            own = places[at : at + 1000]
            found += [(hit[2], k, k, hit, hit[0]) for k, hit in zip(own, self.judge([lines[k] for k in own]), strict=True) if hit and hit[2] >= ALIKE]
        runs: dict[int, list[tuple[int, int, set[int]]]] = {}  # of each template: first line, last line, pairs
        before: list[bytes] = []
        for k, line in enumerate(lines):
            own = words(line)
            if own and not (self.words.isdisjoint(own) and (not before or self.words.isdisjoint(before[-1:]))):
                joined = before[-1:] + own
                for i, (a, b) in enumerate(zip(joined, joined[1:], strict=False)):
                    g = self.place.get(a + b" " + b)
                    for t in self.holders.get(g, ()):
                        every = runs.setdefault(t, [])
                        if not every or every[-1][1] < k - 1:
                            # A pair over the line's end begins with the line before.
                            every.append((k - 1 if before and i == 0 else k, k, {g}))
                        else:
                            first, _, pairs = every[-1]
                            pairs.add(g)
                            every[-1] = first, k, pairs
            before = own
        for t, every in runs.items():
            family, whole = self.whole[t]
            found += [(len(pairs) / len(whole), first, last, None, family) for first, last, pairs in every if last > first and len(pairs) >= ALIKE * len(whole)]
        out, used = [], set()
        for _, first, last, hit, family in sorted(found, key=lambda x: (-x[0], x[2] - x[1], x[1], x[4])):
            if used.isdisjoint(range(first, last + 1)):
                hit = hit or self.judge([b" ".join(lines[first : last + 1])])[0]
                if hit and hit[2] >= ALIKE and hit[0] == family:
                    out.append(hit)
                    used.update(range(first, last + 1))
        return out


def paragraphs(text: bytes) -> list[bytes]:
    return [x for x in text.split(b"\n") if x.strip(BLANK)]


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> Model:
    every = max(1, docs.count() // most)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = sample.select(F.explode(F.split("text", "\n")).alias("line")).filter("line RLIKE '[a-zA-Z]' AND NOT lower(line) RLIKE 'licen|copyright|spdx|warrant|rights reserved'")
    rows = lines.select(F.col("line")).orderBy(F.xxhash64("line"), "line").limit(5 * most).collect()
    ordinary = [words(r[0].encode())[:400] for r in rows] or [[b"nothing"]]
    model, r, out = Model(), random.Random(5), []
    for f, (family, templates) in enumerate(TEMPLATES.items()):
        for t in templates:
            own = words(t.encode())
            for k in range(24):
                part = own
                if k % 3 == 1 and len(own) > 6:
                    part = own[r.randint(0, len(own) // 3) :]  # families differ in their last words, which stay
                near = r.choice(ordinary)
                out.append((model.vector(part if k % 3 != 2 else near[:6] + own + near[6:12]), f))
    unknown = len(FAMILIES)
    out += [(model.vector(w), unknown) for w in ordinary]
    out += [(model.vector(words(n.encode())), unknown) for n in NONE for _ in range(10)]
    out += [(model.vector(words(n.encode())), unknown) for n in denied() for _ in range(3)]
    out.sort()
    r.shuffle(out)
    return model.fit(out)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_paragraphs, n_licenses, families (sorted, comma-joined), family and probability of the surest one, confirmed."""
    own_model = model or train(docs)  # some hundred numbers, sent with the function

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
                lines, best = text.split(b"\n"), None
                found = own_model.hits(lines)
                for hit in found:
                    best = hit if best is None or hit[1] > best[1] else best
                names = sorted({FAMILIES[f] for f, _, _ in found})
                rows.append((doc_id, len(paragraphs(text)), len(found), ",".join(names), FAMILIES[best[0]] if best else None, best[1] if best else 0.0))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_paragraphs", "n_licenses", "families", "family", "probability"])

    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_paragraphs long, n_licenses long, families string, family string, probability double")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op9_licenses": op9_licenses}
ORACLE_SQL: dict[str, str] = {}
