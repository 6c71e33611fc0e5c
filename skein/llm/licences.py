"""Licence scans by a trained paragraph classifier.

Lines without letters or digits part a text into paragraphs. Every line of every
paragraph, and every two successive ones, is scored; a line of more than ``WIDE`` words
is scored in overlapping windows of as many words. Each run of lines that the model
does not take for prose is then classified with the lines about it, up to six on
either side, so that a wrapped notice is met whole.

Sparse counts of word 1- to 3-grams feed a multinomial logistic regression over licence
families and prose. The model is trained here, on the driver, from the templates below
with seeded noise. Whether a notice belongs to a family that the model knows is a second,
calibrated question: groups of related families are left out of training in turn, and a
logistic map of the margin and of the likeness to the nearest template is fitted to tell
the notices of the families left out from the others. Its complement is the probability of
the unknown class. A prediction counts as confirmed where the paragraph holds enough of
the word pairs of a template of the predicted family.

Defined results: null and empty texts have no paragraph; a reservation of rights that
names no holder and no licence is prose; repeated rows are scanned one by one; of windows
equally like a template the shortest counts; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices by which families are known.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Licensed under the MIT license",
        "SPDX-License-Identifier: MIT",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "either version 3 of the GNU General Public License, or (at your option) any later version",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "either version 2 of the GNU General Public License, or (at your option) any later version",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1 or 3",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License",
        "provided that the above copyright notice and this permission notice appear in all copies.",
        "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
    ),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc0": ("Released under CC0 1.0 Universal, public domain dedication", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    "unlicense": ("This is free and unencumbered software released into the public domain", "Released under the Unlicense license"),
}
OTHER = (
    "Copyright by the author. All rights reserved.",
    "Copyright 2019 by the company. All rights reserved.",
    "Copyright 2020 by the author. All rights reserved.",
    "Copyright (c) 2020 the authors",
    "Copyright 2018, 2022 by its owner",
    "Distributed under the Community License 1.0",
    "Copyright 2021 by the publisher. All rights reserved. No reproduction without permission.",
    "Community Software License - Version 1.0",
    "Distributed under the terms of the software license agreement, version 2",
    "This software is provided 'as-is', without any express or implied warranty, and you may use it for any purpose",
    "Licensed under the terms of our proprietary license agreement",
    "This software is licensed under a commercial license; contact sales for terms",
    "No part of this publication may be reproduced without permission of the publisher, copyright holder",
    "Licensed under a custom license, see the accompanying file",
    "Licensed under the European community license for internal use only",
)
PROSE = (
    "All rights reserved.",
    "The warranty of this product ends after two years",
    "You can use the software for this work and copy the files to any place you want",
    "The conditions of the work were met, and the following day the people were free to go",
    "See the file for more of this, and write to the author if you have to",
    "He lost his driving license last year and took the bus to work",
    "The committee gave them permission to speak at the meeting",
    "Her poetic license was discussed by all of the critics",
    "The license plate of the car was covered with mud",
    "Copyright law is taught in the second year of the course",
    "A fishing license can be bought at the lake",
    "They were licensed to sell food and drink at the market",
)
#: Related families, left out of training together.
GROUPS = (("apache-2.0", "mpl-2.0"), ("mit", "isc"), ("bsd", "unlicense"), ("gpl-3.0", "gpl-2.0", "lgpl", "agpl-3.0"), ("cc-by-nc", "cc-by-sa", "cc-by", "cc0"))
UNKNOWN, NONE = "unknown", "prose"
WORD = re.compile(r"[^\W_]")
CONFIRM = 0.6
#: Lines on either side of a run that may belong to it, and words scored at once.
GROW, WIDE = 6, 40


def tokens(text: str) -> list[str]:
    """Lower-case words and numbers."""
    return re.findall(r"[a-z]+|[0-9]+(?:\.[0-9]+)?", text.lower())


def grams(words: list[str], sizes: tuple[int, ...] = (1, 2, 3)) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)]


def pairs(words: list[str]) -> frozenset[tuple[str, ...]]:
    return frozenset(zip(words, words[1:]))


def _noised(rng: np.random.Generator, words: list[str], filler: list[str]) -> list[str]:
    """The words with some lost and some strange ones about them."""
    words = [w for w in words if rng.random() > 0.05]
    edge = rng.choice(filler, rng.integers(0, 12)).tolist()
    cut = int(rng.integers(0, len(edge) + 1))
    return edge[:cut] + words + edge[cut:]


class Softmax:
    """Multinomial logistic regression on sparse word n-grams; the last class is prose."""

    def __init__(self, texts: dict[str, tuple[str, ...]], rng: np.random.Generator, each: int, rounds: int):
        self.classes = list(texts)
        every = [tokens(t) for ts in texts.values() for t in ts]
        self.vocabulary = {g: i for i, g in enumerate(sorted({g for t in every for g in grams(t)}))}
        self.known = {g[0] for g in self.vocabulary if len(g) == 1}
        filler, loose = [w for t in PROSE + OTHER for w in tokens(t)], [w for t in every for w in t]
        rows, labels = [], []
        for c, ts in enumerate(texts.values()):
            for t in ts:
                for k in range(each):
                    words = tokens(t)
                    if k > each // 2 and len(words) > 12:  # a wrapped line of it
                        at = int(rng.integers(0, len(words) - 8))
                        words = words[at : at + int(rng.integers(8, 16))]
                    rows.append(self.features(_noised(rng, words, filler) if k else words))
                    labels.append(c)
        for _ in range(12 * each):  # words of notices in no order, among strange ones, are prose
            words = rng.choice(loose, rng.integers(0, 25)).tolist() + [""] * int(rng.integers(0, 20))
            rng.shuffle(words)
            rows.append(self.features(words))
            labels.append(len(texts) - 1)
        for w in sorted(self.known):  # and so is one word of them by itself
            for n in (3, 6):
                rows.append(self.features([""] * int(rng.integers(0, n)) + [w] + [""] * int(rng.integers(1, n))))
                labels.append(len(texts) - 1)
        x, y = np.zeros((len(rows), len(self.vocabulary) + 1), np.float32), np.array(labels)
        for i, (at, value) in enumerate(rows):
            x[i, at] = value
            x[i, -1] = 1
        held = rng.random(len(rows)) < 0.2
        self.w = np.zeros((x.shape[1], len(self.classes)), np.float32)
        hot, speed = np.eye(len(self.classes), dtype=np.float32)[y], np.full(self.w.shape, 1e-6, np.float32)
        train = x[~held]
        for _ in range(rounds):
            slope = train.T @ (_softmax(train @ self.w) - hot[~held]) / len(train) + 1e-5 * self.w
            speed += slope * slope
            self.w -= 0.5 * slope / np.sqrt(speed)
        z = x[held] @ self.w
        loss = {t: -np.log(_softmax(z / t)[np.arange(len(z)), y[held]] + 1e-9).mean() for t in np.geomspace(0.25, 8, 31)}
        self.w /= min(loss, key=loss.get)

    def places(self, words: list[str]) -> list[int]:
        """Indices of the known n-grams; those of two and three words hold known words alone."""
        found, known, vocabulary = set(), self.known, self.vocabulary
        a = b = None  # the known words just before, if they stand side by side
        for w in words:
            if w in known:
                found.add(vocabulary[(w,)])
                if b is not None:
                    found.add(vocabulary.get((b, w)))
                    if a is not None:
                        found.add(vocabulary.get((a, b, w)))
                a, b = b, w
            else:
                a = b = None
        found.discard(None)
        return sorted(found)

    def features(self, words: list[str]) -> tuple[list[int], float]:
        """Indices of known n-grams and the value of each, less among many strange words."""
        at = self.places(words)
        return at, 1 / np.sqrt(max(1, len(at), len(words)))

    def logits(self, many: list[list[str]]) -> np.ndarray:
        """One row for each list of words."""
        rows = [self.features(words) for words in many]
        sizes = np.array([len(at) for at, _ in rows], np.int64)
        z = np.zeros((len(rows), len(self.classes)), np.float32)
        flat = np.fromiter((i for at, _ in rows for i in at), np.int64, int(sizes.sum()))
        held = np.flatnonzero(sizes)
        if len(held):
            starts = np.concatenate(([0], np.cumsum(sizes[held])[:-1]))
            z[held] = np.add.reduceat(self.w[flat], starts, axis=0) * np.array([rows[i][1] for i in held], np.float32)[:, None]
        return z + self.w[-1]


class Model:
    """Families by softmax, and whether the family is a known one at all."""

    def __init__(self, seed: int = 5, each: int = 40, rounds: int = 150):
        rng = np.random.default_rng(seed)
        self.base = Softmax({**TEMPLATES, UNKNOWN: OTHER, NONE: PROSE}, rng, each, rounds)
        self.classes = self.base.classes
        self.templates = {c: [pairs(tokens(t)) for t in ts] for c, ts in TEMPLATES.items()}
        facts, known = [], []
        for group in GROUPS:
            part = Softmax({**{c: ts for c, ts in TEMPLATES.items() if c not in group}, UNKNOWN: OTHER, NONE: PROSE}, rng, each // 2, rounds)
            for c, ts in {**TEMPLATES, UNKNOWN: OTHER}.items():
                for t in ts:
                    for _ in range(8 if c in group or c == UNKNOWN else 2):
                        words = _noised(rng, tokens(t), [""])
                        z = part.logits([words])[0]
                        facts.append(self._facts(part, z, words))
                        known.append(c not in group and c != UNKNOWN)
        x, y = np.column_stack([np.ones(len(facts)), np.array(facts)]), np.array(known, float)
        self.known = np.zeros(3)
        for _ in range(25):  # Newton's steps of a logistic fit
            p = 1 / (1 + np.exp(-x @ self.known))
            self.known += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (y - p) - 1e-2 * self.known)

    def _facts(self, part: Softmax, z: np.ndarray, words: list[str]) -> tuple[float, float]:
        """Margin of the best family over the unknown class, and its nearest template's likeness."""
        family = part.classes[int(z[:-2].argmax())]
        return float(np.clip(z[:-2].max() - z[-2], -10, 10)), self.likeness(family, words)

    def likeness(self, family: str, words: list[str]) -> float:
        own = pairs(words)
        return max((len(own & t) / len(t) for t in self.templates[family]), default=0.0)

    def prose(self, many: list[list[str]]) -> np.ndarray:
        """Which lists of words are prose."""
        return _softmax(self.base.logits(many))[:, -1] >= 0.5

    def predict(self, paragraph: str) -> tuple[str, float, float]:
        """``(family, probability, similarity)``; without a template that confirms it a family is unknown."""
        words = tokens(paragraph)
        z = self.base.logits([words])[0]
        p = _softmax(z[None])[0]
        if p[-1] >= 0.5:
            return NONE, float(p[-1]), 0.0
        family, (margin, near) = self.classes[int(p[:-2].argmax())], self._facts(self.base, z, words)
        known = float(1 / (1 + np.exp(-np.array([1, margin, near]) @ self.known)))
        if known < 0.5 or near < CONFIRM:
            return UNKNOWN, 1 - known, near
        return family, known * float(p[:-2].max() / p[:-2].sum()), near


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@lru_cache(1)
def model() -> Model:
    return Model()


def paragraphs(text: str) -> Iterator[tuple[int, list[str]]]:
    """``(first line, lines)`` of the paragraphs; lines without letters or digits part them."""
    first, held = 0, []
    for i, line in enumerate([*text.split("\n"), ""]):
        if WORD.search(line):
            if not held:
                first = i
            held.append(line)
        elif held:
            yield first, held
            held = []


def units(lines: list[str]) -> Iterator[tuple[int, int, list[str]]]:
    """``(first, last, words)``: what is scored of a paragraph, by the lines it touches."""
    before: list[str] = []
    for i, line in enumerate(lines):
        words = tokens(line)
        if len(words) > WIDE:
            for at in range(0, len(words) - WIDE // 2, WIDE // 2):
                yield i, i, words[at : at + WIDE]
            before = []
            continue
        yield i, i, words
        if before:
            yield i - 1, i, before + words
        before = words


def notices(lines: list[str], marked: list[bool], predict: Callable[[str], tuple[str, float, float]]) -> Iterator[tuple[int, str, float, float]]:
    """``(line, family, probability, similarity)`` of each run of marked lines and the lines about it.

    Of the windows that hold the run and up to ``GROW`` lines of the paragraph on
    either side, the most similar one that a template confirms counts, the shortest
    of equals; if none does, the run alone. A line too wide to be a wrapped one is met
    in its own windows of words, and nothing grows over it.
    """
    done = 0
    wide = [len(x) > 8 * WIDE and len(tokens(x)) > WIDE for x in lines]
    for start in range(len(lines)):
        if start < done or not marked[start]:
            continue
        if wide[start]:
            words = tokens(lines[start])
            found = [predict(" ".join(words[at : at + WIDE])) for at in range(0, len(words) - WIDE // 2, WIDE // 2)]
            for family in dict.fromkeys(f[0] for f in found):
                yield start, *max((f for f in found if f[0] == family), key=lambda f: (f[2], f[1]))
            done = start + 1
            continue
        end = start + 1
        while end < len(lines) and marked[end] and not wide[end]:
            end += 1
        run = "\n".join(lines[start:end])
        best, line, upto = predict(run), start, end
        if best[2] < 1 or best[0] == UNKNOWN:
            low, high = start, end
            while low > max(done, start - GROW) and not wide[low - 1]:
                low -= 1
            while high < min(len(lines), end + GROW) and not wide[high]:
                high += 1
            before, after = lines[low:start], lines[end:high]
            for n, k in sorted(((n, k) for n in range(len(before) + 1) for k in range(len(after) + 1) if n + k), key=sum):
                found = predict("\n".join([*before[len(before) - n :], run, *after[:k]]))
                if found[0] not in (UNKNOWN, NONE) and (best[0] in (UNKNOWN, NONE) or found[2] > best[2]):
                    best, line, upto = found, start - n, end + k
        done = upto
        yield line, *best


_FOUND = "line int, family string, probability double, similarity double"
#: Texts scored in one go.
_TOGETHER = 256


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, line, family, probability, similarity)`` of each licence paragraph; prose is left out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    fitted = docs.sparkSession.sparkContext.broadcast(model())  # a fixed size: templates alone make the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, float, float]] = {}

        def predict(paragraph: str) -> tuple[str, float, float]:
            if paragraph not in known:
                if len(known) > 10_000:
                    known.clear()
                known[paragraph] = fitted.value.predict(paragraph)
            return known[paragraph]

        def found(at: int, texts: list[str]) -> Iterator[tuple]:
            held = [(i, first, lines, list(units(lines))) for i, t in enumerate(texts) for first, lines in paragraphs(t)]
            prose, n = fitted.value.prose([words for *_, us in held for *_, words in us]), 0
            for i, first, lines, us in held:
                marked = [False] * len(lines)
                for (a, z, _), plain in zip(us, prose[n : n + len(us)]):
                    if a == z and not plain:
                        marked[a] = True
                alone = list(marked)  # two lines count together where neither does by itself
                for (a, z, _), plain in zip(us, prose[n : n + len(us)]):
                    if a < z and not plain and not alone[a] and not alone[z]:
                        marked[a] = marked[z] = True
                n += len(us)
                if any(marked):
                    yield from ((at + i, first + line, *verdict) for line, *verdict in notices(lines, marked, predict) if verdict[0] != NONE)

        for b in batches:
            texts, out = b.column("text"), []
            for at in range(0, b.num_rows, _TOGETHER):
                out += found(at, texts.slice(at, _TOGETHER).to_pylist())
            columns = list(zip(*out)) or [()] * 5
            ids = b.column("doc_id").take(pa.array(columns[0], pa.int64()))
            kinds = (pa.int32(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns[1:], kinds)]], ["doc_id", "line", "family", "probability", "similarity"])

    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {_FOUND}")
