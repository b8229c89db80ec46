"""Licence scan: a trained paragraph classifier, confirmed by template comparison.

Texts are cut into lines, and into paragraphs of lines with words, where wrapped notices are found; long ones
into overlapping windows. A sparse logistic regression over
hashed word 1- to 3-grams, one against the rest per licence family and for unknown licences, scores every window; scores are
calibrated on held-out examples (Platt). A window that the unknown class claims, or a family that is not confirmed, is unknown.
A family counts only if enough of a template's word pairs occur in a claimed window and the words from the first to the
last of them are the family's by themselves, so a window can have several families.

Training data are written from the templates below: whole, cut, filled in and mixed with other words, and declarations
of licences with invented names (the unknown class), against windows without licence text. Training happens on the driver over a few thousand short rows, fixed by
the seed; the weights (a few thousand numbers) are what the executors get.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices and sentences by which public licences are declared.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see",
        "Licensed under the GNU Affero General Public License, version 3.",
    ),
    "apache": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "Released under the Apache License 2.0.",
        "Apache License Version 2.0, January 2004",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Licensed under the Apache License, Version 2.0.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY",
        "Released under the 3-clause BSD License.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "gpl": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "This work is licensed under the GNU General Public License, version 3.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The MIT License (MIT)",
        "MIT License",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE",
        "Released under the MIT License.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
FAMILIES = tuple(TEMPLATES)
#: How licences of no family are declared; {} is an invented name.
OTHERS = (
    "licensed under the {} license", "released under the terms of the {} license version 2", "this software is distributed under the {} public license", "see the {} license for details",
    "you may use, copy and distribute this software only under the terms of the {} license agreement", "this work is licensed under a {} license", "{} grants you a non-exclusive license to use this software",
    "all rights reserved by {}, no part of this work may be reproduced without written permission", "published under the {} licence", "use of this file is subject to the {} license terms",
    "made available under the terms of the {} public license v 2.0 which accompanies this distribution", "{} license 1.0", "the author waives all rights to {} worldwide to the extent allowed by law",
    "you are permitted to use, copy and distribute {} for any purpose without charge, provided that this notice appears in all copies",
    "permission to use and change this {} for any purpose, with or without charge, is hereby granted", "the author of {} has given up all copyright and related rights as far as the law allows",
    "this is free software, licensed under the terms of the {} license 2.0",
)
#: How identifiers of a machine-readable declaration begin, by family; the longest one counts.
IDENTIFIERS = {
    "agpl": ("agpl-",), "apache": ("apache-2.0",), "bsd": ("bsd-2-clause", "bsd-3-clause"), "cc-by": ("cc-by-1", "cc-by-2", "cc-by-3", "cc-by-4"), "cc-by-nc": ("cc-by-nc-1", "cc-by-nc-2", "cc-by-nc-3", "cc-by-nc-4"),
    "cc-by-sa": ("cc-by-sa-",), "gpl": ("gpl-",), "lgpl": ("lgpl-",), "mit": ("mit",), "mpl": ("mpl-",), "unlicense": ("unlicense",),
}
_DECLARED = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n]*)", re.I)
BITS = 18
#: Words a window has, and how far the next one begins: every run of 24 words is whole in some window.
WINDOW, STEP = 48, 24
#: Windows of a text whose outcome is kept.
MEMO = 20_000
#: Least calibrated probability of a family, and least share of a template's word pairs found.
CLAIM, CONFIRM = 0.5, 0.6
_TO_SPACE = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: str) -> list[bytes]:
    """Lower-cased words of letters and digits."""
    return text.encode("utf-8", "replace").translate(_LOWER).translate(_TO_SPACE).split()


def hashes(words: list[bytes]) -> np.ndarray:
    """A number per word."""
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def _fold(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    return ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BITS)).astype(np.int64)


def grams(h: np.ndarray) -> list[np.ndarray]:
    """Coordinates of the 1-, 2- and 3-grams that begin at each word; the last words have fewer."""
    two = h[:-1] * np.uint64(31) + h[1:] * np.uint64(0x10001) if len(h) > 1 else h[:0]
    three = two[:-1] * np.uint64(33) + h[2:] * np.uint64(0x1000003) if len(h) > 2 else h[:0]
    return [_fold(h), _fold(two + np.uint64(1 << 40)), _fold(three + np.uint64(1 << 41))]


def _distinct(h: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate(grams(h)))


@dataclass(frozen=True)
class Classifier:
    """weights[coordinate, class] of the coordinates in ``at``; intercepts; Platt's (a, b) by class; template pairs. The last class is unknown."""

    at: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    platt: np.ndarray
    pairs: tuple[tuple[np.ndarray, ...], ...]

    def bounds(self) -> np.ndarray:
        """The largest weight of any family, and the weight of the unknown class, by coordinate, none below 0."""
        out = np.zeros((2, 1 << BITS))
        out[0, self.at], out[1, self.at] = np.maximum(self.weights[:, :-1].max(1), 0), np.maximum(self.weights[:, -1], 0)
        return out

    def probabilities(self, h: np.ndarray) -> np.ndarray:
        """Calibrated probability of each family, and of an unknown licence, for a window of word hashes."""
        x = _distinct(h)
        row = np.searchsorted(self.at, x)
        row = row[(row < len(self.at))]
        some = row[self.at[row] == x[: len(row)]]
        raw = self.weights[some].sum(0) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.platt[:, 0] * raw + self.platt[:, 1], -35, 35)))

    @cached_property
    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of all templates, sorted, where the templates of each begin and which they are; the pairs that each template needs."""
        every = [t for some in self.pairs for t in some]
        of = np.repeat(np.arange(len(every)), [len(t) for t in every])
        flat = np.concatenate(every)
        order = np.argsort(flat, kind="stable")
        pairs, starts = np.unique(flat[order], return_index=True)
        needs = np.array([CONFIRM * min(len(t), WINDOW // 2) for t in every])
        return pairs, np.append(starts, len(flat)), of[order], needs

    def possible(self, h: np.ndarray) -> set[int]:
        """Families one of whose templates has enough of its pairs in a window, wherever they stand."""
        pairs, starts, of, needs = self.places
        two = np.unique(h[:-1] * np.uint64(31) + h[1:] * np.uint64(0x10001))
        at = np.minimum(np.searchsorted(pairs, two), len(pairs) - 1)
        at = at[pairs[at] == two]
        n = starts[at + 1] - starts[at]
        hit = of[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(at) else of[:0]
        enough = np.bincount(hit, minlength=len(needs)) >= needs
        cuts = np.cumsum([0, *map(len, self.pairs)])
        return {f for f in range(len(self.pairs)) if enough[cuts[f] : cuts[f + 1]].any()}

    def confirm(self, family: int, h: np.ndarray) -> tuple[float, int, int]:
        """The best share of a template's word pairs in one stretch of a window (long templates may be cut by it), and the stretch."""
        two = h[:-1] * np.uint64(31) + h[1:] * np.uint64(0x10001)
        best = (0.0, 0, 0)
        for t in self.pairs[family]:
            hit = np.isin(two, t)
            least = min(len(t), WINDOW // 2)
            if len(np.unique(two[hit])) < CONFIRM * least:
                continue
            # Where pairs of the template are densest; of a pair that comes again (in another notice) all, the first or the last one counts.
            first, last = np.zeros(len(two), bool), np.zeros(len(two), bool)
            first[np.unique(two, return_index=True)[1]] = True
            last[len(two) - 1 - np.unique(two[::-1], return_index=True)[1]] = True
            for some in (hit, hit & first, hit & last):
                sums = np.concatenate(([0], np.cumsum(np.where(some, 1, -1))))
                low = np.minimum.accumulate(sums)
                end = int((sums - low).argmax())
                start = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
                share = len(np.unique(two[start:end][some[start:end]])) / least
                best = max(best, (share, start, end + 1), key=lambda x: (x[0], x[1] - x[2]))
        return best

    def families(self, h: np.ndarray) -> tuple[list[tuple[int, int, int, float, float]], float]:
        """(family, first word, end, probability, share) of every family confirmed in a window, none in the words of another; the probability of an unknown licence."""
        p = self.probabilities(h)
        most = float(p.max())
        if most < CLAIM / 4 or len(h) < 2:
            return [], most
        known, odd = float(p[:-1].max()), float(p[-1])
        some = []
        for f in sorted(self.possible(h)):
            share, start, end = self.confirm(f, h)
            if share >= CONFIRM:
                alone = float(self.probabilities(h[start:end])[f])
                some.append((max(alone, known if p[f] == known else 0.0), f, start, end, share))
        taken: list[tuple[int, int, int, float, float]] = []
        for q, f, start, end, share in sorted(some, key=lambda x: (-x[0], -x[4])):
            if q >= CLAIM and all(end <= s or start >= e for _, s, e, _, _ in taken):
                taken.append((f, start, end, q, share))
        # What is left beside them may hold others.
        cuts = [0, *(x for _, s, e, _, _ in sorted(taken, key=lambda x: x[1]) for x in (s, e)), len(h)]
        for s, e in zip(cuts[::2], cuts[1::2]) if taken else ():
            if e - s > 2:
                taken += [(f, s + x, s + y, q, share) for f, x, y, q, share in self.families(h[s:e])[0]]
        return taken, max(known, odd)


def _examples(rng: random.Random, n: int) -> list[tuple[np.ndarray, int]]:
    """Windows with a class's number, or -1: cuts of templates, or other licences, among invented words, and invented or near-miss words alone."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    near = "license licensed under the version released this work software general public terms copy free distributed permission copyright notice of and in to with for is a".split()
    invent = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))

    def filler(k: int) -> list[str]:
        return [rng.choice(near) if rng.random() < 0.3 else invent() for _ in range(k)]

    out = []
    for i in range(n):
        family = i % (2 * len(FAMILIES)) if i % 2 else -1
        if 0 <= family < len(FAMILIES) * 2:
            family //= 2
            text = rng.choice(TEMPLATES[FAMILIES[family]]).split()
            if len(text) > 20 and rng.random() < 0.7:
                k = rng.randint(18, len(text))
                at = rng.randint(0, len(text) - k)
                text = text[at : at + k]
            text = [w for w in text if rng.random() > 0.03]
            room = max(0, WINDOW - len(text))
            before = rng.randint(0, room) if rng.random() < 0.5 else 0
            text = filler(before) + text + filler(rng.randint(0, room - before) if rng.random() < 0.7 else 0)
        elif i % 4 == 2:
            family, name = len(FAMILIES), " ".join(invent() for _ in range(rng.randint(1, 3)))
            text = rng.choice(OTHERS).format(name).split()
            room = WINDOW - len(text)
            before = rng.randint(0, room) if rng.random() < 0.6 else 0
            text = filler(before) + text + filler(rng.randint(0, room - before) if rng.random() < 0.7 else 0)
        else:
            family, text = -1, filler(rng.randint(3, WINDOW))
            if rng.random() < 0.3:  # near misses: single template words in another order
                some = rng.choice(rng.choice(list(TEMPLATES.values()))).split()
                rng.shuffle(some)
                text[: len(some)] = some
        out.append((hashes(words_of(" ".join(text))), family))
    return out


@lru_cache(2)
def train(rows: int = 12000, epochs: int = 6, seed: int = 5, rate: float = 0.3, l1: float = 3e-3) -> Classifier:
    """Fit on ``rows`` written examples and calibrate on half as many others; the same in every run, and made once a process."""
    rng = random.Random(seed)
    k = len(FAMILIES) + 1
    data = [(_distinct(h), y) for h, y in _examples(rng, rows)]
    w, b, scale = np.zeros((1 << BITS, k)), np.full(k, -2.0), np.full(1 << BITS, 1.0)
    bias_scale = 1e-8
    for _ in range(epochs):
        rng.shuffle(data)
        for x, y in data:
            g = 1 / (1 + np.exp(-np.clip(w[x].sum(0) + b, -35, 35)))
            if y >= 0:
                g[y] -= 1
            scale[x] += (g * g).sum()
            step = rate / np.sqrt(scale[x])[:, None]
            new = w[x] - step * g
            w[x] = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            bias_scale += (g * g).sum()
            b -= rate / np.sqrt(bias_scale) * g
    w[np.abs(w) < 0.03] = 0
    at = np.flatnonzero(np.abs(w).sum(1))
    pairs = []
    for family in FAMILIES:
        some = [hashes(words_of(t)) for t in TEMPLATES[family]]
        pairs.append(tuple(np.unique(h[:-1] * np.uint64(31) + h[1:] * np.uint64(0x10001)) for h in some))
    model = Classifier(at, w[at], b, np.tile([1.0, 0.0], (k, 1)), tuple(pairs))
    held = [(h, y) for h, y in _examples(rng, rows // 2)]
    raw = np.array([_logit(model.probabilities(h)) for h, _ in held])
    truth = np.array([[float(y == f) for f in range(k)] for _, y in held])
    platt = np.array([_platt(raw[:, f], truth[:, f]) for f in range(k)])
    return Classifier(at, w[at].astype(np.float32), b, platt, tuple(pairs))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return np.log(p / (1 - p))


def _platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic fit to held-out scores, with Platt's softened targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + c, -35, 35)))
        v = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * raw).sum(), (p - target).sum()])
        h = np.array([[(v * raw * raw).sum() + 1e-3, (v * raw).sum()], [(v * raw).sum(), v.sum() + 1e-3]])
        a, c = np.array([a, c]) - np.linalg.solve(h, g)
    return float(max(a, 1e-3)), float(c)


def _windows(h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    at = 0
    while True:
        yield at, h[at : at + WINDOW]
        if at + WINDOW >= len(h):
            return
        at += STEP


def declared(line: str) -> list[str]:
    """Families, or unknown, of the identifiers in a machine-readable declaration; a line without one has none."""
    found = _DECLARED.search(line)
    names = [x.lower() for x in re.findall(r"[A-Za-z0-9][\w.+-]*", found[1])] if found else []
    skip = set()
    for i, x in enumerate(names):
        if x in ("or", "and"):
            skip.add(i)
        elif x == "with":  # an exception, which is no licence
            skip |= {i, i + 1}
    starts = [(b, f) for f, some in IDENTIFIERS.items() for b in some]
    return [max(((len(b), f) for b, f in starts if x.startswith(b)), default=(0, "unknown"))[1] for i, x in enumerate(names) if i not in skip]


def findings(text: str | None, model: Classifier, score_of: np.ndarray) -> list[tuple[int, str, float, float]]:
    """(line, family or unknown, probability, share of template) of what is claimed, one per line and family.

    The line is that of a notice's first matched word; unknown is what no family is confirmed in. A machine-readable declaration
    counts by its identifiers alone, with probability 1. Windows of equal words are judged once a text.

    ``score_of``: the largest weight of any family, and the weight of the unknown class, by coordinate, none below 0. A window whose words cannot reach a claim even
    with all their largest weights is passed over at once, which is most of any corpus.
    """
    lines = (text or "").split("\n")
    words = [words_of(x) for x in lines]
    h_all = hashes([w for some in words for w in some])
    if not len(h_all):
        return []
    one, two, three = grams(h_all)
    best = score_of[:, one].copy()
    best[:, : len(two)] += score_of[:, two]
    best[:, : len(three)] += score_of[:, three]
    total = np.zeros((2, len(h_all) + 1))
    np.cumsum(best, 1, out=total[:, 1:])
    least = (_logit(np.array([CLAIM / 4] * len(FAMILIES) + [CLAIM])) - model.platt[:, 1]) / model.platt[:, 0] - model.bias
    floor = np.array([least[:-1].min(), least[-1]])
    line_of = np.repeat(np.arange(len(words)), [len(some) for some in words])

    def look(begin: int, end: int) -> Iterator[tuple[int, int, list, float]]:
        """begin, end, families (at places of the text) and the largest probability of the windows that may claim something."""
        if end > begin and (total[:, end] - total[:, begin] > floor).any():
            for at, h in _windows(h_all[begin:end]):
                at += begin
                if (total[:, at + len(h)] - total[:, at] > floor).any():
                    own = h.tobytes()
                    if own not in seen:
                        if len(seen) == MEMO:
                            seen.clear()
                        seen[own] = model.families(h)
                    some, most = seen[own]
                    if some or most >= CLAIM:
                        yield at, at + len(h), [(f, at + s, at + e, p, share) for f, s, e, p, share in some], most

    spans: list[list] = []  # family, first word, end, probability, share, line
    has = {}  # the words of a family's notices, by family
    covered = np.zeros(len(h_all), bool)  # words of any notice
    seen: dict[bytes, tuple[list, float]] = {}
    stated: dict[int, list[str]] = {n: names for n, x in enumerate(lines) if "dentifier" in x.lower() and (names := declared(x))}
    lone: list[tuple[int, int, float]] = []  # windows that neither side settles, of lines and of paragraphs
    wider: list[tuple[int, int, float]] = []
    begin = first = kept = 0
    for number, some in enumerate(words):
        end = begin + len(some)
        covered[begin:end] |= number in stated
        for s, e, found, most in look(begin, end) if number not in stated else ():
            spans += [[*x, number] for x in found]
            for f, x, y, _, _ in found:
                has.setdefault(f, np.zeros(len(h_all), bool))[x:y] = True
                covered[x:y] = True
            if not found:
                lone.append((s, e, most))
        begin = end
        # A paragraph ends before a line without words. Its windows tell what no single line does.
        if number + 1 == len(words) or not words[number + 1]:
            if first < end and line_of[first] < line_of[end - 1]:
                wide: list[list] = []
                for s, e, found, most in look(first, end):
                    for f, x, y, p, share in found:
                        covered[x:y] = True
                        if f in has and has[f][x:y].any():  # a line has it by itself; the notice may begin before
                            same = min((z for z in spans[kept:] if z[0] == f and z[1] < y and x < z[2]), key=lambda z: z[1], default=None)
                            if same and x < same[1]:
                                same[1], same[5] = x, int(line_of[x])
                            continue
                        again = next((z for z in wide[-WINDOW:] if z[0] == f and z[1] < y and x < z[2]), None)
                        if again:  # the same notice in the next window
                            again[2:5] = max(again[2], y), max(again[3], p), max(again[4], share)
                        else:
                            wide.append([f, x, y, p, share, int(line_of[x])])
                    if not found:
                        wider.append((s, e, most))
                spans[kept:] = [z for z in spans[kept:] if not any(x[1] <= z[1] and z[2] <= x[2] and x[0] != z[0] and x[3] >= z[3] for x in wide)] + wide
            first, kept = end, len(spans)
    out: dict[tuple[int, str], tuple[float, float]] = {}
    for f, _, _, p, share, number in spans:
        key = (number, FAMILIES[f])
        if number not in stated:
            out[key] = max(out.get(key, (0.0, 0.0)), (p, min(1.0, share)))
    for number, names in stated.items():
        out |= {(number, f): (1.0, 1.0) for f in names}
    for s, e, most in lone + wider:  # something like a licence; a paragraph's windows do not repeat its lines'
        if not covered[s:e].any():
            covered[s:e] = True
            key = (int(line_of[s]), "unknown")
            out[key] = max(out.get(key, (0.0, 0.0)), (most, 0.0))
    return [(*k, *v) for k, v in sorted(out.items())]


def scan(docs: DataFrame, model: Classifier | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and licences (array of line, family, probability, share) of every row, whole texts, nothing shuffled.

    Null and empty texts have no licence. Repeated rows are scanned each; extra columns are ignored.
    """
    model = model or train()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("share", pa.float64())]))
    names = ("line", "family", "probability", "share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = model.bounds()
        for b in batches:
            found = [[dict(zip(names, f)) for f in findings(t.as_py(), model, score_of)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["key", "licences"])

    schema = f"key {docs.schema[key].dataType.simpleString()}, licences array<struct<line:int,family:string,probability:double,share:double>>"
    return rows.mapInArrow(run, schema)
