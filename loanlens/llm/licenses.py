"""License scans by a trained paragraph classifier.

A paragraph is a line of a text. A logistic regression over hashed word and word-pair counts tells
licence families apart and from other text. It is trained here on the notices below, with words
dropped and other text around them, and on about `SAMPLE` lines of the corpus (a documented bound,
chosen by a hash of the line; a line of more than `EXCERPT` characters gives as many of them, from a
place chosen by the hash) as the class of no licence. A quarter of the examples calibrate its
probabilities (a temperature).

Two thresholds are calibrated on licences that the model has not seen: families are left out of
training in turns, and their notices are scored beside lines of the corpus and notices of the other
families that were left out too. `doubt` is the probability of no licence below which a paragraph is
reported: it weighs missed notices of unseen families against lines taken for one, and is one half at
least. `sure` is the
probability of the best family below which a paragraph is of the unknown family: it weighs unseen
families that are given a name against known ones that are not. A paragraph that holds too little of
every notice of its best family is unknown too. All paragraphs of all texts are scored, and every one
below `doubt` is reported.

A paragraph without any word that a training notice has is no licence.

Cases: null and empty texts have no paragraph with words and no finding; lines without words are
counted as paragraphs and never found. Rows with equal or null ids stay rows of their own. On an
empty corpus the class of no licence has no examples but the notices' surroundings; nothing is
scored then.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm import words as w
from loanlens.llm.rows import add_column

c = F.col

#: Lines of licences and of the notices that name them, by family.
NOTICES = {
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3",
        "it under the terms of the GNU Affero General Public License as published by",
        "You should have received a copy of the GNU Affero General Public License along with this program",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed to the Apache Software Foundation under one or more contributor license agreements",
        "you may not use this file except in compliance with the License",
        "software distributed under the License is distributed on an AS IS BASIS",
        "See the License for the specific language governing permissions and limitations under the License",
    ),
    "artistic": (
        "This library is free software; you can redistribute it under the Artistic License 2.0",
        "You may distribute modified versions under the terms of the Artistic License",
        "Released under the Artistic License and the GNU General Public License",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0",
        "Use, modification and distribution are subject to the Boost Software License",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Licensed under the BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license",
        "Redistributions of source code must retain the above copyright notice, this list of conditions",
        "Redistributions in binary form must reproduce the above copyright notice and this disclaimer",
        "Neither the name of the copyright holder nor the names of its contributors may be used",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0",
        "This text is available under the Creative Commons Attribution-ShareAlike License",
    ),
    "cddl": (
        "The contents of this file are subject to the Common Development and Distribution License",
        "You can obtain a copy of the License and its terms from the file named CDDL",
        "Licensed under the CDDL, Version 1.0",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the Eclipse Public License",
        "Licensed under the terms of the Eclipse Public License v2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
        "Everyone is permitted to copy and distribute verbatim copies of this license document",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee",
        "Licensed under the ISC License",
    ),
    "lgpl": (
        "it under the terms of the GNU Lesser General Public License as published by",
        "Licensed under the LGPL, version 2.1 or later",
        "You should have received a copy of the GNU Lesser General Public License with this library",
    ),
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "The above copyright notice and this permission notice shall be included in all copies",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License 2.0",
    ),
    "ofl": (
        "This Font Software is licensed under the SIL Open Font License, Version 1.1",
        "The fonts may be bundled and redistributed under the Open Font License",
    ),
    "proprietary": (
        "All rights reserved. No part of this work may be reproduced without written permission",
        "This software is proprietary and confidential; unauthorized copying is prohibited",
        "Use of this software is subject to the terms of the license agreement",
        "By installing this software you accept the terms of the end user license agreement",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain",
        "To the extent possible under law, the author has waived all copyright and related rights",
        "Dedicated to the public domain under CC0 1.0 Universal",
        "Anyone is free to copy, modify, publish, use, compile, sell or distribute this software",
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty",
        "Permission is granted to anyone to use this software for any purpose and to alter it",
        "Licensed under the zlib/libpng License",
    ),
}
NONE = "none"
UNKNOWN = "unknown"
CLASSES = (NONE, *NOTICES)
NOTHING = np.eye(len(CLASSES))[0]

SAMPLE = 4000
EXCERPT = 2000
VARIANTS = 60
SLOTS = 1 << 15
#: Turns of leaving families out.
TURNS = 5
#: A line of the corpus taken for a licence weighs as much as so many missed notices.
FALSE_WEIGHT = 10.0
#: Of a notice's word pairs, the share that confirms its family.
CONFIRM = 0.6

FOUND = "struct<n_paragraphs:bigint,found:array<struct<paragraph:bigint,family:string,probability:double>>>"


def _pairs(text: str) -> set[tuple[str, str]]:
    """Neighbouring words, digits alike."""
    own = re.findall(r"[^\W_]+", re.sub(r"\d+", "0", text.lower()))
    return set(zip(own, own[1:], strict=False))


TEMPLATES = {family: [_pairs(x) for x in notices] for family, notices in NOTICES.items()}


def agreement(text: str, family: str) -> float:
    """The largest share of a notice's word pairs that the text holds."""
    own = _pairs(text)
    return max(len(own & t) / len(t) for t in TEMPLATES[family])


class Lines:
    """Slots of the words and word pairs of each line that has words."""

    def __init__(self, texts: pa.Array) -> None:
        self.words = words = w.Words(texts, w.LETTERS, lower=True)
        breaks = np.flatnonzero(words.bytes == 10)
        line = np.searchsorted(breaks, words.start)
        text = np.repeat(np.arange(len(texts)), words.counts())
        self.starts, self.ends = w.runs(line * len(texts) + text) if len(line) else w.runs(line)
        self.text = text[self.starts]
        base = np.searchsorted(breaks, words.offsets)
        self.number = line[self.starts] - base[self.text]
        size = np.diff(words.offsets)
        # Lines of a text: its line ends and the rest behind the last of them.
        self.per_text = np.where(size > 0, np.diff(base) + 1, 0)
        name = words.hashes(51)
        self.slots = np.empty((len(name), 2), dtype=np.int64)
        self.slots[:, 0] = name >> np.uint64(49)
        after = np.append(name[1:], np.uint64(0)) if len(name) else name
        pair = w.mix(name + w.mix(after))
        self.slots[:, 1] = pair >> np.uint64(49)
        self.slots[self.ends - 1, 1] = SLOTS  # the last word of a line has no pair

    def string(self, k: int) -> str:
        first, last = self.starts[k], self.ends[k] - 1
        part = self.words.bytes[self.words.start[first] : self.words.end[last]]
        return part.tobytes().decode("utf-8", "replace")


def _slots(texts: list[str]) -> list[np.ndarray]:
    """The slots of each text; texts have no line ends."""
    lines = Lines(pa.array(texts, pa.large_string()))
    out = [np.empty(0, dtype=np.int64)] * len(texts)
    for text, first, last in zip(lines.text, lines.starts, lines.ends, strict=True):
        out[text] = lines.slots[first:last].ravel()
    return out


class Classifier:
    """Weights [slot, class], offsets, temperature and thresholds (`calibrated` sets these)."""

    doubt = 0.2
    sure = 0.5

    def __init__(self, texts: list[str], classes: np.ndarray, seed: int = 7) -> None:
        order = np.random.default_rng(seed).permutation(len(texts))
        texts, classes = [texts[k].replace("\n", " ") for k in order], classes[order]
        held = np.arange(len(texts)) % 4 == 3
        lines = _slots(texts)
        self.weights = np.zeros((SLOTS + 1, len(CLASSES)), dtype=np.float32)
        self.offset = np.zeros(len(CLASSES), dtype=np.float32)
        self.temperature = 1.0
        # Words and pairs that some licence has; a line without any is none, whatever the offsets.
        self.seen = np.zeros(SLOTS + 1, dtype=bool)
        for k in np.flatnonzero(~held & (classes > 0)):
            self.seen[lines[k]] = True
        self.seen[SLOTS] = False
        share = np.bincount(classes[~held], minlength=len(CLASSES))
        weight = 1 / np.maximum(share, 1) * share.max()
        squares = np.full_like(self.weights, 1e-2)
        for _ in range(6):  # passes of adaptive gradient steps
            for k in np.flatnonzero(~held):
                slots = lines[k]
                scale = 1 / _length(len(slots))
                p = _softmax(self.weights[slots].sum(axis=0) * scale + self.offset)
                p[classes[k]] -= 1
                step = p * min(weight[classes[k]], 8.0)
                squares[slots] += (step * scale) ** 2
                self.weights[slots] -= 0.3 * step * scale / np.sqrt(squares[slots])
                self.weights[SLOTS] = 0
                self.offset -= 0.01 * step
        logits = np.array([self._logits_of(lines[k]) for k in np.flatnonzero(held)])
        if len(logits):
            own = classes[held]
            losses = [
                (-np.log(_softmax(logits / t)[np.arange(len(own)), own] + 1e-12).mean(), t)
                for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)
            ]
            self.temperature = min(losses)[1]
            self.held_out_accuracy = float((logits.argmax(axis=1) == own).mean())

    def of_lines(self, texts: list[str]) -> np.ndarray:
        """[text, class] of texts without line ends."""
        slots = _slots(texts)
        p = _softmax(np.array([self._logits_of(x) for x in slots]) / self.temperature)
        p[[not self.seen[x].any() for x in slots]] = NOTHING
        return p

    def _logits_of(self, slots: np.ndarray) -> np.ndarray:
        return self.weights[slots].sum(axis=0) / _length(len(slots)) + self.offset

    def probabilities(self, lines: Lines) -> np.ndarray:
        """[line, class]"""
        if not len(lines.starts):
            return np.empty((0, len(CLASSES)))
        each = self.weights[lines.slots[:, 0]] + self.weights[lines.slots[:, 1]]
        total = np.add.reduceat(each, lines.starts, axis=0)
        count = 2 * (lines.ends - lines.starts)
        logits = total / _length(count)[:, None] + self.offset
        p = _softmax(logits / self.temperature)
        p[~np.logical_or.reduceat(self.seen[lines.slots].any(axis=1), lines.starts)] = NOTHING
        return p


def _length(count: np.ndarray | int) -> np.ndarray:
    """What sums over a line are divided by: the root of its slots, and a sixteenth of very many, so
    that a long line is no surer than its words."""
    return np.maximum(np.sqrt(np.maximum(count, 1)), np.asarray(count) / 16)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def variants(notices: tuple[str, ...], filler: list[list[str]], draw: random.Random) -> list[str]:
    """Notices with words dropped, other digits, and other text around them."""
    out = []
    for k in range(VARIANTS):
        own = [x for x in notices[k % len(notices)].split() if draw.random() > 0.08]
        own = [re.sub(r"\d", lambda _: str(draw.randrange(10)), x) for x in own]
        around = draw.choice(filler)[: draw.choice((0, 0, 0, 3, 8))]
        out.append(" ".join(own + around if draw.random() < 0.5 else around + own))
    return out


def _plain(others: list[str]) -> list[str]:
    """Lines that hold no notice."""
    every = [t for templates in TEMPLATES.values() for t in templates]
    pairs = [_pairs(x) for x in others]
    return [
        x
        for x, own in zip(others, pairs, strict=True)
        if all(len(own & t) < 0.5 * len(t) for t in every)
    ]


def _filler(plain: list[str]) -> list[list[str]]:
    return [x.split() for x in plain[:200]] or [["text"]]


def examples(
    others: list[str], seed: int = 5, left_out: frozenset[str] = frozenset()
) -> tuple[list[str], np.ndarray]:
    """Training paragraphs: varied notices, and lines of the corpus that hold no notice."""
    return _examples(_plain(others), seed, left_out)


def _examples(
    plain: list[str], seed: int = 5, left_out: frozenset[str] = frozenset()
) -> tuple[list[str], np.ndarray]:
    draw = random.Random(seed)
    filler = _filler(plain)
    texts, classes = list(plain), [0] * len(plain)
    for number, (family, notices) in enumerate(NOTICES.items(), 1):
        if family in left_out:
            continue
        texts.extend(variants(notices, filler, draw))
        classes.extend([number] * VARIANTS)
        texts.extend(" ".join(draw.choice(filler)[:12]) for _ in range(4))
        classes.extend([0] * 4)
    return texts, np.array(classes)


def _threshold(below: np.ndarray, above: np.ndarray, weight: float) -> float:
    """The value that parts what should lie below from what should lie above it with the least loss;
    one that is wrongly below weighs `weight`. In the middle of the best stretch."""
    ends = np.unique(np.concatenate([[0.0, 1.0], below, above]))
    tried = (ends[1:] + ends[:-1]) / 2
    wrong = np.array([(below >= t).mean() + weight * (above < t).mean() for t in tried])
    best = tried[wrong == wrong.min()]
    return float(best[len(best) // 2])


def calibrated(others: list[str]) -> Classifier:
    """A classifier with thresholds from families that were left out of training in turns."""
    lines = _plain(others)
    seen, half = lines[::2], [x.replace("\n", " ") for x in lines[1::2]]
    families = list(NOTICES)
    draw = random.Random(23)
    unseen, unseen_best, known_best, plain = [], [], [], []
    for turn in range(TURNS):
        left_out = frozenset(families[turn::TURNS])
        model = Classifier(*_examples(seen, left_out=left_out))
        filler = _filler(half)
        for family, notices in NOTICES.items():
            p = model.of_lines(variants(notices, filler, draw))
            if family in left_out:
                unseen.append(p[:, 0])
                unseen_best.append(p[:, 1:].max(axis=1))
            else:
                known_best.append(p[:, 1 + families.index(family)])
        if half:
            plain.append(model.of_lines(half)[:, 0])
    final = Classifier(*_examples(lines))
    unseen, best = np.concatenate(unseen), np.concatenate(unseen_best)
    plain = np.concatenate(plain) if plain else np.ones(1)
    # What the classifier itself holds for a licence is reported, however few lines there are.
    final.doubt = max(0.5, _threshold(unseen, plain, FALSE_WEIGHT))
    final.sure = _threshold(best, np.concatenate(known_best), 1.0)
    final.unseen_recall = float((unseen < final.doubt).mean())
    final.unseen_unnamed = float((best < final.sure).mean())
    final.false_share = float((plain < final.doubt).mean())
    return final


def sample_lines(docs: DataFrame, text: str, bound: int = SAMPLE) -> list[str]:
    """About `bound` distinct lines with words, chosen by a hash of the line; in a fixed order."""
    lines = docs.select(F.explode(F.split(c(text), "\n")).alias("line")).where("line rlike '\\\\w'")
    count = docs.select(F.sum(F.regexp_count(c(text), F.lit("[^\n]+")))).first()[0] or 0
    share = min(1.0, bound / max(count, 1))
    hashed = F.pmod(F.xxhash64("line"), F.lit(1 << 30))
    chosen = lines.where(hashed < int(share * (1 << 30)))
    start = 1 + F.pmod(F.xxhash64(F.lit("place"), "line"), F.greatest(F.length("line") - EXCERPT, F.lit(1)))
    part = F.substring("line", start.cast("int"), F.lit(EXCERPT))
    chosen = chosen.select(F.when(F.length("line") > EXCERPT, part).otherwise(c("line")).alias("line"))
    return sorted(r["line"] for r in chosen.distinct().collect())


def _scan(texts: pa.Array, model: Classifier) -> pa.Array:
    n = len(texts)
    lines = Lines(texts)
    p = model.probabilities(lines)
    found: list[list[dict]] = [[] for _ in range(n)]
    for k in np.flatnonzero(p[:, 0] < model.doubt):
        best = 1 + int(p[k, 1:].argmax())
        family, chance = CLASSES[best], float(p[k, best])
        line = lines.string(k)
        if chance < model.sure or agreement(line, family) < CONFIRM:
            family = UNKNOWN
        found[lines.text[k]].append(
            {"paragraph": int(lines.number[k]), "family": family, "probability": chance}
        )
    item = pa.struct(
        [("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64())]
    )
    return pa.StructArray.from_arrays(
        [pa.array(lines.per_text, pa.int64()), pa.array(found, pa.list_(item))],
        names=["n_paragraphs", "found"],
    )


def scan_rows(
    docs: DataFrame, name: str, text: str = "text", model: Classifier | None = None
) -> DataFrame:
    """The rows with a struct column `name`: n_paragraphs and found (paragraph, family,
    probability). A model may be given; else one is trained on a sample of the rows."""
    if model is None:
        model = calibrated(sample_lines(docs, text))

    def start() -> Callable[[pa.RecordBatch], pa.Array]:
        return lambda part: _scan(part.column(text), model)

    return add_column(docs, name, FOUND, text, start, limit=1 << 20)
