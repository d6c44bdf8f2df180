"""Licence scan: a trained classifier of paragraphs, confirmed by templates.

Every line of a text is a paragraph, and so are the lines of a block (what stands between blank lines) that follow each
other without naming a licence each by itself: a notice that is wrapped over lines is judged as one. A paragraph is
described by the word n-grams (one to three words, with at least one content word) that occur in the training notices.
A multinomial logistic regression gives it a probability for each licence family and for "unknown". Its temperature is
fitted on notices that were left out of training whole, so the probabilities are calibrated for wordings that
training didn't see. A prediction counts when a family has at least `least` of the probability, the paragraph shares
enough word pairs with one of that family's templates, and no other family's template is clearly closer. A paragraph
without any content word of the notices, or without any pair of a template, can't be confirmed, so it is passed over at
once with the same outcome.
"""

from __future__ import annotations

import functools
import random
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_texts, read

#: Short notices as licensors write them, by family.
NOTICES: dict[str, tuple[str, ...]] = {
    "apache": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "mit": ("Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "SPDX-License-Identifier: MIT", "Distributed under the MIT licence, see LICENSE.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license.", "SPDX-License-Identifier: BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Released under the BSD 2-Clause license."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.", "Released under the GPL v2 or later.", "Licensed under GPLv3.", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program."),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL v3.", "SPDX-License-Identifier: LGPL-2.1-only", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "You should have received a copy of the GNU Lesser General Public License along with this library.", "Licensed under the GNU Library General Public License, version 2."),
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL v3.", "SPDX-License-Identifier: AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU Affero General Public License along with this program."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Released under the MPL 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "Licensed under the ISC license.", "SPDX-License-Identifier: ISC"),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License, version 2.0.", "Released under the EPL 2.0.", "SPDX-License-Identifier: EPL-2.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Text is available under the Creative Commons Attribution license.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Shared under the Creative Commons Attribution-NonCommercial license.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.", "Dedicated to the public domain under CC0 1.0.", "Released under CC0.", "SPDX-License-Identifier: CC0-1.0"),
    "proprietary": ("All rights reserved.", "Copyright (c) All rights reserved.", "Copyright 2020 Example Corp. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission.", "This software is proprietary and confidential; unauthorized copying is strictly prohibited."),
}
#: Sentences that use the same words for other things.
OTHERS = (
    "She got her driver's license at the age of eighteen.", "The fishing licence must be renewed every year.", "He is a licensed engineer and works for the general public.", "The Apache people lived in the southwest.", "The MIT campus lies by the river.",
    "The new version was released in May.", "The work is public and free of charge for visitors.", "All conditions are met and the source is open.", "Permission to build the road was granted by the council.", "The terms of the contract were modified without notice.",
    "The use of this file is described in the documentation.", "The creative team works on a common project.", "Attribution of the painting is disputed.", "The library is open to any person with a copy of the card.", "The commons were shared by the village under the law.",
    "This program is shown at the theatre with the following cast.", "Software is distributed in binary form.", "The author has rights and duties related to the work.", "The state has a license for the casino.", "International law governs the copy of the form.",
    "All rights of way were reserved by the state.", "She reserved all rights to the seat.", "Human rights are reserved for all people.", "Copyright law protects the author.",
)
STOP = set(b"a an and any are as at be but by can for from has have her his if in is it its lies may must no not of on or part see she that the their this to under was were which who with without you every new each all".split())
#: Runs of letters, and numbers of versions; names such as CC-BY-4.0 fall into their parts.
WORD = re.compile(rb"[a-z\x80-\xff]+|[0-9]+(?:\.[0-9]+)*")
SIMILAR, LEAST = 0.5, 0.5
#: A family is clearly closer if it holds so much more of a template; left-out parts of the notices for calibration.
CLOSER, FOLDS = 0.15, 3


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def grams(found: list[bytes]) -> set[tuple[bytes, ...]]:
    """n-grams of one to three words that hold a content word."""
    return {g for n in (1, 2, 3) for g in zip(*(found[i:] for i in range(n)), strict=False) if not STOP.issuperset(g)}


def pairs(found: list[bytes]) -> set[tuple[bytes, ...]]:
    return set(zip(found, found[1:], strict=False)) if len(found) > 1 else {tuple(found)}


@dataclass
class Model:
    families: list[str]  # the first is "unknown"
    index: dict[tuple[bytes, ...], int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: dict[str, list[set]]
    content: frozenset = field(default_factory=frozenset)
    every_pair: frozenset = field(default_factory=frozenset)  # of all templates

    def may_name(self, found: list[bytes]) -> bool:
        """Whether the words hold a content word and a pair of some template: without both, nothing can be confirmed."""
        return not self.content.isdisjoint(found) and not self.every_pair.isdisjoint(zip(found, found[1:], strict=False) if len(found) > 1 else (tuple(found),))

    def probabilities(self, found: list[bytes]) -> np.ndarray:
        at = [i for g in grams(found) if (i := self.index.get(g)) is not None]
        logits = (self.bias + self.weights[at].sum(axis=0)) / self.temperature
        odds = np.exp(logits - logits.max())
        return odds / odds.sum()

    def similarity(self, found: list[bytes], family: str) -> float:
        """The largest share of a template's word pairs that the paragraph holds."""
        own = pairs(found)
        return max(len(own & t) / len(t) for t in self.templates[family])

    def judge(self, found: list[bytes], least: float = LEAST) -> tuple[str, float, float] | None:
        """(family, probability, similarity) if the paragraph names a licence."""
        if not self.may_name(found):
            return None
        p = self.probabilities(found)
        best = int(p.argmax())
        if best == 0 or p[best] < least or (near := self.similarity(found, self.families[best])) < SIMILAR:
            return None
        if near < 1 and any(self.similarity(found, f) > near + CLOSER for f in self.families[1:]):
            return None
        return self.families[best], float(p[best]), near

    def find(self, text: bytes, least: float = LEAST) -> tuple[int, list[dict]]:
        """(lines with a word; the licences with their first line's number among these, from 0)."""
        lines = [None if not line or line.isspace() else line for line in text.split(b"\n")]
        n = sum(line is not None for line in lines)
        if not n or not self.may_name(words(text)):
            return n, []
        hits: list[tuple[int, tuple[str, float, float]]] = []
        wrapped: list[tuple[int, list[bytes]]] = []  # lines in a row that may be part of a notice and name none by themselves
        number = 0

        def unwrap() -> None:
            if len(wrapped) > 1 and (hit := self.judge([w for _, found in wrapped for w in found], least)):
                hits.append((wrapped[0][0], hit))
            wrapped.clear()

        for line in lines:
            found = words(line) if line is not None else []
            if hit := self.judge(found, least) if found else None:
                hits.append((number, hit))
            if hit or not self.may_name(found):
                unwrap()
            else:
                wrapped.append((number, found))
            number += line is not None
        unwrap()
        return n, [{"paragraph": i, "family": f, "probability": p, "similarity": s} for i, (f, p, s) in sorted(hits)]


def variants(notice: str, r: random.Random, fillers: list[str]) -> str:
    """The notice as others might write it: words lost, words around it, other case, no punctuation."""
    found = [w for w in notice.split() if r.random() > 0.08]
    lead = [r.choice(fillers) for _ in range(r.choice((0, 0, 0, 2, 12)))]
    tail = [r.choice(fillers) for _ in range(r.choice((0, 0, 0, 2, 12)))]
    text = " ".join([*lead, *found, *tail])
    return r.choice((str, str, str.upper, str.lower, lambda t: re.sub(r"[.,;:()\"]", "", t)))(text)


def left_out(label: int, notice: int, fold: int) -> bool:
    """Whether the notice belongs to the fold, all its variants with it."""
    return (label + notice) % FOLDS == fold


@functools.lru_cache(maxsize=1)
def examples(copies: int = 25, seed: int = 3) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the n-grams, features, label, fold of each variant of each notice); the first label is "unknown"."""
    r = random.Random(seed)
    fillers = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(400)] + "the of and in is to a for software file code project work".split()
    rows: list[tuple[set, int, int]] = []
    for label, notices in enumerate([OTHERS, *NOTICES.values()]):
        for i, notice in enumerate(notices):
            rows += [(grams(words(variants(notice, r, fillers).encode())), label, next(f for f in range(FOLDS) if left_out(label, i, f))) for _ in range(copies)]
    everyday = [w for o in OTHERS for w in o.split()]
    rows += [(grams(words(" ".join(r.choice(everyday + fillers) for _ in range(r.randint(3, 40))).encode())), 0, k % FOLDS) for k in range(800)]
    known = {g for ns in (*NOTICES.values(), OTHERS) for n in ns for g in grams(words(n.encode()))}
    index = {g: i for i, g in enumerate(sorted(known))}
    x = np.zeros((len(rows), len(index)), np.float32)
    for row, (found, _, _) in zip(x, rows, strict=True):
        row[[index[g] for g in found if g in index]] = 1
    return index, x, np.array([label for _, label, _ in rows]), np.array([fold for _, _, fold in rows])


def regression(x: np.ndarray, labels: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by gradient descent with momentum, a quadratic penalty and soft-thresholded (sparse) weights."""
    target = np.eye(classes, dtype=np.float32)[labels]
    weights, bias, speed, lift = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32), 0.0, 0.0
    for _ in range(150):
        p = softmax(x @ weights + bias)
        speed = 0.9 * speed + (x.T @ (p - target) / len(x) + 1e-4 * weights)
        lift = 0.9 * lift + (p - target).mean(axis=0)
        weights, bias = weights - speed, bias - lift
        weights = np.sign(weights) * np.maximum(np.abs(weights) - 1e-4, 0)
    return weights, bias


@functools.lru_cache(maxsize=1)
def unseen_logits() -> tuple[np.ndarray, np.ndarray]:
    """(logits, labels) of every variant, from a regression that saw no variant of the same notice."""
    _, x, labels, folds = examples()
    logits = np.zeros((len(x), 1 + len(NOTICES)), np.float32)
    for fold in range(FOLDS):
        out = folds == fold
        weights, bias = regression(x[~out], labels[~out], logits.shape[1])
        logits[out] = x[out] @ weights + bias
    return logits, labels


def reliability(temperature: float, bins: int = 5) -> list[tuple[float, float, int]]:
    """(mean probability of the likeliest class, its share of right answers, variants) by bins of that probability, over left-out notices."""
    logits, labels = unseen_logits()
    p = softmax(logits / temperature)
    sure, right = p.max(axis=1), p.argmax(axis=1) == labels
    at = np.minimum((sure * bins).astype(int), bins - 1)
    return [(float(sure[at == b].mean()), float(right[at == b].mean()), int((at == b).sum())) for b in range(bins) if (at == b).any()]


@functools.lru_cache(maxsize=1)
def trained() -> Model:
    index, x, labels, _ = examples()
    families = ["unknown", *NOTICES]
    weights, bias = regression(x, labels, len(families))
    logits, truth = unseen_logits()
    temperature = min(np.linspace(0.2, 4, 77), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean())
    templates = {f: [pairs(words(n.encode())) for n in notices] for f, notices in NOTICES.items()}
    content = frozenset(w for g in index for w in g if len(g) == 1)
    return Model(families, index, weights, bias, float(temperature), templates, content, frozenset().union(*(t for ts in templates.values() for t in ts)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


FOUND = T.StructType([T.StructField("paragraph", T.IntegerType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("similarity", T.DoubleType())])


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model: Model | None = None, least: float = LEAST) -> DataFrame:
    """`keep`, n_paragraphs (lines with a word) and licences: an array of paragraph number (of its first line, from 0), family, probability, similarity.

    Null and empty texts have no paragraph. Repeated rows are scanned each; an empty table gives an empty result; kept
    columns of the results' names give way to them. Of the model only notices are learned, no document.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())

    def start():
        model = shared.value

        def work(texts):
            made = [model.find(t or b"", least) for t in texts]
            return [n for n, _ in made], [h for _, h in made]

        return work

    return map_texts(docs, text, keep, T.StructType([T.StructField("n_paragraphs", T.LongType()), T.StructField("licences", T.ArrayType(FOUND))]), start)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_paragraphs, n_licences, families (distinct, sorted, joined by a comma; empty if none), probability (the largest; 0 if none)."""
    found = scan(read(spark, sf_dir, "documents"))
    families = F.array_join(F.array_sort(F.array_distinct(F.col("licences.family"))), ",")
    return found.select("doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licences"), families.alias("families"), F.coalesce(F.array_max("licences.probability"), F.lit(0.0)).alias("probability"))
