"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line that holds words, or a run of lines that wrap one notice. A softmax regression over sparse word
one- and two-grams tells the licence families and the class unknown apart; it is trained here on variants of the
templates below, on licence words in other company and on paragraphs without licence words. Its scale and the score of
unknown are calibrated on examples that the weights have not seen. A prediction of at least SURE stands only if the
paragraph and a template of the family share their five-word shingles to 0.8 or more, measured on the shorter of the
two, and no other family's template is nearer.

A run is made of neighbouring lines half of whose two-grams licences have. If its lines, each for itself, don't name
different families, and the run as a whole is confirmed, it is one paragraph. Neighbouring lines of one family are too.

Defined cases: null, empty and wordless texts have no paragraphs. Numbers compare as equal, so versions don't matter.
A paragraph of fewer than five words is one shingle. Repeated paragraphs each count. Very long texts are read line by
line. Other columns are not read.
"""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import bounded_sample, table

SHINGLE, SIMILAR, SURE = 5, 0.8, 0.5
#: Variants that training makes of each template; background documents it reads at most, lines of each, and their size.
VARIANTS, BACKGROUND_ROWS, BACKGROUND_LINES, LINE_CHARS = 24, 400, 4, 1000
#: Share of known two-grams that makes a line part of a run.
LIKE = 0.5

# Short notices and characteristic sentences of public licences, by family.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU Lesser General Public License v3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "epl": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "mpl": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "reserved": ["All rights reserved.", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."],
}
# The public short identifiers of each family.
IDENTIFIERS = {
    "apache": ["Apache-2.0"],
    "mit": ["MIT"],
    "bsd": ["BSD-2-Clause", "BSD-3-Clause"],
    "gpl": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"],
    "lgpl": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"],
    "agpl": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "epl": ["EPL-2.0"],
    "mpl": ["MPL-2.0"],
    "isc": ["ISC"],
    "cc-by": ["CC-BY-4.0"],
    "cc-by-sa": ["CC-BY-SA-4.0"],
    "cc-by-nc": ["CC-BY-NC-4.0"],
    "public-domain": ["Unlicense", "CC0-1.0"],
}
for _family, _names in IDENTIFIERS.items():
    TEMPLATES[_family] += [f"SPDX-License-Identifier: {name}" for name in _names]

_CUES_TEXT = "(?i)licen[cs]e|copyright|redistribut|warrant|rights? reserved|public domain"
_words = regex.compile(r"\p{L}+|\p{N}+").findall
_FOUND = "array<struct<family:string,start:int,stop:int,probability:double>>"


def words_of(line: str) -> list[str]:
    """Lower-cased words; every number is #."""
    return ["#" if w[0].isdigit() else w for w in _words(line.lower())]


def grams(words: list[str]) -> set[str]:
    return {*words, *map(" ".join, zip(words, words[1:]))}


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def similarity(a: set, b: set) -> float:
    """Shared shingles over those of the smaller set."""
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def _examples(background: list[str]) -> list[tuple[list[str], str]]:
    """Templates whole, shortened, with words lost and with background words around them; background as unknown."""
    draw = random.Random(7)
    fill = [w for line in background for w in words_of(line)] or ["text"]
    out = [(words_of(line), "unknown") for line in background]
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = words_of(text)
            for k in range(VARIANTS):
                some = words if k < 6 else [w for w in words if draw.random() > 0.1]
                around = [draw.choice(fill) for _ in range(draw.randrange(6))] if k % 2 else []
                out.append((some + around if k % 4 == 1 else around + some, family))
            for _ in range(VARIANTS // 3):  # a few licence words in other company are unknown
                some = draw.sample(words, min(3, len(words)))
                out.append((some + [draw.choice(fill) for _ in range(8)], "unknown"))
    return out


def background(docs: DataFrame, rows: int = BACKGROUND_ROWS) -> list[str]:
    """Beginnings of lines without licence words, a few of each of a bounded number of documents."""
    usable = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\p{L}|\p{N}") & ~x.rlike(_CUES_TEXT))
    lines = F.transform(F.slice(usable, 1, BACKGROUND_LINES), lambda x: F.substring(x, 1, LINE_CHARS))
    chosen = bounded_sample(docs.select("doc_id", "text").where(F.col("text").isNotNull()), "doc_id", rows, docs.count())
    return sorted(line for r in chosen.select(lines.alias("lines")).collect() for line in r["lines"])


def fit(docs: DataFrame, background_rows: int = BACKGROUND_ROWS) -> dict:
    """{families, index: gram -> row, weights (a column for each family, then unknown), bias, scale, unknown}."""
    examples = _examples(background(docs, background_rows))
    counts = Counter(g for words, k in examples if k != "unknown" for g in grams(words))
    index = {g: i for i, g in enumerate(sorted(g for g, n in counts.items() if n >= 6))}
    families = sorted(TEMPLATES)
    classes = [*families, "unknown"]
    x = np.zeros((len(examples), len(index)), np.float32)
    for i, (words, _) in enumerate(examples):
        known = [index[g] for g in grams(words) if g in index]
        x[i, known] = 1 / np.sqrt(max(1, len(known)))
    y = np.array([classes.index(k) for _, k in examples])
    test = np.arange(len(y)) % 3 == 0
    weights, bias = train(x[~test], y[~test], len(classes))
    scale, unknown = calibrate(x[test] @ weights + bias, y[test])
    return {"families": families, "index": index, "weights": weights, "bias": bias, "scale": scale, "unknown": unknown}


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def _misses(p: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    p = p.copy()
    p[np.arange(len(y)), y] -= 1
    return p * share[:, None]


def train(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 300, step: float = 20.0, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a softmax regression in which every class weighs the same."""
    share = 1 / (classes * np.maximum(1, np.bincount(y, minlength=classes)))[y]
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes)
    for _ in range(rounds):
        miss = _misses(softmax(x @ w + b), y, share).astype(np.float32)
        w -= step * (x.T @ miss + ridge * w)
        b -= step * miss.sum(axis=0)
    return w.astype(np.float64), b


def calibrate(z: np.ndarray, y: np.ndarray, rounds: int = 500) -> tuple[float, float]:
    """The scale of all scores and what is added to unknown's, the last class, that fit held-out examples best."""
    share, scale, unknown = np.full(len(y), 1 / len(y)), 1.0, 0.0
    last = np.zeros(z.shape[1])
    last[-1] = 1
    for _ in range(rounds):
        miss = _misses(softmax(scale * z + unknown * last), y, share)
        scale -= 0.05 * float((miss * z).sum())
        unknown -= 0.5 * float(miss[:, -1].sum())
    return max(scale, 0.05), unknown


class Scanner:
    def __init__(self, model: dict):
        self.model = model
        self.templates = {f: [shingles(words_of(t)) for t in texts] for f, texts in TEMPLATES.items()}
        self.first = {g for g in model["index"] if " " not in g}

    def predict(self, words: list[str]) -> tuple[str, float]:
        """(family or unknown, calibrated probability)."""
        m = self.model
        known = [m["index"][g] for g in grams(words) if g in m["index"]] if not self.first.isdisjoint(words) else []
        if not known:  # no word of any licence
            return "unknown", 1.0
        z = m["scale"] * (m["weights"][known].sum(0) / np.sqrt(len(known)) + m["bias"])
        z[-1] += m["unknown"]
        p = softmax(z)
        best = int(np.argmax(p[:-1]))
        return (m["families"][best], float(p[best])) if p[best] >= SURE else ("unknown", float(p[-1]))

    def confirmed(self, words: list[str]) -> tuple[str, float] | None:
        """The prediction for a paragraph, if it is a family whose template it shows."""
        family, p = self.predict(words)
        if family == "unknown":
            return None
        own = shingles(words)
        near = {f: max(similarity(own, t) for t in texts) for f, texts in self.templates.items()}
        return (family, p) if near[family] >= max(SIMILAR, *near.values()) else None

    def is_like(self, words: list[str], follows: bool) -> bool:
        """Whether a line may be part of a run; a single word only if it follows one."""
        pairs = [" ".join(g) for g in zip(words, words[1:])] or (words if follows else [])
        return bool(pairs) and sum(g in self.model["index"] for g in pairs) >= LIKE * len(pairs)

    def scan(self, text: str | None) -> list[dict]:
        found, run, at = [], [], 0
        for line in (text or "").split("\n"):
            words = words_of(line)
            if words and self.is_like(words, bool(run)):
                run.append((at, at + len(line), words, self.confirmed(words)))
            else:
                found += self.paragraphs(run)
                run = []
                if words and (one := self.confirmed(words)):
                    found.append({"family": one[0], "start": at, "stop": at + len(line), "probability": one[1]})
            at += len(line) + 1
        return found + self.paragraphs(run)

    def paragraphs(self, run: list[tuple]) -> list[dict]:
        """The licence paragraphs of a run of lines."""
        if len(run) > 1 and len({one[0] for *_, one in run if one}) < 2:
            whole = self.confirmed([w for _, _, words, _ in run for w in words])
            if whole:
                return [{"family": whole[0], "start": run[0][0], "stop": run[-1][1], "probability": whole[1]}]
        found: list[dict] = []
        for start, stop, _, one in run:
            if one and found and found[-1]["family"] == one[0] and found[-1]["stop"] == start - 1:
                found[-1]["stop"] = stop
                found[-1]["probability"] = max(found[-1]["probability"], one[1])
            elif one:
                found.append({"family": one[0], "start": start, "stop": stop, "probability": one[1]})
        return found


def find_licenses(model: dict, text: Column, spark: SparkSession) -> Column:
    """array<struct(family, start, stop, probability)> of the licence paragraphs of a text column."""
    return _scan_udf(spark.sparkContext.broadcast(model))(text)


def _scan_udf(model):
    kind = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("probability", pa.float64())]))
    made = []

    def scan(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Scanner(model.value))
        return pa.array([made[0].scan(t) for t in texts.to_pylist()], kind)

    return F.arrow_udf(scan, _FOUND)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", find_licenses(fit(docs), F.col("text"), spark).alias("found"))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda s: s["family"]))), ",")
    return found.select("doc_id", F.size("found").cast("long").alias("n_licenses"), families.alias("families"), "found")


QUERIES = {"op2_licenses": op2_licenses}
ORACLE_SQL: dict[str, str] = {}
