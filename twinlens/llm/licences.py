"""Licence scan: a trained paragraph classifier confirmed by template comparison.

Paragraphs are the ``\\n``-separated parts of a text. Notices that are wrapped over lines
(also behind comment marks) or stand inside long lines are seen in *passages*: windows
of ``WINDOWS`` words over the whole text, whatever its line breaks. A softmax regression
over hashed word one- and two-grams names a licence family or ``unknown``. It learns from
a bounded sample: paragraphs and passages that contain a template (weak labels), templates
with words dropped or replaced, and the others of the corpus as ``unknown``; a part is
set aside to fit the temperature of the probabilities and the cut below which a
paragraph stays unknown. A prediction counts when a template confirms it: enough of the
template's word pairs occur in the paragraph. Licences share sentences, so the family is
that of the template with the largest share. A passage is counted when it names a family
that the text has not shown yet.

Rows: NULL text has no paragraphs; repeated rows are scanned alike; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.text import mix, ragged, slices, words_of

# Notices, headers and body paragraphs by which the families are known.
_GNU = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
    "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
    "of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.",
    "You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>.",
)


def _gnu(what: str, name: str) -> tuple[str, ...]:
    return tuple(t.format(what=what, name=name) for t in _GNU)


TEMPLATES = {
    "agpl": ("This work is licensed under the GNU Affero General Public License, version 3.", *_gnu("program", "Affero General Public License")),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software',
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.",
        "may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights "
        "to the work worldwide under copyright law",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 "
        "which accompanies this distribution, and is available at",
        "are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", *_gnu("program", "General Public License")),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 3.", *_gnu("library", "Lesser General Public License")),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction,',
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so,",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE",
        "This source code is licensed under the MIT license found in the LICENSE file in the root directory of this source tree.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions:",
    ),
}
FAMILIES = tuple(TEMPLATES)  # class k + 1; class 0 is unknown
TERMS = 4096
SAMPLE_DOCS = 250  # documents whose paragraphs serve as unknown examples
VARIANTS = 60  # altered copies of each template
CONFIRM = 0.6  # share of the template's word pairs
WINDOWS = (24, 80)  # words of a passage; each begins half a passage after the one before
SAMPLE_WINDOWS = 1500  # passages of the sample documents in the training rows
_MARKS = np.zeros(256, bool)  # words of these bytes alone are comment marks
_MARKS[list(b"#*/;%-|>")] = True


@dataclass
class LicenceModel:
    weights: np.ndarray  #: TERMS + 1 rows (the last is the bias), one column per class
    temperature: float
    cut: float  #: least probability of a family
    pairs: TemplatePairs


def _paragraphs(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Non-blank paragraphs of all texts and the text of each."""
    lists = pa.array([[p for p in (t or "").split("\n") if p.strip()] for t in column.to_pylist()], pa.list_(pa.string()))
    return lists.flatten(), np.repeat(np.arange(len(column)), [len(x) for x in lists])


Grams = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _paired(hashes: np.ndarray, doc: np.ndarray) -> Grams:
    """Hash and row of each word, and of each pair of neighbours."""
    if len(doc) < 2:
        return hashes, doc, hashes[:0], doc[:0]
    pair = mix(hashes[:-1] * np.uint64(3) + hashes[1:])
    inside = doc[:-1] == doc[1:]
    return hashes, doc, pair[inside], doc[:-1][inside]


def _grams(column: pa.Array) -> Grams:
    w = words_of(column)
    return _paired(w.hash, w.doc)


def _passages(column: pa.Array) -> Iterator[tuple[Grams, np.ndarray]]:
    """Per window length the grams of all passages (without comment marks) and the text of each passage."""
    w = words_of(column)
    plain = np.append(0, np.cumsum(~_MARKS[w.data]))
    told = plain[w.end] > plain[w.start]
    hashes, doc = w.hash[told], w.doc[told]
    counts = np.bincount(doc, minlength=w.texts)
    first = np.cumsum(counts) - counts
    for window in WINDOWS:
        step = window // 2
        many = np.where(counts > 0, np.maximum(1, -(-(counts - step) // step)), 0)
        text = np.repeat(np.arange(w.texts), many)
        at = ragged(np.zeros(w.texts, np.int64), many) * step
        size = np.minimum(window, counts[text] - at)
        yield _paired(hashes[ragged(first[text] + at, size)], np.repeat(np.arange(len(text)), size)), text


def _scores(grams: Grams, n: int, weights: np.ndarray) -> np.ndarray:
    """Class scores of each of ``n`` rows: the mean weight of its distinct kinds of terms, plus bias."""
    one, at_one, two, at_two = grams
    out = np.zeros((n, weights.shape[1]), np.float32)
    half = np.uint64(TERMS // 2)
    size = np.ones(n)
    for hashes, at, shift in ((one, at_one, 0), (two, at_two, TERMS // 2)):
        if len(hashes):
            rows = weights[(hashes % half).astype(np.int64) + shift]
            start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            out[at[start]] += np.add.reduceat(rows, start, axis=0)
            size += np.bincount(at, minlength=n)
    return out / np.sqrt(size)[:, None].astype(np.float32) + weights[-1]


def _design(grams: Grams, n: int) -> np.ndarray:
    """Rows of the training matrix; equal to what ``_scores`` multiplies."""
    one, at_one, two, at_two = grams
    rows = np.zeros((n, TERMS + 1), np.float32)
    np.add.at(rows, (at_one, (one % np.uint64(TERMS // 2)).astype(np.int64)), 1)
    np.add.at(rows, (at_two, (two % np.uint64(TERMS // 2)).astype(np.int64) + TERMS // 2), 1)
    size = 1 + np.bincount(at_one, minlength=n) + np.bincount(at_two, minlength=n)
    rows /= np.sqrt(size)[:, None]
    rows[:, -1] = 1
    return rows


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class TemplatePairs:
    hashes: np.ndarray  #: distinct word pairs of one template after the other
    first: np.ndarray  #: where each template begins
    size: np.ndarray
    family: np.ndarray  #: index in FAMILIES of each template


def _confirmed(pairs: np.ndarray, templates: TemplatePairs, guess: int = -1) -> int | None:
    """Family whose template has the largest share of its word pairs among ``pairs``, if that is enough.

    Among equal shares ``guess`` wins.
    """
    shares = np.add.reduceat(np.isin(templates.hashes, pairs).astype(np.int64), templates.first) / templates.size
    top = templates.family[shares == shares.max()]
    if shares.max() < CONFIRM:
        return None
    return guess if guess in top else int(top[0])


def _pairs_of(grams: Grams, row: int) -> np.ndarray:
    a, b = np.searchsorted(grams[3], (row, row + 1))
    return grams[2][a:b]


def _template_pairs() -> TemplatePairs:
    family = np.repeat(np.arange(len(FAMILIES)), [len(TEMPLATES[f]) for f in FAMILIES])
    pairs = [np.unique(_grams(pa.array([t]))[2]) for f in FAMILIES for t in TEMPLATES[f]]
    size = np.array([len(t) for t in pairs])
    return TemplatePairs(np.concatenate(pairs), np.cumsum(size) - size, size, family)


def _variants(rng: np.random.Generator, others: list[str]) -> tuple[list[str], list[int]]:
    """Templates with words dropped, replaced or put between other words."""
    texts, classes = [], []
    pool = np.array(" ".join(others).split() or ["text"])
    for k, family in enumerate(FAMILIES):
        for template in TEMPLATES[family]:
            for i in range(VARIANTS):
                words = template.split()
                share = (i % 4) * 0.08
                words = [str(rng.choice(pool)) if rng.random() < share / 2 else w for w in words if rng.random() >= share / 2]
                if i % 3 == 0:
                    # as in a line, or in a passage of either length
                    around = [str(x) for x in rng.choice(pool, int(rng.integers(1, (12, 24, 60)[i // 3 % 3])))]
                    words = around + words if i % 2 else words + around
                texts.append(" ".join(words))
                classes.append(k + 1)
    return texts, classes


def fit(docs: DataFrame) -> LicenceModel:
    """Train on the paragraphs of at most ``SAMPLE_DOCS`` documents and on altered templates."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # two passes: tasks send numbers to find the sample, and only the sample's own texts travel
    order = F.struct(F.xxhash64("doc_id").alias("id"), F.xxhash64(text).alias("text"))
    last = docs.select(order.alias("order")).distinct().orderBy("order").limit(SAMPLE_DOCS).agg(F.max("order")).first()[0]
    chosen = docs.select(order.alias("order"), text.alias("text"))
    if last is not None:
        chosen = chosen.where(F.col("order") <= F.struct(F.lit(last["id"]), F.lit(last["text"])))
    # equal rows count once, so no more than SAMPLE_DOCS texts reach the driver
    sample = chosen.dropDuplicates(["order"]).orderBy("order").collect()
    pairs = _template_pairs()

    def weak(grams: Grams, n: int) -> np.ndarray:
        """Class of each row by its templates; rows without any of their pairs need no look."""
        found = np.zeros(n, np.int64)
        for i in np.unique(grams[3][np.isin(grams[2], pairs.hashes)]).tolist():
            family = _confirmed(_pairs_of(grams, i), pairs)
            found[i] = 0 if family is None else family + 1
        return found

    texts = [p for r in sample for p in r.text.split("\n") if p.strip()]
    classes = weak(_grams(pa.array(texts, pa.string())), len(texts)).tolist()
    rng = np.random.default_rng(5)
    others = [t for t, k in zip(texts, classes, strict=True) if k == 0][:300]
    # licence words without a template are unknown as well
    loose = sorted({w for notices in TEMPLATES.values() for t in notices for w in t.split()})
    texts += [" ".join(str(x) for x in rng.choice(loose, int(rng.integers(1, 7)))) for _ in range(300)]
    classes += [0] * 300
    more, kinds = _variants(rng, others)
    x, y = [_design(_grams(pa.array(texts + more, pa.string())), len(texts + more))], [np.array(classes + kinds)]
    for grams, text in _passages(pa.array([r.text for r in sample], pa.string())):
        n = min(len(text), SAMPLE_WINDOWS // len(WINDOWS))
        cut_one, cut_two = np.searchsorted(grams[1], n), np.searchsorted(grams[3], n)
        some = (grams[0][:cut_one], grams[1][:cut_one], grams[2][:cut_two], grams[3][:cut_two])
        x.append(_design(some, n))
        y.append(weak(some, n))
    x, y = np.concatenate(x), np.concatenate(y)
    order = rng.permutation(len(y))
    train, held = order[: len(y) * 4 // 5], order[len(y) * 4 // 5 :]
    target = np.eye(len(FAMILIES) + 1, dtype=np.float32)[y]
    weights = np.zeros((TERMS + 1, len(FAMILIES) + 1), np.float32)
    speed = np.zeros_like(weights)
    seen, told = x[train], target[train]
    for _ in range(150):
        slope = seen.T @ (_softmax(seen @ weights) - told) / len(train) + 1e-5 * weights
        speed = 0.9 * speed - 3.0 * slope
        weights += speed
    z = x[held] @ weights
    # calibration on rows that were set aside
    loss = [(-np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-9).mean(), t) for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0)]
    temperature = min(loss)[1]
    top = _softmax(z / temperature)[:, 1:].max(1)
    wrong = np.sort(top[y[held] == 0])[::-1]
    cut = float(np.clip(wrong[len(wrong) // 200] if len(wrong) else 0.5, 0.5, 0.9))  # at most 0.5% of unknown pass
    return LicenceModel(weights, temperature, cut, pairs)


_SCHEMA = "n_paragraphs long, n_predicted long, n_confirmed long, families string"


def _scan(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        for part in slices(batch):
            paragraphs, doc = _paragraphs(part.column("text"))
            n = part.num_rows
            predicted, confirmed = np.zeros(n, np.int64), np.zeros(n, np.int64)
            names: list[set[str]] = [set() for _ in range(n)]
            shown: list[set[int]] = [set() for _ in range(n)]
            for grams, text, whole in [
                (_grams(paragraphs), doc, True),
                *((grams, text, False) for grams, text in _passages(part.column("text"))),
            ]:
                if not len(text):
                    continue
                chance = _softmax(_scores(grams, len(text), model.weights) / model.temperature)
                best = chance[:, 1:].argmax(1)
                for i in np.flatnonzero(chance[np.arange(len(best)), best + 1] >= model.cut).tolist():
                    family = _confirmed(_pairs_of(grams, i), model.pairs, int(best[i]))
                    kind = best[i] if family is None else family
                    if whole or kind not in shown[text[i]]:
                        predicted[text[i]] += 1
                    if family is not None and (whole or FAMILIES[family] not in names[text[i]]):
                        confirmed[text[i]] += 1
                        names[text[i]].add(FAMILIES[family])
                    shown[text[i]].add(kind)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.bincount(doc, minlength=n)), pa.array(predicted), pa.array(confirmed),
                 pa.array([",".join(sorted(x)) for x in names])],
                names=["doc_id", "n_paragraphs", "n_predicted", "n_confirmed", "families"],
            )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_predicted, n_confirmed, families (sorted, joined by commas) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))  # TERMS x classes floats
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        partial(_scan, shared=shared), f"doc_id {kind}, {_SCHEMA}"
    )
