"""Licence scans with a trained paragraph classifier.

Method: a sparse logistic regression over word n-grams (1 to 3 words) gives each paragraph the probability of each licence
family and of ``unknown``. It is trained here, on noisy renderings of the templates below and, for ``unknown``, on paragraphs of
a bounded sample of documents and on look-alike sentences. Probabilities are calibrated by a temperature and a threshold for
``unknown``, both fitted on renderings that were held back. A predicted family is confirmed by comparing the paragraph with the
family's templates: the share of a template's word pairs that it holds.

Paragraphs are lines; a line of more than ``SPAN`` words is read in spans that overlap by half. A notice may be wrapped over
lines, so lines that no blank line parts are also joined and read in such spans. Only n-grams of the templates
carry weights, so a paragraph is scored from these alone. The model is a few thousand numbers at any input size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import lean, send

UNKNOWN = "unknown"
SAMPLE_DOCS = 300  # documents that unknown paragraphs are drawn from: those with the smallest hashes of their ids
SAMPLE_PARAGRAPHS = 2_000
PARAGRAPH_BYTES = 1 << 14  # longer ones (of few but very long words) aren't drawn
RENDERINGS = 60  # of each template
SPAN = 48  # words; no template is longer
CONFIRM = 0.5  # share of a template's word pairs that confirms a family
FALSE_ALARM = 0.001  # share of held back unknown paragraphs that may pass the threshold
BATCH_BYTES = 4 << 20
#: Opening or notice texts of public licences, # for a year, number or name.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" '
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        "merge, publish, distribute, sublicense, and/or sell copies of the Software",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version #.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version # of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version #.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version #.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC #.#.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial #.# International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA #.#.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike #.# International License.",
    ),
    "CC-BY": (
        "Licensed under CC BY #.#.",
        "This work is licensed under a Creative Commons Attribution #.# International License.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    ),
    "Proprietary": (
        "Copyright # #. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced or transmitted in any form without written permission.",
    ),
}
#: Sentences with licence words that state no licence.
LOOKALIKES = (
    "The driver lost his license after the third version of the accident report was published.",
    "The software is free of charge this week and the general public may use it.",
    "A source close to the foundation said that the terms of the work were modified.",
    "Permission was granted to copy the documentation files for the library.",
    "Version 2.0 of the program was released under the name of its first author.",
    "The public library distributes copies of the book without restriction.",
    "The Apache helicopter is subject to conditions of any kind of weather.",
    "MIT students released the source of their project for a particular purpose.",
    "This work is provided as is by the creative team and all rights remain with them.",
)
_KEEP = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 or b == 1 else 0x20 for b in range(256))
_LINE = b"\x01"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of letters and digits; a line end is the word \\x01."""
    return (text or "").encode().replace(b"\x01", b" ").replace(b"\n", b" \x01 ").translate(_KEEP).split()


def _paragraphs(words: list[bytes]) -> list[list[bytes]]:
    out, line = [], []
    for w in [*words, _LINE]:
        if w == _LINE:
            step = max(1, SPAN // 2)
            out += [line[i : i + SPAN] for i in range(0, max(1, len(line) - step), step)] if len(line) > SPAN else [line] if line else []
            line = []
        else:
            line.append(w)
    return out


def _wrapped(ids: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(first paragraph, last paragraph, ids) of spans over two and more lines that no blank line parts."""
    ends = np.flatnonzero(ids == -2)
    begins, ends = np.concatenate([[0], ends + 1]), np.concatenate([ends, [len(ids)]])
    lengths, step = ends - begins, max(1, SPAN // 2)
    parts = np.where(lengths > SPAN, -(-np.maximum(1, lengths - step) // step), np.minimum(lengths, 1))
    first, out = np.cumsum(parts) - parts, []
    blank = np.concatenate([[-1], np.flatnonzero(lengths == 0), [len(lengths)]])
    for before, after in zip(blank[:-1].tolist(), blank[1:].tolist(), strict=True):
        if after - before < 3:
            continue
        line = np.repeat(np.arange(before + 1, after), lengths[before + 1 : after])
        some = ids[begins[before + 1] : ends[after - 1]]
        some = some[some != -2]
        for i in range(0, max(1, len(some) - step), step):
            j = min(i + SPAN, len(some)) - 1
            if line[i] != line[j]:
                out.append((int(first[line[i]]), int(first[line[j]] + parts[line[j]]) - 1, some[i : j + 1]))
    return out


class Model:
    """n-gram vocabulary, weights (n-gram by class; the last class is unknown), bias, temperature, threshold, templates."""

    def __init__(self):
        self.families = list(TEMPLATES)
        self.template_words = {f: [words_of(t.replace("#", " ")) for t in texts] for f, texts in TEMPLATES.items()}
        every = [w for texts in self.template_words.values() for w in texts]
        self.words = {w: i for i, w in enumerate(sorted({w for t in every for w in t}))}
        self.n = len(self.words)
        grams = set(range(self.n))
        for t in every:
            ids = [self.words[w] for w in t]
            grams.update((ids[i] + 1) * self.n + ids[i + 1] for i in range(len(ids) - 1))
            grams.update(((ids[i] + 1) * self.n + ids[i + 1] + 1) * self.n + ids[i + 2] for i in range(len(ids) - 2))
        self.grams = np.array(sorted(grams), dtype=np.int64)
        self.pairs = {f: [{(self.words[a], self.words[b]) for a, b in zip(t, t[1:], strict=False)} for t in texts] for f, texts in self.template_words.items()}
        classes = len(self.families) + 1
        self.weights, self.bias = np.zeros((len(self.grams), classes)), np.zeros(classes)
        self.temperature, self.threshold = 1.0, 0.5

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self.words.get(w, -2 if w == _LINE else -1) for w in words), np.int64, len(words))

    def features(self, ids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature, group) of all known n-grams that don't cross groups."""
        found, owner = [], []
        code, inside = ids, ids >= 0
        for length in (1, 2, 3):
            if length > 1:
                tail = ids[length - 1 :]
                head = code[: len(tail)]
                inside = inside[: len(tail)] & (tail >= 0) & (group[length - 1 :] == group[: len(tail)])
                code = (head + 1) * self.n + tail
            some = code[inside]
            at = np.minimum(np.searchsorted(self.grams, some), len(self.grams) - 1)
            known = self.grams[at] == some
            found.append(at[known])
            owner.append(group[: len(code)][inside][known])
        return np.concatenate(found), np.concatenate(owner)

    def logits(self, ids: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
        feature, owner = self.features(ids, group)
        order = np.argsort(owner, kind="stable")
        feature, owner = feature[order], owner[order]
        out = np.tile(self.bias, (n, 1))
        if len(owner):
            begins = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
            out[owner[begins]] += np.add.reduceat(self.weights[feature], begins, axis=0)
        return out

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        scaled = logits / self.temperature
        scaled = np.exp(scaled - scaled.max(1, keepdims=True))
        return scaled / scaled.sum(1, keepdims=True)

    def confirmation(self, family: str, ids: list[int]) -> float:
        """The largest share of a template's word pairs that stand in the paragraph."""
        held = set(zip(ids, ids[1:], strict=False))
        return max((len(pairs & held) / len(pairs) for pairs in self.pairs[family] if pairs), default=0.0)


def _renderings(model: Model, rng: np.random.Generator) -> tuple[list[list[bytes]], list[int]]:
    """Noisy copies of the templates: some words lost, years and names put in, other words around them."""
    filler = [b"2019", b"2024", b"3", b"4", b"0", b"acme", b"corp", b"the", b"of", b"file", b"see", b"note", b"in", b"and"]
    texts, classes = [], []
    for k, family in enumerate(model.families):
        for template in TEMPLATES[family]:
            for i in range(RENDERINGS):
                words = words_of(template.replace("#", " 4 " if i % 2 else " 3 "))
                if i:
                    words = [w for w in words if rng.random() > (0.08 if len(words) > 6 else 0.0)]
                    pad = [filler[j] for j in rng.integers(0, len(filler), rng.integers(0, 6))]
                    cut = int(rng.integers(0, len(pad) + 1))
                    words = pad[:cut] + words + pad[cut:]
                texts.append(words)
                classes.append(k)
    return texts, classes


def train(unknown: list[list[bytes]], seed: int = 5, rounds: int = 150, l2: float = 1e-4) -> Model:
    """Fit on three quarters of the renderings and unknown paragraphs, calibrate on the rest."""
    model, rng = Model(), np.random.default_rng(seed)
    texts, classes = _renderings(model, rng)
    look = [words_of(t) for t in LOOKALIKES] * 6
    texts += look + unknown
    classes = np.array(classes + [len(model.families)] * (len(look) + len(unknown)))
    group = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    ids = model.ids([w for t in texts for w in t])
    feature, owner = model.features(ids, group)
    held = np.arange(len(texts)) % 4 == 3
    x = np.zeros((len(texts), len(model.grams)), dtype=np.float32)
    np.add.at(x, (owner, feature), 1)
    target = np.eye(len(model.families) + 1, dtype=np.float32)[classes]
    share = target[~held].sum(0)
    weight = (1 / np.maximum(share, 1))[classes[~held]][:, None] / len(share)
    w, b = np.zeros((x.shape[1], target.shape[1]), dtype=np.float32), np.zeros(target.shape[1], dtype=np.float32)
    squares_w, squares_b = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    fit = x[~held]
    for _ in range(rounds):  # gradient descent with a step of each weight's own
        z = fit @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - target[~held]) * weight
        grad_w, grad_b = fit.T @ error + l2 * w, error.sum(0)
        squares_w += grad_w**2
        squares_b += grad_b**2
        w -= 0.3 * grad_w / np.sqrt(squares_w)
        b -= 0.3 * grad_b / np.sqrt(squares_b)
    w[np.abs(w) < 1e-3] = 0
    model.weights, model.bias = w.astype(np.float64), b.astype(np.float64)
    logits, truth = x[held].astype(np.float64) @ model.weights + model.bias, classes[held]
    losses = []
    temperatures = np.geomspace(0.25, 8, 26)
    for model.temperature in temperatures:
        p = model.probabilities(logits)[np.arange(len(truth)), truth]
        losses.append(-np.log(np.maximum(p, 1e-12)).mean())
    model.temperature = float(temperatures[int(np.argmin(losses))])
    p = model.probabilities(logits)
    wrong = 1 - p[truth == len(model.families), -1]
    model.threshold = float(max(0.5, np.quantile(wrong, 1 - FALSE_ALARM) if len(wrong) else 0.5))
    return model


def unknown_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[list[bytes]]:
    """Paragraphs of a bounded sample of documents that hold no half of any template, in order of the hashes of ids and texts.

    The ``SAMPLE_DOCS`` texts with the smallest hashes (of those of equal ids the smallest digests) are cut in tasks; at most
    ``SAMPLE_PARAGRAPHS`` paragraphs of at most ``PARAGRAPH_BYTES`` bytes leave them, the same ones whatever the partitions are.
    """
    known = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(id_col).alias("rank"), F.sha2(text_col, 256).alias("digest"), F.col(text_col).alias("text"))
    last = known.select("rank", "digest").distinct().orderBy("rank", "digest").limit(SAMPLE_DOCS).agg(F.max(F.struct("rank", "digest"))).first()[0]
    if last is None:
        return []
    sent = send(docs.sparkSession, Model())

    def cut(batches):
        model = sent()
        for batch in batches:
            for rank, digest, text in zip(*batch.columns, strict=True):
                found = []
                for nth, words in enumerate(_paragraphs(words_of(text.as_py()))):
                    ids, size = model.ids(words).tolist(), sum(map(len, words))
                    if size <= PARAGRAPH_BYTES and all(model.confirmation(f, ids) < CONFIRM / 2 for f in model.families):
                        found.append((nth, b" ".join(words)))
                    if len(found) == SAMPLE_PARAGRAPHS:
                        break
                n = len(found)
                yield pa.RecordBatch.from_pydict(
                    {"rank": pa.array([rank.as_py()] * n, pa.int64()), "digest": pa.array([digest.as_py()] * n, pa.string()), "nth": pa.array([i for i, _ in found], pa.int64()), "words": pa.array([w for _, w in found], pa.binary())}
                )

    within = (F.col("rank") < last["rank"]) | ((F.col("rank") == last["rank"]) & (F.col("digest") <= last["digest"]))
    pieces = known.where(within).mapInArrow(lean(cut), "rank long, digest string, nth long, words binary").distinct()
    return [bytes(r.words).split(b" ") for r in pieces.orderBy("rank", "digest", "nth").limit(SAMPLE_PARAGRAPHS).collect()]


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_paragraphs, matches (paragraph, family, probability, similarity, confirmed).

    A match is a paragraph whose family is likelier than the calibrated threshold; it is confirmed if its similarity to a
    template of the family is at least CONFIRM. A span over lines is a match, at its first paragraph, if it is confirmed and
    none of its lines is for that family. Null and empty texts have no paragraphs. Rows are independent; repeated rows
    give repeated results, an empty table gives an empty one. Only the two named columns are read.
    """
    sent = send(docs.sparkSession, model)
    match = T.StructType(
        [
            T.StructField("paragraph", T.LongType()),
            T.StructField("family", T.StringType()),
            T.StructField("probability", T.DoubleType()),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("confirmed", T.BooleanType()),
        ]
    )
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_paragraphs", T.LongType()), T.StructField("matches", T.ArrayType(match))]
    )
    kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]))

    def judge(texts: list[str | None], m: Model) -> tuple[list[int], list[list[dict]]]:
        ids_of, counts, sizes, spans = [], [], [], []
        for text in texts:
            words = words_of(text)
            ids = m.ids(words)
            spans += [(len(counts), *span) for span in _wrapped(ids)]
            ends = np.flatnonzero(ids == -2)
            lengths = np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1
            if (lengths > SPAN).any():
                parts = [m.ids(p) for p in _paragraphs(words)]
                ids, lengths = np.concatenate(parts), np.array([len(p) for p in parts])
            else:
                ids = ids[ids != -2]
                lengths = lengths[lengths > 0]
            ids_of.append(ids)
            sizes.append(lengths)
            counts.append(len(lengths))
        ids, lengths = np.concatenate(ids_of), np.concatenate(sizes)
        out: list[list[dict]] = [[] for _ in texts]
        if not len(lengths):
            return counts, out
        begins = np.cumsum(lengths) - lengths
        group = np.repeat(np.arange(len(lengths)), lengths)
        p = m.probabilities(m.logits(ids, group, len(lengths)))
        best = p[:, :-1].argmax(1)
        sure = p[np.arange(len(best)), best]
        first = np.cumsum(counts) - counts
        for i in np.flatnonzero(sure >= m.threshold).tolist():
            doc = int(np.searchsorted(first, i, side="right")) - 1
            family = m.families[best[i]]
            alike = m.confirmation(family, ids[begins[i] : begins[i] + lengths[i]].tolist())
            out[doc].append(
                {"paragraph": i - int(first[doc]), "family": family, "probability": float(sure[i]), "similarity": alike, "confirmed": alike >= CONFIRM}
            )
        if spans:
            group = np.repeat(np.arange(len(spans)), [len(x[3]) for x in spans])
            p = m.probabilities(m.logits(np.concatenate([x[3] for x in spans]), group, len(spans)))
            best = p[:, :-1].argmax(1)
            sure = p[np.arange(len(best)), best]
            for i in np.flatnonzero(sure >= m.threshold).tolist():
                doc, begin, end, some = spans[i]
                family = m.families[best[i]]
                alike = m.confirmation(family, some.tolist())
                if alike >= CONFIRM and not any(x["confirmed"] and x["family"] == family and begin <= x["paragraph"] <= end for x in out[doc]):
                    out[doc].append({"paragraph": begin, "family": family, "probability": float(sure[i]), "similarity": alike, "confirmed": True})
            for found in out:
                found.sort(key=lambda x: x["paragraph"])
        return counts, out

    def run(batches):
        m = sent()
        for batch in batches:
            begin, texts, size = 0, [], 0
            column = batch.column(1)
            for i in range(batch.num_rows):
                texts.append(column[i].as_py())
                size += len(texts[-1] or "")
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    counts, found = judge(texts, m)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(begin, len(texts)), pa.array(counts, pa.int64()), pa.array(found, kind)], names=schema.names
                    )
                    begin, texts, size = i + 1, [], 0

    return docs.select(id_col, text_col).mapInArrow(lean(run), schema)


def op1_license_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, train(unknown_paragraphs(docs)))
    confirmed = F.filter("matches", lambda m: m["confirmed"])
    families = F.array_sort(F.array_distinct(F.transform(confirmed, lambda m: m["family"])))
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("matches").cast("long").alias("n_matches"),
        F.size(confirmed).cast("long").alias("n_confirmed"),
        F.array_join(families, ",").alias("families"),
        F.array_max(F.transform(confirmed, lambda m: m["probability"])).alias("probability"),
    )
