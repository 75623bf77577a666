"""License scans by a trained paragraph classifier, in DataFrame functions alone.

Paragraphs are lines, and stretches of neighbouring lines over which a template is wrapped: a window as long as the
template, and some words more, that holds enough of its words and pairs where none of its lines does. A
paragraph's words and pairs of neighbouring words are the features of a multinomial logistic regression over
licence families, an unknown class and an ordinary one. A temperature calibrates the probabilities on names and
sentences held out in turn, none of which (in whatever frame) the model then scored has seen. A predicted family
must be confirmed: enough of the words and pairs of one of the family's templates must occur in the
paragraph; a licence-like paragraph that isn't confirmed, or that no family explains well enough, is ``unknown``.

Every line of every text is split and scored. Features are sparse: a line without any word of the
vocabulary has the score of an empty line, which is that of an ordinary one, and needs no further arithmetic.
Windows are laid about words of which every text that confirms a template holds one. Both are exact.

The training sentences are made by rule from frames and names, and are others than the templates. Training
takes plain arithmetic on the driver.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash cells of the features; least confidence in a family; least share of a template's features that must occur.
CELLS, SURE, CONFIRM = 1 << 14, 0.5, 0.7
#: Least probability of any class but ordinary: where none reaches it, nothing speaks for a licence.
LEAST = 0.4
#: A window reaches a part of the template's length, one in so many words, beyond it on either side.
SLACK = 5

#: What confirms a family.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Apache-2.0",
        "Apache License 2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004",
    ],
    "BSD": [
        "BSD License",
        "BSD-3-Clause",
        "BSD-2-Clause",
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": [
        "CC BY 4.0",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC": [
        "CC BY-NC 4.0",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-NC-ND": [
        "CC BY-NC-ND 4.0",
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    ],
    "CC-BY-SA": [
        "CC BY-SA 4.0",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC0": [
        "CC0 1.0",
        "CC0",
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "GPL": [
        "GPL",
        "GPLv3",
        "GPLv2",
        "GPL-3.0",
        "GPL-2.0",
        "GNU General Public License",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "LGPL",
        "LGPLv3",
        "LGPL-3.0",
        "LGPL-2.1",
        "GNU Lesser General Public License",
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "MIT": [
        "MIT",
        "MIT License",
        "The software is provided \"as is\", without warranty of any kind, express or implied",
        "The above copyright notice and this permission notice shall be included in all copies",
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL": [
        "MPL-2.0",
        "Mozilla Public License",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "public-domain": ["public domain", "This work is in the public domain.", "Released into the public domain.", "The Unlicense"],
    "proprietary": [
        "Copyright (c)",
        "All rights reserved.",
        "Copyright 2024. All rights reserved. No part may be reproduced without written permission.",
        "This document is confidential and proprietary.",
    ],
}
#: Names of each family, and sentences of its texts, to train on.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0", "Apache License", "ASL 2.0"],
    "BSD": ["BSD License", "BSD-3-Clause", "BSD-2-Clause", "3-clause BSD license", "New BSD License", "Simplified BSD License", "BSD"],
    "CC-BY": ["CC BY 4.0", "CC BY 3.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0", "CC BY"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC BY-NC 3.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC"],
    "CC-BY-NC-ND": ["CC BY-NC-ND 4.0", "CC BY-NC-ND 3.0", "CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA"],
    "CC0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "CC0-1.0", "Creative Commons Zero", "CC0 Public Domain Dedication"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License v2", "GNU GPL", "GPLv3", "GPLv2", "GPL-3.0-only", "GPL-2.0-only", "GPL-3.0-or-later", "GPL"],
    "LGPL": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License", "LGPLv3", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL"],
    "MIT": ["MIT License", "MIT", "Expat License", "MIT licence"],
    "MPL": ["Mozilla Public License, v. 2.0", "Mozilla Public License", "MPL-2.0", "MPL 2.0"],
    "public-domain": ["public domain", "Unlicense", "The Unlicense"],
    "unknown": ["Frobnicate Sharing License", "Elbonian Open License", "Zed Community License 1.2", "Quokka Public License, version 9", "Foo License", "Acme Source License",
                "WTFPL", "Artistic License 2.0", "license of its owner", "custom license", "LicenseRef-Other", "terms of its own", "Harbour Data Agreement License", "license described elsewhere"],
}
SENTENCES = {
    "Apache-2.0": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law, software distributed under the License is distributed on an AS IS basis",
                   "you may not use this file except in compliance with the License"],
    "BSD": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice in the documentation",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse products", "Redistribution and use in source and binary forms are permitted provided that conditions are met"],
    "CC-BY": ["You are free to share and adapt the material as long as you give attribution under Creative Commons"],
    "CC-BY-NC": ["You may not use the Creative Commons material for commercial purposes, NonCommercial only"],
    "CC-BY-NC-ND": ["You may not distribute remixed Creative Commons material nor use it for commercial purposes, NoDerivatives"],
    "CC-BY-SA": ["If you remix the material you must distribute your contributions under the same Creative Commons ShareAlike license"],
    "CC0": ["To the extent possible under law, the person has waived all copyright and related or neighboring rights"],
    "GPL": ["either version 3 of the License, or (at your option) any later version, as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program",
            "you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "LGPL": ["You should have received a copy of the GNU Lesser General Public License along with this library", "under the terms of the GNU Lesser General Public License as published"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions", "The software is provided as is, without warranty of any kind, express or implied",
            "in no event shall the authors or copyright holders be liable for any claim, damages or other liability"],
    "MPL": ["If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org", "subject to the terms of the Mozilla Public License"],
    "public-domain": ["This is free and unencumbered software released into the public domain", "The author dedicates this work to the public domain", "no copyright, public domain work"],
    "proprietary": ["All rights reserved.", "Copyright 2021 Acme Inc. All rights reserved.", "(c) 2019 Someone. All rights reserved.", "Copyright (c) 2020 Foo", "Copyright 2018 by the authors", "Copyright (C) 2022 Jane Doe",
                    "No part of this publication may be reproduced or transmitted without written permission", "This document is confidential and proprietary to the company", "Unauthorized copying of this file is strictly prohibited"],
    "unknown": ["See the LICENSE file for details", "Use is subject to license terms", "The license of this package is not stated", "You may use this file under its license"],
}
#: Frames of a notice, and ordinary sentences and subjects that use the same words.
FRAMES = [
    "{}", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Distributed under {}.", "Available under {}.", "Published under the {}", "This work is licensed under a {}.",
    "This project is licensed under the terms of the {}", "SPDX-License-Identifier: {}", "License: {}", "Licence: {}", "Code licensed {}", "The code is released under the {}.", "Offered under {}.",
]
PLAIN = [
    "She renewed her driving license at the office.", "The driver had no license and the permission was refused.", "He released the bird under the bridge.", "They reserved all the seats and the rights of way.",
    "The Apache people lived in the south west.", "The general public was free to enter.", "Version 2.0 of the plan was worse.", "A table was reserved for all of them.", "The student from MIT spoke about copyright law in general.",
    "The software was redistributed to the other rooms.", "The creative commons room is on the left.", "Fishing license fees rose again.", "This is a confidential matter.", "The permission of the owner is needed.",
    "A cc of the letter went by post.", "The software and the program were modified.", "Permission to enter was not given.", "Her license was lost on the road.", "The public library is open.", "The mozilla browser opened.",
    "The domain of the king was large.", "The notice was published in the paper.", "Copies of the book were sold.", "Source water and binary stars were observed.",
    "She stated the details of the case in a file.", "The package was subject to delay and of little use.", "As stated, the terms were described elsewhere.", "The community shared the harbour.", "His own agreement with the data was of another custom.",
]
PLAIN_FRAMES = ["The {} was near the river.", "We drove through the {} in the car.", "A {} of the town spoke for an hour.", "He lost the {} on his way.", "She studied at {} for some years.", "They flew over {} at night and landed."]
PLAIN_SUBJECTS = [
    "Apache country", "Apache land", "Apache helicopter", "Apache", "MIT", "MIT student", "Mozilla office", "BSD", "general", "public", "commons", "domain", "right", "license", "permission", "version", "software", "notice", "copy",
    "material", "source", "program", "library", "creative room", "attribution", "document", "owner", "author", "form", "institute",
]
CLASSES = [*TEMPLATES, "unknown", "ordinary"]
#: Words that are no features by themselves.
STOP = ["the", "a", "an", "of", "to", "is", "in", "and", "or", "this", "that", "for", "on", "at", "was", "by", "be", "with", "it", "its", "as", "are", "you", "may", "any", "not", "no", "all", "her", "he", "she", "they", "under", "were", "from", "them", "other", "had", "has", "if", "see", "v.", "only", "nd"]
#: Names told by their capitals from words of other languages.
CASED = ["MIT"]


def training_rows() -> list[tuple[str, str, str, int]]:
    """(class, sentence, what it is made from, weight): every frame with every name, the families' own sentences, and plain
    ones; no template of several words."""
    made = [(f, frame.format(n), n, 1) for f, names in NAMES.items() for n in names for frame in FRAMES]
    made += [(f, t, t, 4) for f, ts in SENTENCES.items() for t in ts]
    made += [("ordinary", t, t, 4) for t in PLAIN]
    made += [("ordinary", frame.format(x), x, 1) for x in PLAIN_SUBJECTS for frame in PLAIN_FRAMES]
    held_apart = {t for ts in TEMPLATES.values() for t in ts if " " in t}
    return [r for r in made if r[1] not in held_apart]


def training_sentences() -> list[tuple[str, str]]:
    """(class, sentence) of the training rows."""
    return [r[:2] for r in training_rows()]


def _words(text: Column) -> Column:
    """A-Z lower-cased words; signs between them are dropped, points within them stay.

    CASED names get a point before them, but in a text all in capitals, where they tell nothing, unless it is just the name
    of the licence.
    """
    for name in CASED:
        alone = text.rlike(rf"^\W*(THE\W+)?{name}(\W+LICEN[CS]E)?\W*$") | text.rlike(r"\p{Ll}")
        text = F.when(alone, F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}.]){name}(?![\p{{L}}\p{{N}}])", f".{name}")).otherwise(text)
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?=\s|$)", -1), lambda x: x != "")


def _grams(words: Column) -> Column:
    """The distinct words and pairs of neighbouring words."""
    pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get(words, i), x))
    return F.array_distinct(F.concat(words, pairs))


#: How many different words a paragraph has at most, and the feature that says so.
LENGTHS = [(1, "#1"), (2, "#2"), (4, "#4"), (8, "#8")]


def _length(grams: Column) -> Column:
    """The feature of a paragraph's length; only a paragraph with another feature has it."""
    n = F.size(F.filter(grams, lambda g: ~F.contains(g, F.lit(" "))))
    out = F.lit("#9")
    for most, name in reversed(LENGTHS):
        out = F.when(n <= most, name).otherwise(out)
    return out


def _cells(grams: Column) -> Column:
    return F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(CELLS)).cast("int"))


class ParagraphModel:
    """The features and their cells, weights by cell and class, the temperature, and the templates' words and pairs."""

    def __init__(self, features: dict[str, int], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.features, self.weights, self.bias, self.temperature = features, weights, bias, temperature
        self.templates: list[dict] = []

    @property
    def vocabulary(self) -> list[str]:
        """Words of which a text with any feature holds one at least."""
        return sorted({w for f in self.features if not f.startswith("#") for w in f.split(" ")} - set(STOP))

    def probabilities(self, grams: list[str]) -> list[float]:
        """Of a paragraph's distinct words and pairs."""
        held = [self.features[g] for g in set(grams) if g in self.features]
        if held:
            n = sum(" " not in g for g in set(grams))
            held.append(self.features[next((name for most, name in LENGTHS if n <= most), "#9")])
        return _softmax((self.bias + self.weights[held].sum(0) / math.sqrt(max(1, len(held)))) / self.temperature).tolist()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


#: Folds of the held-out scores, and the temperatures that are tried: from 1/16 to 64.
FOLDS, TEMPERATURES = 4, [2 ** (i / 4) for i in range(-16, 25)]


def train_model(rows: list[tuple[list[tuple[str, int]], int, str, int]], steps: int = 150, rate: float = 0.5, l2: float = 2e-3) -> ParagraphModel:
    """Gradient descent on (words and pairs with their cells, class, group, weight) rows, each class of equal weight; then
    the temperature by the rows of each quarter of the groups, scored by a model that knows none of these groups.

    Features are the words and pairs of the rows but for STOP words and pairs of these. Two with one cell
    share it. The score of an empty row is that of an ordinary one by its bias.
    """
    keep = lambda g: any(w not in STOP for w in g.split(" "))
    rows = [r for r in rows if any(keep(g) for g, _ in r[0] if not g.startswith("#"))]
    features = {g: c for grams, *_ in rows for g, c in grams if keep(g)}
    cells = sorted(set(features.values()))
    at = {c: i for i, c in enumerate(cells)}

    def inputs(known: set[str]) -> np.ndarray:
        x = np.zeros((len(rows), len(cells)))
        for i, (grams, *_) in enumerate(rows):
            held = [at[features[g]] for g, _ in grams if g in known]
            for j in held:
                x[i, j] += 1 / math.sqrt(max(1, len(held)))
        return x

    y = np.eye(len(CLASSES))[[r[1] for r in rows]]
    each = np.array([r[3] for r in rows], float)[:, None] * y
    weight = (each / np.maximum(each.sum(0), 1)).sum(1, keepdims=True) / len(CLASSES)
    bias = np.where(np.array(CLASSES) == "ordinary", 3.0, 0.0)

    def fit(x: np.ndarray, some: np.ndarray) -> np.ndarray:
        w, past = np.zeros((len(cells), len(CLASSES))), np.full((len(cells), len(CLASSES)), 1e-8)
        for _ in range(steps):
            g = x[some].T @ (weight[some] * (_softmax(bias + x[some] @ w) - y[some])) + l2 * w / len(cells)
            past += g**2
            w -= rate * g / np.sqrt(past)
        return w

    # The groups of each class in turn, so that every fold has some of each.
    groups: dict[int, list[str]] = {}
    for _, c, group, _ in rows:
        if group not in groups.setdefault(c, []):
            groups[c].append(group)
    fold = np.array([groups[c].index(group) % FOLDS for _, c, group, _ in rows])
    held_out = np.zeros_like(y)
    for k in range(FOLDS):
        seen, apart = np.flatnonzero(fold != k), fold == k
        # As in use: a word that the training rows don't hold is no feature.
        x = inputs({g for i in seen for g, _ in rows[i][0] if g in features})
        held_out[apart] = bias + x[apart] @ fit(x, seen)
    loss = lambda t: -float((weight[:, 0] * np.log(np.maximum(1e-12, (_softmax(held_out / t) * y).sum(1)))).sum())
    temperature = min(TEMPERATURES, key=loss)
    full = np.zeros((CELLS, len(CLASSES)))
    full[cells] = fit(inputs(set(features)), np.arange(len(rows))).round(6)
    return ParagraphModel(features, full, bias, temperature)


def train(spark) -> ParagraphModel:
    """The model of the training sentences; Spark splits and hashes their words as it does the documents'."""
    taught = training_rows()
    samples = [t for _, t, _, _ in taught] + [t for ts in TEMPLATES.values() for t in ts]
    given = F.from_json(F.lit(json.dumps([{"i": i, "t": t} for i, t in enumerate(samples)])), "array<struct<i:int,t:string>>")
    lines = spark.range(1).select(F.explode(given).alias("s")).select("s.i", _words(F.col("s.t")).alias("w"))
    lines = lines.select("i", "w", _grams(F.col("w")).alias("g")).withColumn("g", F.concat("g", F.array(_length(F.col("g")))))
    rows = sorted((r.i, r.w, r.g, r.c) for r in lines.select("i", "w", "g", _cells(F.col("g")).alias("c")).collect())
    model = train_model([
        (list(zip(g, c, strict=True)), CLASSES.index(taught[i][0]), taught[i][2], taught[i][3]) for i, _, g, c in rows if i < len(taught)
    ])
    families = [f for f, ts in TEMPLATES.items() for _ in ts]
    model.templates = [{"f": families[i - len(taught)], "g": g[:-1], "w": w} for i, w, g, _ in rows if i >= len(taught)]
    return model


def _let(value: Column, then) -> Column:
    """``then(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _fixed(value, kind: str) -> Column:
    """A constant from its JSON text, which the optimizer folds."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _scores(model: ParagraphModel, grams: Column) -> Column:
    """struct(best class, its probability, that of an ordinary paragraph)."""
    k = len(CLASSES)
    used = [c for c, w in enumerate(model.weights) if w.any()]
    place = {c: i for i, c in enumerate(used)}
    at = _fixed([place.get(c, len(used)) for c in range(CELLS)], "array<int>")
    rows = _fixed([model.weights[c].tolist() for c in used] + [[0.0] * k], "array<array<double>>")
    bias, none = _fixed(model.bias.tolist(), "array<double>"), _fixed([0.0] * k, "array<double>")
    names, features = _fixed(CLASSES, "array<string>"), _fixed(sorted(model.features), "array<string>")
    add = lambda a, c: F.zip_with(a, F.get(rows, F.get(at, c)), lambda x, y: x + y)

    def logits(held: Column) -> Column:
        total = F.aggregate(_cells(held), none, add)
        return F.zip_with(total, bias, lambda x, b: (x / F.sqrt(F.greatest(F.size(held), F.lit(1))) + b) / model.temperature)

    def normal(e: Column) -> Column:
        return _let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda s: F.struct(
            F.when(F.array_max(e) >= LEAST * s, F.get(names, F.array_position(e, F.array_max(e)).cast("int") - 1)).otherwise("ordinary").alias("best"),
            (F.array_max(e) / s).alias("p"), (F.get(e, F.lit(k - 1)) / s).alias("ordinary"),
        ))

    told = lambda held: F.when(F.size(held) > 0, F.concat(held, F.array(_length(grams)))).otherwise(held)
    z = _let(_let(F.array_intersect(grams, features), told), logits)
    return _let(z, lambda z: _let(F.transform(z, lambda x: F.exp(x - F.array_max(z))), normal))


def needed_words(template: dict) -> list[str]:
    """Words of which a text that confirms the template holds one at least.

    The word in most of its word pairs is taken first, until what is left without them can't reach CONFIRM.
    """
    out: list[str] = []
    rest = [g.split(" ") for g in template["g"]]
    while len(rest) >= CONFIRM * len(template["g"]):
        words = {w for g in rest for w in g}
        out.append(max(words, key=lambda w: (len(w) > 4 or w == "cc", sum(w in g for g in rest), len(w), w)))
        rest = [g for g in rest if out[-1] not in g]
    return sorted(out)


def anchors(templates: list[dict]) -> dict[str, list[dict]]:
    """word -> {t, o}: the templates that need it and have it as their o-th word."""
    out: dict[str, list[dict]] = {}
    for t, made in enumerate(templates):
        for word in needed_words(made):
            for o, w in enumerate(made["w"]):
                if w == word:
                    out.setdefault(word, []).append({"t": t, "o": o})
    return out


def _slack(n):
    """How many words a window is longer than a template of ``n`` words, on either side."""
    return F.floor(n / SLACK).cast("int")


def _blocks(lines: Column) -> Column:
    """array<struct<start, lines>>: the runs of lines that aren't empty."""
    n = F.size(lines)
    empty = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(lines, i).rlike(r"^\s*$"))
    cuts = F.concat(F.array(F.lit(-1)), empty, F.array(n))

    def between(cuts: Column) -> Column:
        made = F.transform(F.slice(cuts, F.lit(1), F.size(cuts) - 1), lambda c, k: F.struct(
            (c + 1).alias("start"), F.slice(lines, c + 2, F.get(cuts, k + 1) - c - 1).alias("lines"),
        ))
        return F.filter(made, lambda x: F.size(x["lines"]) > 0)

    return _let(cuts, between)


def scan_paragraphs(docs: DataFrame, model: ParagraphModel | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each licence paragraph: doc_id, line (from 0), paragraph, family, probability.

    ``family`` is a confirmed family or ``unknown``; the probability is that of the family, or of being a
    licence at all. A family that only several lines together confirm has a row of the first of them and the text of
    these lines, besides those that the lines have: for each family and block of lines up to an empty one that
    of the window that holds most of a template (then the larger template, then the earlier window). Of classes equally
    probable the first of CLASSES is taken. Null and empty texts have no paragraphs, an empty table gives no rows; repeated rows give repeated
    rows. Whole texts are read, however long. Other columns are ignored.
    """
    model = model or train(docs.sparkSession)
    templates = _fixed(model.templates, "array<struct<f:string,g:array<string>,w:array<string>>>")
    vocabulary = _fixed(model.vocabulary, "array<string>")
    share = lambda grams, t: F.size(F.array_intersect(grams, t["g"])) / F.size(t["g"])
    confirmed = lambda held: F.filter(templates, lambda t: share(held, t) >= CONFIRM)
    known = _fixed(sorted({g for t in model.templates for g in t["g"]}), "array<string>")
    held = lambda grams: F.array_intersect(grams, known)
    # One value or none as an exploded array: a filter behind a projection would compute the value again.
    grams_of = lambda x: _let(_words(x), _grams)
    only = lambda value, test: F.explode(_let(value, lambda v: F.filter(F.array(v), test)))
    ids = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text <> ''")

    # A line without a word of the vocabulary has no feature: the model calls it ordinary by its bias.
    lines = ids.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "paragraph"))
    lines = lines.select("*", only(_words(F.col("paragraph")), lambda w: F.arrays_overlap(w, vocabulary)).alias("w"))
    score = _let(_grams(F.col("w")), lambda g: F.struct(held(g).alias("held"), _scores(model, g).alias("s")))
    scored = lines.select("doc_id", "line", "paragraph", only(score, lambda x: x["s"]["best"] != "ordinary").alias("x"))
    fits = F.transform(confirmed(F.col("x.held")), lambda t: t["f"])
    scored = scored.select("doc_id", "line", "paragraph", "x", F.explode(F.array(fits)).alias("fits"))
    sure = F.array_contains("fits", F.col("x.s.best")) & (F.col("x.s.p") >= SURE)
    of_lines = scored.select(
        "doc_id", "line", "paragraph", F.when(sure, F.col("x.s.best")).otherwise("unknown").alias("family"),
        F.when(sure, F.col("x.s.p")).otherwise(1 - F.col("x.s.ordinary")).alias("probability"),
    )

    # Windows about the needed words of blocks of several lines, as long as the template and some words on either side.
    about = anchors(model.templates)
    worth = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted(w.strip('.').replace('.', r'[.]') for w in about))})(?![\p{{L}}\p{{N}}])"
    places, names = _fixed(about, "map<string,array<struct<t:int,o:int>>>"), _fixed(sorted(about), "array<string>")
    blocks = ids.where(F.col("text").rlike(worth)).select("doc_id", F.explode(_let(F.split("text", "\n"), _blocks)).alias("b")).where(F.size("b.lines") > 1)
    blocks = blocks.where(F.exists("b.lines", lambda x: x.rlike(worth)))
    told = F.flatten(F.transform("b.lines", lambda x, k: F.transform(_words(x), lambda w: F.struct(w.alias("w"), k.alias("k")))))
    blocks = blocks.select("doc_id", "b", F.explode(F.array(told)).alias("words"))
    found = F.filter(F.transform("words", lambda x, i: F.struct(x["w"].alias("w"), i.alias("i"))), lambda x: F.array_contains(names, x["w"]))
    laid = F.array_distinct(F.flatten(F.transform(found, lambda x: F.transform(F.element_at(places, x["w"]), lambda a: F.struct((x["i"] - a["o"]).alias("at"), a["t"].alias("t"))))))

    def window(p: Column) -> Column:
        def fit(t: Column) -> Column:
            slack = _slack(F.size(t["w"]))
            first = F.greatest(p["at"] - slack, F.lit(0))
            held = F.slice("words", first + 1, F.greatest(p["at"] + F.size(t["w"]) + slack - first, F.lit(0)))
            return _let(held, lambda held: _let(_grams(F.transform(held, lambda x: x["w"])), lambda grams: F.struct(
                share(grams, t).alias("share"), F.size(t["g"]).alias("size"), (-first).alias("back"), t["f"].alias("f"),
                # The lines of the template's own words in the window.
                F.transform(F.filter(held, lambda x: F.array_contains(t["w"], x["w"])), lambda x: x["k"]).alias("k"), grams.alias("g"),
            )))

        return _let(F.get(templates, p["t"]), fit)

    fits = F.filter(F.transform(laid, window), lambda x: (x["share"] >= CONFIRM) & (F.array_max(x["k"]) > F.array_min(x["k"])))
    blocks = blocks.select("doc_id", "b", only(fits, lambda x: F.size(x) > 0).alias("x"))
    best = F.explode(F.transform(F.array_distinct(F.transform("x", lambda x: x["f"])), lambda f: F.array_max(F.filter("x", lambda x: x["f"] == f))))
    blocks = blocks.select("doc_id", "b", best.alias("x")).select("*", F.array_min("x.k").alias("low"), F.array_max("x.k").alias("high"))
    own = F.slice("b.lines", F.col("low") + 1, F.col("high") - F.col("low") + 1)
    alone = F.exists(own, lambda line: F.exists(confirmed(held(grams_of(line))), lambda t: t["f"] == F.col("x.f")))
    blocks = blocks.where(~alone).select("doc_id", "b", "x", "low", F.concat_ws("\n", own).alias("paragraph"), F.explode(F.array(_scores(model, F.col("x.g")))).alias("s"))
    of_blocks = blocks.where((F.col("s.best") == F.col("x.f")) & (F.col("s.p") >= SURE)).select(
        "doc_id", (F.col("b.start") + F.col("low")).alias("line"), "paragraph", F.col("x.f").alias("family"), F.col("s.p").alias("probability")
    )
    return of_lines.unionByName(of_blocks)


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    """Every licence paragraph of all documents and its family."""
    found = scan_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "line", "paragraph", "family", F.round("probability", 4).alias("probability"))
