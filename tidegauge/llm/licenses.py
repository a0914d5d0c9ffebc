"""Licence scan by a trained paragraph classifier, with DataFrame functions only (operator 7).

A paragraph is a run of lines that have words, reported by the line on which the notice starts. Every line is scored alone; lines that hold
no whole notice are scored together with the lines after them, for notices that are wrapped. A multinomial logistic regression over word n-grams (one to three words) tells licence families and
"unknown" apart. It is fitted on the driver from the notices below, cut and varied by rule, against sentences that share words
with licences without being one; it keeps few n-grams, and these, with their weights, are a literal of the plan. Probabilities are
calibrated by a temperature fitted on variants held out from the training. A paragraph is predicted to be of the most
likely family if that is likelier than unknown and reaches ``least``; a template comparison confirms it: some notice of the family must
have at least ``overlap`` of its words in the paragraph, in whatever order.

What is without any of the anchor words below, of which every notice has one, is unknown and not scored.

*Windows.* A notice that starts in a line and goes on in the next has at most REACH words there and thereafter (a half more than the longest
notice has). So a window is the last REACH words of a line and the REACH words after it, up to the paragraph's end or a line that
holds a notice itself. Of windows of one family that meet, the one with the largest overlap counts, and of equal ones the last: it starts
where the notice does. A family that a line next to the windows names already is not counted again.

Defined results: null and empty texts have no findings; a line, or a window, with two notices counts for the likelier family; repeated rows
are scanned each; letters' case and punctuation do not matter, so lines of comment signs alone end a paragraph.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# Notices by which licence families are known.
NOTICES = {
    "apache": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "you may not use this file except in compliance with the License", "Apache License Version 2.0, January 2004", "This software is released under the Apache 2.0 license"],
    "mit": ["Released under the MIT License", "SPDX-License-Identifier: MIT", "The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "This project is licensed under the MIT license"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "GNU General Public License version 2", "Licensed under the GPL v3", "released under the terms of the GPLv2"],
    "lgpl": ["GNU Lesser General Public License version 2.1", "SPDX-License-Identifier: LGPL-2.1-or-later", "under the terms of the GNU Lesser General Public License", "licensed under the LGPL"],
    "agpl": ["GNU Affero General Public License version 3", "SPDX-License-Identifier: AGPL-3.0-only", "licensed under the AGPL"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the 3-clause BSD license", "Released under the BSD License", "Use of this source code is governed by a BSD-style license"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC", "Licensed under the ISC License"],
    "epl": ["Eclipse Public License Version 2.0", "SPDX-License-Identifier: EPL-2.0", "made available under the terms of the Eclipse Public License"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 3.0 License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC-SA 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "public-domain": ["Licensed under CC0 1.0 Universal", "This work is dedicated to the public domain", "SPDX-License-Identifier: CC0-1.0", "This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
    "proprietary": ["All rights reserved. Unauthorized copying of this file is strictly prohibited", "Proprietary and confidential", "This software is the confidential and proprietary information of", "No part of this publication may be reproduced without written permission of the publisher"],
}
# Sentences near licences that are none.
OTHERS = ["The licensed driver took the bus to the airport", "She studied physics at MIT and moved west", "He renewed his fishing license in version two of the form", "The general public was not admitted", "The common attribution of the painting is wrong", "An Apache helicopter landed near the town", "Permission to land was granted by the tower", "The pub lost its license to sell drinks", "All seats reserved for guests", "Free software updates arrive every month", "Please read the terms of service before use", "Copyright law is taught in the second year", "He works under license from a German maker", "The license plate was stolen", "A warranty covers parts and labour", "The source of the river is in the north", "Their work was released in the spring", "Public domain knowledge is not a secret here", "The hunting licence costs ten pounds", "Version 2.0 of the game is out now"]
ANCHOR = r"(?i)licen[cs]|spdx|permission|public[^a-z0-9]+domain|creative[^a-z0-9]+commons|redistribut|propriet|gnu[^a-z0-9]|mozilla|eclipse|reproduced|rights[^a-z0-9]+reserved|confidential|unencumbered|\b[al]?gpl"
FAMILIES = [*NOTICES]
UNKNOWN = len(FAMILIES)
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"


def words_of(text: str) -> list[str]:
    import re

    return re.findall(WORD, text.lower())


REACH = max(len(words_of(n)) for some in NOTICES.values() for n in some) * 3 // 2


def ngrams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def labelled_lines(variants: int, seed: int) -> list[tuple[str, int]]:
    """Notices and other sentences, bare or amid words of no meaning, with a word lost here and there."""
    r, out = random.Random(seed), []
    filler = [w for s in OTHERS for w in words_of(s)]
    noise = lambda n: " ".join(r.choice(filler) if r.random() < 0.5 else "".join(r.choice("abdeghilmnorstu") for _ in range(r.randint(2, 9))) for _ in range(n))

    def vary(text: str, loss: float) -> str:
        kept = " ".join(w for w in words_of(text) if r.random() >= loss)
        return f"{noise(r.choice([0, 0, 3, 12]))} {kept} {noise(r.choice([0, 0, 3, 12]))}"

    for k, family in enumerate(FAMILIES):
        for notice in NOTICES[family]:
            out += [(notice, k), *((vary(notice, 0.05), k) for _ in range(variants))]
    for sentence in OTHERS:
        out += [(sentence, UNKNOWN), *((vary(sentence, 0.1), UNKNOWN) for _ in range(variants))]
    return out + [(noise(r.randint(2, 30)), UNKNOWN) for _ in range(40 * variants)]


@lru_cache(maxsize=1)
def model(variants: int = 12, seed: int = 11, rounds: int = 400, decay: float = 3e-5) -> tuple[dict[str, list[float]], list[float]]:
    """Weights by n-gram (a value for each family and unknown) and biases, divided by the fitted temperature."""
    lines, held = labelled_lines(variants, seed), labelled_lines(4, seed + 1)
    every: dict[str, int] = {}
    for text, _ in lines:
        for g in ngrams_of(words_of(text)):
            every[g] = every.get(g, 0) + 1
    notices = {g for some in NOTICES.values() for n in some for g in ngrams_of(words_of(n))} | {g for s in OTHERS for g in ngrams_of(words_of(s))}
    names = {g: i for i, g in enumerate(sorted(g for g in every if g in notices))}

    def matrix(some):
        rows = [[names[g] for g in ngrams_of(words_of(t)) if g in names] for t, _ in some]
        return np.array([i for i, r in enumerate(rows) for _ in r]), np.array([c for r in rows for c in r]), np.array([y for _, y in some])

    def logits(at, to, n, w, b):
        z = np.zeros((n, UNKNOWN + 1))
        np.add.at(z, at, w[to])
        return z + b

    def softmax(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    at, to, y = matrix(lines)
    w, b, one = np.zeros((len(names), UNKNOWN + 1)), np.zeros(UNKNOWN + 1), np.eye(UNKNOWN + 1)[y]
    gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(rounds):
        d = (softmax(logits(at, to, len(y), w, b)) - one) / len(y)
        g = decay * w
        np.add.at(g, to, d[at])
        gw += g * g
        w -= 0.5 * g / np.sqrt(gw)
        gb += d.sum(0) ** 2
        b -= 0.5 * d.sum(0) / np.sqrt(gb)
    w[np.abs(w) < 0.02] = 0
    at, to, y = matrix(held)
    z = logits(at, to, len(y), w, b)
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
    t = min((0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0), key=loss)
    return {g: [round(float(v), 4) for v in w[i] / t] for g, i in names.items() if w[i].any()}, [round(float(v), 4) for v in b / t]


def predict(text: str) -> tuple[str, float]:
    """The model in plain Python, for tests: most likely class and its probability."""
    weights, bias = model()
    z = np.array(bias) + sum((np.array(weights[g]) for g in ngrams_of(words_of(text)) if g in weights), np.zeros(UNKNOWN + 1))
    p = np.exp(z - z.max())
    p /= p.sum()
    return [*FAMILIES, "unknown"][int(p.argmax())], float(p.max())


def _bucket(key: Column, size: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(size - 1)).cast("int")


def findings(docs: DataFrame, least: float = 0.6, overlap: float = 0.8) -> Column:
    """Column of an array of (line, family, probability, overlap) for the confirmed paragraphs of ``text``."""
    import json

    weights, bias = model()
    size = 1 << (len(weights) - 1).bit_length()
    places = docs.sparkSession.createDataFrame([(g,) for g in weights], "g string").coalesce(1).select("g", _bucket(F.col("g"), size).alias("p")).collect()
    maps: list[dict] = [{} for _ in range(size)]
    for r in places:
        maps[r["p"]][r["g"]] = weights[r["g"]]
    table = F.from_json(F.lit(json.dumps(maps)), "array<map<string,array<double>>>")
    notices = F.from_json(F.lit(json.dumps([[sorted(set(words_of(n))) for n in NOTICES[f]] for f in FAMILIES])), "array<array<array<string>>>")
    names = F.lit(FAMILIES)

    def scored(words: Column) -> Column:
        grams = F.array_distinct(F.concat(words, _joined(words, 2), _joined(words, 3)))
        found = F.filter(F.transform(grams, lambda g: F.try_element_at(F.get(table, _bucket(g, size)), g)), lambda v: v.isNotNull())
        return F.aggregate(found, F.lit(bias), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))

    def judged(words: Column, line: Column, last: Column) -> Column:
        def of_scores(z: Column) -> Column:
            top = F.array_max(z)
            best = F.array_position(z, top).cast("int") - 1
            p = F.lit(1.0) / F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
            share = F.array_max(F.transform(F.get(notices, best), lambda n: F.size(F.array_intersect(n, words)) / F.size(n)))
            hit = F.struct(line.alias("line"), F.get(names, best).alias("family"), p.alias("probability"), share.alias("overlap"), last.alias("last"))
            return F.when((best < UNKNOWN) & (p >= least) & (share >= overlap), hit)

        return let(scored(words), of_scores)

    in_words = lambda t: F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0))
    there = lambda hits: F.filter(hits, lambda h: h.isNotNull())
    empty_type = "array<struct<line:int,family:string,probability:double,overlap:double,last:int>>"
    empty = F.array().cast(empty_type)

    def window(words: Column, i: Column) -> Column:
        """The last words of line i and the words after it, if they hold a notice."""

        def step(acc: Column, x: Column) -> Column:
            goes_on = acc["open"] & (F.size(x) > 0) & (F.size(acc["w"]) < REACH)
            return F.struct(F.when(goes_on, F.concat(acc["w"], x)).otherwise(acc["w"]).alias("w"), (acc["last"] + goes_on.cast("int")).alias("last"), goes_on.alias("open"))

        def of_rest(rest: Column) -> Column:
            def of_both(both: Column) -> Column:
                return F.when(F.concat(F.array_join(both, " "), F.lit(" ")).rlike(ANCHOR), judged(both, i, rest["last"]))

            own = F.get(words, i)
            both = F.concat(F.slice(own, F.greatest(F.size(own) - (REACH - 1), F.lit(1)), F.lit(REACH)), F.slice(rest["w"], 1, REACH))
            return F.when((F.size(own) > 0) & (rest["last"] > i), let(both, of_both))

        start = F.struct(F.array().cast("array<string>").alias("w"), i.alias("last"), F.lit(True).alias("open"))
        return let(F.aggregate(F.slice(words, i + 2, F.lit(REACH)), start, step), of_rest)

    def wrapped(bare: Column) -> Column:
        """Windows with notices, from lines of which those that hold a notice themselves are blank."""
        near = lambda i: F.concat(F.get(bare, i), F.lit("\n"), F.coalesce(F.get(bare, i + 1), F.lit(""))).rlike(ANCHOR)
        seen = F.filter(F.sequence(F.lit(0), F.size(bare) - 1), near)
        starts = lambda seen: F.array_distinct(F.flatten(F.transform(seen, lambda a: F.sequence(F.greatest(a - REACH, F.lit(0)), a))))
        of_words = lambda words, seen: there(F.transform(starts(seen), lambda i: window(words, i)))
        return let(seen, lambda seen: F.when(F.size(seen) > 0, let(F.transform(bare, in_words), lambda words: of_words(words, seen))).otherwise(empty))

    def added(hits: Column, windows: Column) -> Column:
        """The hits, and of windows that meet a hit or a better window of their family none."""
        best_first = F.array_sort(F.transform(windows, lambda w: F.struct((-w["overlap"]).alias("o"), (-w["line"]).alias("l"), w.alias("w"))))

        def step(acc: Column, x: Column) -> Column:
            w = x["w"]
            meets = F.exists(acc, lambda k: (k["family"] == w["family"]) & (k["last"] >= w["line"] - 1) & (k["line"] <= w["last"] + 1))
            return F.when(meets, acc).otherwise(F.concat(acc, F.array(w)))

        return F.aggregate(best_first, there(hits).cast(empty_type), step)

    def of_lines(lines: Column) -> Column:
        def of_hits(hits: Column) -> Column:
            bare = F.transform(lines, lambda x, i: F.when(F.get(hits, i).isNull(), x).otherwise(F.lit("")))
            return let(let(bare, wrapped), lambda windows: added(hits, windows))

        return let(F.transform(lines, lambda x, i: F.when(x.rlike(ANCHOR), let(in_words(x), lambda words: judged(words, i, i)))), of_hits)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = F.when(text.rlike(ANCHOR), let(F.split(text, "\n"), of_lines)).otherwise(empty)
    return F.transform(F.array_sort(every), lambda h: F.struct(*[h[c].alias(c) for c in ("line", "family", "probability", "overlap")]))


def _joined(words: Column, n: int) -> Column:
    """n-grams of n words, joined by spaces."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.concat_ws(" ", x, *[F.get(words, i + k) for k in range(1, n)]))


def scan(docs: DataFrame, least: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """doc_id and the findings of every document."""
    return docs.select("doc_id", findings(docs, least, overlap).alias("findings"))
