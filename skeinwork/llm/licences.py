"""Operator 4 (native): licence scans by a trained paragraph classifier.

A sparse logistic regression over word unigrams and bigrams is trained on notices of each licence family, varied by
dropped words and by words of the corpus around them, against lines of the corpus. Its features are the notices' words
that the corpus hardly uses and the bigrams that hold one, so a line without such a word is passed over without loss.
Lines with one that follow one another (or lie on both sides of one line without) are a paragraph: it is classified whole,
so notices may be wrapped or commented, and line by line, so a list of notices keeps them apart. Probabilities are
calibrated on other notices than those trained on; what looks like a notice but falls short of the calibrated level, or
resembles no template of its family, is of the class "unknown". The scan is DataFrame functions throughout; only the
training, on bounded samples, runs on the driver.
"""

from __future__ import annotations

import os
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import cache
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import stored

#: Notices of each licence family, which train the classifier and are its templates.
TEMPLATES = {
    "agpl": [
        "licensed under the gnu affero general public license version 3",
        "you can redistribute it under the terms of the gnu affero general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "released under the agpl v3",
        "you should have received a copy of the gnu affero general public license along with this program",
    ],
    "apache": [
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at apache.org licenses license 2.0",
        "licensed to the apache software foundation under one or more contributor license agreements",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "distributed under the terms of the apache 2.0 license",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "released under the bsd 3 clause license",
        "licensed under the bsd 2 clause license",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "use of this source code is governed by a bsd style license that can be found in the license file",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ],
    "cc0": [
        "dedicated to the public domain under cc0 1.0 universal",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights",
        "released under the creative commons zero license cc0",
    ],
    "cc-by": [
        "this work is licensed under a creative commons attribution 4.0 international license",
        "licensed under cc by 4.0",
        "licensed under the creative commons attribution license cc by 3.0",
        "this article is distributed under the terms of the creative commons attribution license which permits unrestricted use distribution and reproduction provided the original work is properly cited",
        "available under cc by 3.0",
    ],
    "cc-by-nc": [
        "licensed under cc by nc 4.0",
        "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
        "licensed under cc by nc sa 4.0",
        "creative commons attribution non commercial license which permits non commercial use only",
        "available under cc by nc 3.0 for noncommercial purposes",
    ],
    "cc-by-sa": [
        "licensed under cc by sa 4.0",
        "this work is licensed under a creative commons attribution sharealike 3.0 license",
        "text is available under the creative commons attribution share alike license",
        "available under cc by sa 3.0",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "licensed under the gpl v2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "you should have received a copy of the gnu general public license along with this program",
        "released under the terms of the gnu gpl version 2 or later",
    ],
    "isc": [
        "released under the isc license",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "licensed under the isc license",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license version 2.1",
        "this library is free software under the terms of the lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
        "you should have received a copy of the gnu lesser general public license along with this library",
        "released under the lgpl v3",
    ],
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "distributed under the mit license see license for details",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "licensed under the mozilla public license version 2.0",
        "if a copy of the mpl was not distributed with this file you can obtain one at mozilla.org mpl 2.0",
        "released under the mpl 2.0",
    ],
    "proprietary": [
        "all rights reserved",
        "copyright all rights reserved no part of this publication may be reproduced without permission",
        "proprietary and confidential unauthorized copying is prohibited",
        "no part of this publication may be reproduced or transmitted in any form or by any means without prior written permission of the publisher",
        "this software is the confidential and proprietary information of the company you shall not disclose such confidential information",
    ],
}
#: Notices that name no family above; they train the class "unknown".
OTHER_NOTICES = [
    "licensed under the terms of the accompanying license",
    "released under a custom license see the license file",
    "distributed under the acme community license version 1.1",
    "this software is licensed under the sunrise public license",
    "use of this document is subject to the license agreement",
    "released under the terms of the joint venture license",
    "published under an open license",
    "licensed under the blue river source license",
    "subject to the license terms of its owner",
    "see license for details of the licensed work",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0",
    "distributed under the boost software license version 1.0",
    "licensed under the european union public licence v 1.2",
    "licensed under the artistic license 2.0",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable zlib license",
    "licensed under the academic free license version 3.0",
]
#: Other notices, which only calibrate the probabilities.
CALIBRATION = {
    "agpl": ["this file is part of a server that is free software under the gnu affero general public license version 3 or later", "license agpl 3.0 or later"],
    "apache": ["this project is licensed under the apache license 2.0 see the license file", "apache license version 2.0 january 2004 apache.org licenses"],
    "bsd": ["this package is distributed under a bsd style license", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"],
    "cc0": ["to the extent possible under law all copyright and related or neighboring rights have been waived under cc0", "the dataset is in the public domain cc0 1.0"],
    "cc-by": ["this dataset is made available under the creative commons attribution 4.0 license", "content is licensed under cc by 4.0 unless noted otherwise"],
    "cc-by-nc": ["this dataset is released under the creative commons attribution noncommercial license", "images are licensed under cc by nc 4.0"],
    "cc-by-sa": ["this dataset is released under the creative commons attribution sharealike 4.0 license", "pages are licensed under cc by sa 3.0"],
    "gpl": ["this file is free software under the gnu general public license version 2 or any later version", "license gpl v3 or later"],
    "isc": ["isc license permission to use copy modify and distribute this software for any purpose with or without fee is granted", "this project is under the isc license"],
    "lgpl": ["this file is distributed under the gnu lesser general public license version 3", "license lgpl 2.1 or later"],
    "mit": ["this project is licensed under the terms of the mit license", "mit license permission is granted free of charge to any person obtaining a copy of the software"],
    "mpl": ["this file is subject to the mozilla public license version 2.0", "covered by the mozilla public license mpl 2.0"],
    "proprietary": ["copyright 2020 the company all rights reserved", "confidential and proprietary do not copy or distribute without written permission all rights reserved"],
    "unknown": ["licensed under the green valley license version 2", "made available under the terms of the common development and distribution license", "see the license agreement of the vendor", "this work is under a licence of its own", "licensed under the university of north license"],
}
#: A family whose words another one's notices hold as well: beside the latter it is not reported for a line of the same paragraph.
WITHIN = {"gpl": ["agpl", "lgpl"], "cc-by": ["cc-by-nc", "cc-by-sa"]}
#: Words of which an unknown notice has at least one.
LICENCE_WORDS = {"license", "licensed", "licence", "licenced", "copyright", "copying", "reserved", "redistribution", "redistribute"}
#: Bounds of the training sample: about so many documents, lines of them of least hash, and variants of each notice.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS, LONGEST_SAMPLE, VARIANTS = 400, 4000, 2000, 16
#: A word that more than this share of the corpus's lines hold, licence notices not counted, is no feature.
COMMON = 0.01
#: The least share of a template's words that a paragraph must hold to be confirmed; nor may another family's template be more alike.
RESEMBLANCE = 0.6
NONE, UNKNOWN = "none", "unknown"
_WORD = r"[^a-z0-9.]+"


def word_list(text: str) -> list[str]:
    """The lower-cased words of a paragraph; dots stay inside numbers and names and go at their ends."""
    return [w for w in (w.strip(".") for w in re.split(_WORD, text.lower())) if w]


def words_of(text: Column) -> Column:
    """word_list as a column."""
    return F.filter(F.transform(F.split(F.lower(text), _WORD), lambda w: F.btrim(w, F.lit("."))), lambda w: w != "")


def template_words(notice: str) -> list[list[str]]:
    """The words of a template, and those of them that at most two families use (where there are any)."""
    words = sorted(set(word_list(notice)))
    own = [w for w in words if sum(any(w in word_list(n) for n in listed) for listed in TEMPLATES.values()) <= 2]
    return [words, own] if own else [words]


def features_of(words: list[str], markers: set[str]) -> set[str]:
    """The markers among the words, and the pairs of neighbours of which one is a marker."""
    return {w for w in words if w in markers} | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a in markers or b in markers}


@cache
def named_words() -> list[str]:
    """The words of notices that may be features."""
    listed = [*(n for found in TEMPLATES.values() for n in found), *OTHER_NOTICES]  # not those of the calibration
    return sorted({w for n in listed for w in word_list(n) if len(w) > 1 and not w[0].isdigit()})


@cache
def silent_templates() -> list[list[str]]:
    """The words, numbers left out, of each template that has no licence word."""
    named = set(named_words())
    return [sorted(set(word_list(n)) & named) for listed in TEMPLATES.values() for n in listed if not LICENCE_WORDS & set(word_list(n))]


def is_notice(words: set[str]) -> bool:
    """Whether a paragraph of these words is no ordinary one: it has a licence word or resembles a template without."""
    return bool(LICENCE_WORDS & words) or any(len(words & set(t)) >= RESEMBLANCE * len(t) for t in silent_templates())


@dataclass(frozen=True)
class LicenceModel:
    classes: list[str]
    markers: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    level: float


def one_of(words: list[str]) -> str:
    """A regular expression for any of the words, sorted, that tries each letter once where it can."""
    if len(words) == 1:
        return re.escape(words[0])
    ends = "" in words
    branches = [re.escape(first) + one_of([w[1:] for w in group]) for first, group in groupby((w for w in words if w), key=lambda w: w[0])]
    return f"(?:{'|'.join(branches)}){'?' if ends else ''}"


def named(text: Column, words: list[str]) -> Column:
    """Those of the words that word_list has of the text, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![a-z0-9.])\.*({one_of(sorted(words))})\.*(?![a-z0-9.])"), F.lit(1))


def holds_any(text: Column, words: list[str]) -> Column:
    """Whether word_list has any of the words of the text."""
    return F.lower(text).rlike(rf"(?<![a-z0-9.])\.*{one_of(sorted(words))}\.*(?![a-z0-9.])")


def sample_paragraphs(docs: DataFrame) -> list[str]:
    """Lines of about SAMPLE_DOCS documents, chosen by their hash alone, so that no task holds more than lines."""
    every = max(1, docs.count() // SAMPLE_DOCS)
    picked = docs.filter(F.pmod(F.xxhash64(F.lit("licences"), F.col("doc_id"), F.col("text")), F.lit(every)) == 0)
    lines = picked.select(F.explode(F.split("text", "\n")).alias("line")).filter("trim(line) <> ''").select(F.substring("line", 1, LONGEST_SAMPLE).alias("line"))
    return [r[0] for r in lines.orderBy(F.xxhash64("line"), "line").limit(SAMPLE_PARAGRAPHS).collect()]


def word_shares(docs: DataFrame) -> dict[str, float]:
    """Of the words of notices, the share of all ordinary lines of docs that hold them; a few hundred rows at most."""
    # inline keeps the optimiser from repeating the expression wherever its words are named
    hits = docs.select(F.explode(F.split("text", "\n")).alias("line")).filter("trim(line) <> ''").select(F.inline(F.array(F.struct(F.array_distinct(named(F.col("line"), named_words())).alias("held")))))
    notice = F.arrays_overlap("held", F.array(*map(F.lit, sorted(LICENCE_WORDS))))
    for t in silent_templates():
        notice = notice | (F.size(F.array_intersect("held", F.array(*map(F.lit, t)))) >= RESEMBLANCE * len(t))
    marked = hits.filter((F.size("held") == 0) | ~notice).select(F.explode(F.concat("held", F.array(F.lit("")))).alias("word"))  # "" counts all
    found = {r["word"]: r["count"] for r in marked.groupBy("word").count().collect()}
    total = found.pop("", 0)
    return {w: n / total for w, n in found.items()}


def _variants(notice: str, noise: list[str], rng: random.Random) -> list[list[str]]:
    words, made = word_list(notice), []
    for i in range(VARIANTS):
        kept = [w for w in words if i == 0 or rng.random() > 0.08] or words
        around = [rng.choice(noise) for _ in range(rng.randrange(0, 9))] if noise and i % 2 else []
        cut = rng.randrange(len(around) + 1)
        made.append(around[:cut] + kept + around[cut:])
    return made


class SparseRows:
    """Rows of zeros and ones as lists of their ones, each with one more column that is always one (for the intercept)."""

    def __init__(self, rows: list[tuple[int, ...]], columns: int):
        lengths = np.array([len(r) + 1 for r in rows])
        self.columns = np.array([c for r in rows for c in (*r, columns)])
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        order = np.argsort(self.columns, kind="stable")
        self.by_column = np.repeat(np.arange(len(rows)), lengths)[order]
        self.held, self.column_starts = np.unique(self.columns[order], return_index=True)
        self.width = columns + 1

    def times(self, w: np.ndarray) -> np.ndarray:
        """The rows times w."""
        return np.add.reduceat(w[self.columns], self.starts, axis=0)

    def back(self, values: np.ndarray) -> np.ndarray:
        """The transposed rows times a row of values for each."""
        out = np.zeros((self.width, values.shape[1]), dtype=values.dtype)
        out[self.held] = np.add.reduceat(values[self.by_column], self.column_starts, axis=0)
        return out


def train(paragraphs: list[str], shares: dict[str, float] | None = None, seed: int = 7, steps: int = 250, rate: float = 0.3, decay: float = 1e-4) -> LicenceModel:
    """The classifier for a corpus of which `paragraphs` are a sample (it may be empty); the same sample gives the same model.

    shares are the word_shares of the corpus; without them those of the sample's ordinary paragraphs count.
    """
    rng = random.Random(seed)
    sampled = [word_list(p) for p in paragraphs]
    notices = [(family, n) for family, listed in TEMPLATES.items() for n in listed] + [(UNKNOWN, n) for n in OTHER_NOTICES]
    of_notices = {w for _, n in notices for w in word_list(n)}
    negative = [w for w in sampled if not is_notice(set(w))]
    named = set(named_words())
    if shares is None:
        shares = {w: sum(w in words for words in map(set, negative)) / len(negative) for w in named} if negative else {}
    markers = {w for w in named if shares.get(w, 0) <= COMMON} | LICENCE_WORDS
    noise = [w for words in negative for w in words]
    rows = [(family, v, False) for family, n in notices for v in _variants(n, noise, rng)]
    rows += [(family, v, True) for family, listed in CALIBRATION.items() for n in listed for v in _variants(n, noise, rng)]
    rows += [(NONE, w, i % 4 == 3) for i, w in enumerate(negative)]
    classes = [NONE, UNKNOWN, *TEMPLATES]
    known = sorted({f for _, words, held in rows if not held for f in features_of(words, markers) if set(f.split()) <= of_notices})
    at = {f: i for i, f in enumerate(known)}
    every = [(tuple(sorted(at[f] for f in features_of(words, markers) if f in at)), classes.index(family), held) for family, words, held in rows]
    fitted = Counter((found, c) for found, c, held in every if not held)  # equal rows count as one of more weight
    x = SparseRows([found for found, _ in fitted], len(known))
    y = np.array([c for _, c in fitted])
    ordinary = max(1, sum(c == 0 for _, c, _ in every))
    share = np.array([n * (len(classes) / ordinary if c == 0 else 1 / VARIANTS / 5) for (_, c), n in fitted.items()], dtype=np.float32)[:, None]  # no class outweighs others
    w, targets = np.zeros((len(known) + 1, len(classes)), dtype=np.float32), np.eye(len(classes), dtype=np.float32)[y]
    speed, shrink = np.zeros_like(w), np.full((len(w), 1), decay, dtype=np.float32)
    shrink[-1] = 0
    for _ in range(steps):
        speed = 0.9 * speed - rate * x.back((_softmax(x.times(w)) - targets) * share) - rate * shrink * w
        w = w + speed
    others = [(found, c) for found, c, held in every if held]
    y = np.array([c for _, c in others])
    scores = SparseRows([found for found, _ in others], len(known)).times(w)
    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lambda t: -np.log(_softmax(scores / t)[np.arange(len(scores)), y] + 1e-12).sum())
    best = _softmax(scores / temperature)[:, 2:].max(axis=1)
    is_known = y >= 2
    low = float(np.quantile(best[~is_known], 0.995)) if (~is_known).any() else 0.0
    level = min(0.9, max(0.5, (low + float(np.quantile(best[is_known], 0.02))) / 2))
    return LicenceModel(classes, sorted(markers), {f: w[i].tolist() for f, i in at.items()}, w[-1].tolist(), temperature, level)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def marked_paragraphs(docs: DataFrame, markers: list[str]) -> DataFrame:
    """(row, doc_id, line_no, lines): runs of lines that hold a marker, or lie between two that do and are not blank."""
    some = docs.filter(holds_any(F.col("text"), markers)).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.split("text", "\n").alias("lines"))
    flagged = some.withColumn("marks", F.transform("lines", lambda line: holds_any(line, markers)))
    at = lambda i: F.coalesce(F.get("marks", i), F.lit(False))
    inner = lambda i: at(i) | ((F.trim(F.get("lines", i)) != "") & at(i - 1) & at(i + 1))
    members = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), inner)
    listed = flagged.select("row", "doc_id", "lines", F.transform(members, lambda i, n: F.struct((i - n).alias("run"), i.alias("line_no"))).alias("members"))
    # lines of one run follow one another, so that their number less their place is the same
    each = listed.select("row", "doc_id", F.explode(F.transform("members", lambda m: F.struct(m["run"].alias("run"), m["line_no"].alias("line_no"), F.get("lines", m["line_no"]).alias("line")))).alias("x"))
    gathered = each.groupBy("row", "doc_id", "x.run").agg(F.sort_array(F.collect_list(F.struct("x.line_no", "x.line"))).alias("found"))
    return gathered.select("row", "doc_id", F.get("found", F.lit(0))["line_no"].alias("line_no"), F.transform("found", lambda x: x["line"]).alias("lines"))


def flagged_paragraphs(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """(doc_id, line_no, paragraph, families, probability, resemblance) of the paragraphs that are notices; families are the
    known ones it tells of, in order, or "unknown". line_no is that of its first line."""
    spark = docs.sparkSession
    paragraphs = stored(marked_paragraphs(docs, model.markers), "paragraphs")  # two plans read them by row
    worded = paragraphs.withColumn("words", F.transform("lines", words_of))
    units = F.concat(F.array(F.struct(F.lit(-1).alias("part"), F.flatten("words").alias("words"))), F.when(F.size("lines") > 1, F.transform("words", lambda w, i: F.struct(i.alias("part"), w.alias("words")))).otherwise(F.array().cast("array<struct<part:int,words:array<string>>>")))
    unit = ["row", "line_no", "part"]
    parted = worded.select("row", "doc_id", "line_no", F.array_join("lines", "\n").alias("paragraph"), F.explode(units).alias("u")).select("row", "doc_id", "line_no", F.when(F.col("u.part") < 0, F.col("paragraph")).alias("paragraph"), "u.part", "u.words")
    pairs = F.when(F.size("words") > 1, F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)))).otherwise(F.array().cast("array<string>"))
    # the vocabulary is bounded by the notices: some thousand rows whatever the corpus
    vocabulary = F.broadcast(spark.createDataFrame(list(model.weights.items()), "feature string, w array<double>"))
    features = parted.select(*unit, F.explode(F.array_union(F.array_distinct("words"), pairs)).alias("feature"))  # without the words, as a long line has many features
    summed = features.join(vocabulary, "feature").groupBy(*unit).agg(*(F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(model.classes))))
    raw = [F.exp((F.col(f"s{i}") + model.bias[i]) / model.temperature) for i in range(len(model.classes))]
    total = sum(raw[1:], raw[0])
    best = F.array_max(F.array(*(F.struct((raw[i] / total).alias("p"), F.lit(c).alias("family")) for i, c in enumerate(model.classes) if i > 1)))
    likely = summed.select(*unit, (raw[0] / total).alias("p_none"), best.alias("best")).filter("p_none < 0.5")
    scored = likely.join(parted, unit).select("row", "doc_id", "line_no", "part", "paragraph", F.array_distinct("words").alias("words"), "best")
    templates = F.create_map(*(x for family, listed in TEMPLATES.items() for x in (F.lit(family), F.array(*(F.array(*(F.array(*map(F.lit, part)) for part in template_words(n))) for n in listed)))))
    held = lambda part: F.size(F.array_intersect(F.col("words"), part)) / F.size(part)
    likeness = lambda listed: F.array_max(F.transform(listed, lambda parts: F.array_min(F.transform(parts, held))))
    judged = scored.withColumn("resemblance", likeness(F.element_at(templates, F.col("best.family")))).withColumn("most", likeness(F.flatten(F.map_values(templates))))
    sure = (F.col("best.p") >= model.level) & (F.col("resemblance") >= RESEMBLANCE) & (F.col("resemblance") >= F.col("most"))
    speaks = F.arrays_overlap("words", F.array(*map(F.lit, sorted(LICENCE_WORDS))))
    named_by = judged.select("row", "doc_id", "line_no", "part", "paragraph", "best", "resemblance", speaks.alias("speaks"), F.when(sure, F.col("best.family")).alias("family"))
    whole = lambda c: F.max(F.when(F.col("part") < 0, F.col(c)))
    gathered = named_by.groupBy("row", "doc_id", "line_no").agg(
        F.first("paragraph", ignorenulls=True).alias("paragraph"),
        F.sort_array(F.collect_set("family")).alias("told"),
        F.max("speaks").alias("speaks"),
        F.max_by("best.p", "part").alias("p of lines"),
        whole("best.p").alias("p of all"),
        F.max("resemblance").alias("resemblance"),
    )
    within = F.filter("told", lambda f: ~F.coalesce(F.arrays_overlap(F.col("told"), F.element_at(F.create_map(*(x for k, v in WITHIN.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), f)), F.lit(False)))
    known = F.size("told") > 0
    return gathered.filter(known | F.col("speaks")).select("doc_id", "line_no", "paragraph", F.when(known, within).otherwise(F.array(F.lit(UNKNOWN))).alias("families"), F.coalesce("p of all", "p of lines").alias("probability"), "resemblance")


def scan(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """Per doc_id: n_lines, n_notices (paragraphs that are), n_unknown, licences (known families in order, comma-joined).

    Null and empty texts have one empty line. Rows that repeat a doc_id are counted together, and so are those without. An
    empty table gives no rows. Only doc_id and text are read, so other columns may have any name. Texts are scanned whole.
    """
    found = flagged_paragraphs(docs, model).select("doc_id", F.lit(0).cast("long").alias("n"), "families")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n"), F.lit(None).cast("array<string>").alias("families"))
    return every.unionByName(found).groupBy("doc_id").agg(
        F.sum("n").alias("n_lines"),
        F.count("families").alias("n_notices"),
        F.count(F.when(F.array_contains("families", UNKNOWN), 1)).alias("n_unknown"),
        F.array_join(F.array_remove(F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))), UNKNOWN), ",").alias("licences"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    return scan(docs, train(sample_paragraphs(docs), word_shares(docs)))
