"""Quality rules, licences, chats and the pipeline."""

import hashlib
import math
import os
import random
import re

import numpy as np
import pytest

from skeinwork.llm import chat, licences, quality


def test_base_features():
    text = "a b c d a b c x\n\nline one\nline one\n \n \nÉé #$ |"
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    assert quality.base_features(text.encode()) == (len(words), sum(map(len, words)), 3, 1, len(covered))
    assert quality.base_features(b"") == (0, 0, 0, 0, 0)


def corpus(n=240):
    rng = random.Random(8)
    syllables = ["an", "er", "the", "on", "ti", "sh", "ou", "re"]
    clean = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(90))
    return [(i, clean() if i % 6 else " ".join(w.upper() + "$$!!" for w in clean().split())) for i in range(n)]


def test_ratio(spark):
    rows = corpus()
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "x")], "doc_id long, text string").selectExpr("*", "'k' AS kept")
    labels = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i, _ in rows if i % 2 == 0 or i % 3 == 0] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.score_documents(docs, model).collect()}
    assert all(got[i]["kept"] == (i % 6 != 0) for i, _ in rows)
    assert got[900]["base_failed"] and not got[900]["kept"] and got[901]["n_words"] == 0
    assert {r["doc_id"] for r in quality.filter_documents(docs, model).collect()} == {i for i, r in got.items() if r["kept"]}
    again = quality.fit(docs.repartition(5), labels)
    assert again.threshold == model.threshold
    bare = quality.fit(docs, labels.limit(0))
    assert bare.threshold is None and quality.score_documents(docs.limit(0), bare).count() == 0


@pytest.fixture(scope="module")
def model():
    return licences.train([t for _, t in corpus(120)], steps=200)


def test_held_out_notices(spark, model):
    told = {
        1: ("Some text.\nReleased under the MIT License.\nmore", "mit"),
        2: ("Licensed under the Apache License, Version 2.0 (the \"License\");", "apache"),
        3: ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        4: ("Licensed under CC BY-NC 4.0.\nAll rights reserved.", "cc-by-nc,proprietary"),
        5: ("Licensed under the Foo Bar Grand License 9", ""),
        6: ("no notice here at all", ""),
        7: (None, ""),
        8: ("", ""),
        9: ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    }
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in told.items()], "doc_id long, text string, family string")
    got = {r["doc_id"]: r for r in licences.scan(df, model).collect()}
    assert {i: r["licences"] for i, r in got.items()} == {i: want for i, (_, want) in told.items()}
    assert got[5]["n_unknown"] == 1 and got[6]["n_notices"] == 0 and got[1]["n_lines"] == 3
    assert licences.scan(df.limit(0), model).count() == 0


@pytest.mark.parametrize("footer, family", [("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit")])
def test_frequent_footer(spark, footer, family):
    rows = [(i, "\n".join([t[k : k + 60] for k in range(0, 480, 60)] + ([footer] if i % 3 == 0 else []))) for i, t in corpus(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shares = licences.word_shares(docs)
    assert not set(licences.word_list(footer)) & set(shares) - {"the"}
    found = {r["doc_id"]: r["licences"] for r in licences.scan(docs, licences.train(licences.sample_paragraphs(docs), shares)).collect()}
    assert found == {i: family if i % 3 == 0 else "" for i, _ in rows}


#: Headers as they stand in files; none of them is a training or calibration text.
HEADERS = {
    "gpl": "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "apache": "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at",
    "agpl": "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU Affero General Public License as\n// published by the Free Software Foundation, version 3 of the License.",
    "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "": "This program and the accompanying materials are made available under\nthe terms of the Eclipse Public License v1.0 which accompanies this distribution",
}


def test_headers(spark, model):
    texts = [(i, f"some words before\n\n{text}\n\nand words after", family) for i, (family, text) in enumerate(HEADERS.items())]
    texts.append((50, "Released under the MIT License.\nLicensed under CC BY 4.0.\nLicensed under CC BY-SA 4.0.", "cc-by,cc-by-sa,mit"))
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string"), model).collect()}
    assert {i: got[i]["licences"] for i, _, _ in texts[:-1]} == {i: family for i, _, family in texts[:-1]}
    assert "mit" in got[50]["licences"] and "cc-by-sa" in got[50]["licences"]
    assert all(got[i]["n_notices"] == 1 and got[i]["n_unknown"] == (family == "") for i, _, family in texts[:-1])


def plain_scan(text, model):
    """The scan of one text in plain Python: (families of each paragraph that is a notice)."""
    markers, lines = set(model.markers), (text or "").split("\n")
    marks = [bool(markers & set(licences.word_list(x))) for x in lines]
    inside = [m or (0 < i < len(lines) - 1 and marks[i - 1] and marks[i + 1] and lines[i].strip(" ") != "") for i, m in enumerate(marks)]
    runs, out = [], []
    for i, member in enumerate(inside):
        if member and i and inside[i - 1]:
            runs[-1].append(lines[i])
        elif member:
            runs.append([lines[i]])
    for run in runs:
        per_line = [licences.word_list(x) for x in run]
        told, speaks = set(), False
        for words in [[w for x in per_line for w in x], *(per_line if len(run) > 1 else [])]:
            features = [f for f in {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))} if f in model.weights]
            if not features:
                continue
            z = [(b + sum(model.weights[f][i] for f in features)) / model.temperature for i, b in enumerate(model.bias)]
            e = [math.exp(x) for x in z]
            if e[0] / sum(e) >= 0.5:
                continue
            speaks |= bool(licences.LICENCE_WORDS & set(words))
            p, family = max((x / sum(e), c) for x, c in list(zip(e, model.classes, strict=True))[2:])
            like = {f: max(min(len(set(words) & set(part)) / len(part) for part in licences.template_words(n)) for n in listed) for f, listed in licences.TEMPLATES.items()}
            if p >= model.level and like[family] >= licences.RESEMBLANCE and like[family] >= max(like.values()):
                told.add(family)
        told -= {f for f, wider in licences.WITHIN.items() if told & set(wider)}
        if told or speaks:
            out.append(sorted(told) or [licences.UNKNOWN])
    return out


def test_scan_against_plain_python(spark, model):
    rng = random.Random(12)
    listed = [n for found in [*licences.TEMPLATES.values(), *licences.CALIBRATION.values(), licences.OTHER_NOTICES] for n in found] + list(HEADERS.values())
    texts = []
    for _ in range(150):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = rng.choice(listed).split(" ") if rng.random() < 0.6 else [rng.choice(["an", "the", "ou", "re.", "License"]) for _ in range(8)]
            cut = rng.randint(0, len(words))
            lines += [" ".join(words[:cut]), " ".join(words[cut:]), *rng.choice([[], [""], [" "], ["plain line"]])]
        texts.append("\n".join(lines))
    texts += [None, "", "word " * 60_000 + "licensed under the mit license " + "x " * 60_000, texts[0], texts[1]]
    df = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, row int, families string")
    found = {}
    for r in licences.flagged_paragraphs(df, model).orderBy("doc_id", "line_no").collect():
        found.setdefault(r["doc_id"], []).append(list(r["families"]))
    assert found == {i: want for i, t in enumerate(texts) if (want := plain_scan(t, model))}
    got = {r["doc_id"]: r for r in licences.scan(df, model).collect()}
    assert {i: r["n_notices"] for i, r in got.items()} == {i: len(found.get(i, [])) for i in range(len(texts))}


def test_held_out_accuracy(model):
    """Of the calibration notices, on which no weight was fitted."""
    right = total = 0
    for family, notices in licences.CALIBRATION.items():
        for notice in notices:
            found = licences.features_of(licences.word_list(notice), set(model.markers))
            score = [b + sum(model.weights[f][i] for f in found if f in model.weights) for i, b in enumerate(model.bias)]
            right += model.classes[score.index(max(score))] == family
            total += 1
    assert right / total > 0.8, right / total


def test_word_lists_agree(spark):
    df = spark.createDataFrame([("Version 2.0. CC-BY, é the...",), ("",), (" . ",)], "line string")
    got = [r[0] for r in df.select(licences.words_of(df["line"])).collect()]
    assert got == [licences.word_list(t) for t in ("Version 2.0. CC-BY, é the...", "", " . ")]
    rng = random.Random(6)
    words = ["by", "bys", "cc", "v", "the", "a.b"]
    texts = ["".join(rng.choice(["by", "bys", "cc", "v", "the", ".", " ", "-", "a.b", "É", "B"]) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "line string")
    for t, found, any_of in df.select("line", licences.named(df["line"], words), licences.holds_any(df["line"], words)).collect():
        assert found == [w for w in licences.word_list(t) if w in words]
        assert any_of == bool(found)


def test_template_is_reversible():
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice(["<", "|", "\\", "turn", ">", chat.TURN, chat.OVER, "é", "\n"]) for _ in range(rng.randint(0, 12)))
        formatted, spans = chat.format_turns([(text, text, True), ("user", text, False)])
        assert chat.read_turns(formatted) == [(text, text), ("user", text)]
        assert [chat.unescape(formatted[a:b]) for a, b in spans] == [text]


def test_reply_tree(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 2.0), (1, 3, 1, "assistant", "bad", -1.0), (1, 4, 2, "user", "more", 0.0), (1, 5, 4, "assistant", "end", 0.0), (1, 6, 2, "user", "other", None), (2, 1, 99, "user", "alone", 0.0)]
    df = spark.createDataFrame(rows, "tree long, message long, parent long, role string, text string, score double")
    every = chat.format_trees(df, None).orderBy("conv_id", "rank").collect()
    assert [(r["conv_id"], r["leaf"], r["branch_score"]) for r in every] == [(1, 5, 2.0), (1, 6, 2.0), (1, 3, -1.0), (2, 1, 0.0)]
    assert [t for _, t in chat.read_turns(every[0]["formatted"])] == ["q", "good", "more", "end"]
    learned = [r["formatted"][a:b] for r in every for a, b in zip(r["loss_spans"][::2], r["loss_spans"][1::2], strict=True)]
    assert sorted(learned) == ["bad", "end", "good"]  # each once, though two branches share one
    assert chat.format_trees(df).count() == 2 and chat.format_trees(df.limit(0)).count() == 0


def test_chain(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(37)] + [(2, 0, None, None), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, None, "assistant", "<|over|>")]
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_trees(chat.chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[:37])
    assert out[1]["n_turns"] == 37 and out[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert out[2]["n_turns"] == 3 and out[3]["loss_chars"] == 8


def test_null_conversation(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(None, 1, "assistant", "b"), (None, 0, "user", "a"), (None, 2, None, None), (0, 0, "user", "zero"), (0, 1, "assistant", "z")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_trees(chat.chain(frame)))
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = db.execute(f"SELECT * FROM ({chat.ORACLE_SQL}) WHERE conv_id IS DISTINCT FROM -7")
    names = [c[0] for c in want.description]
    assert {tuple(r) for r in got.select(*names).collect()} == set(want.fetchall()) and got.count() == 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns
        rows = docs.collect()
        assert len(rows) <= seen and len({r["doc_id"] for r in rows}) == len(rows)
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
        seen = len(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert packed.select("doc_id").distinct().count() == seen


def test_ratio_against_plain_python(spark):
    rows = [*corpus(90), (3, corpus(90)[3][1]), (901, None), (902, "long word " * 40_000), (903, ""), (None, corpus(90)[4][1])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(0, 90, 2)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    chosen = quality.trusted_ids(labels)
    fitting, held = {d for d, fits in chosen if fits}, {d for d, fits in chosen if not fits}
    assert fitting and held and not any(d % 6 == 0 for d in fitting | held)
    raw, target = [0] * quality.BUCKETS, [0] * quality.BUCKETS
    for doc, text in rows:
        for b in quality.trigram_buckets((text or "").encode()).tolist():
            raw[b] += 1
            target[b] += doc in fitting
    whole, trusted = sum(raw), sum(target)
    ratio = [math.log((t + 1) / (trusted + quality.BUCKETS)) - math.log((r + 1) / (whole + quality.BUCKETS)) for r, t in zip(raw, target, strict=True)]

    def score(text):
        buckets = quality.trigram_buckets((text or "").encode()).tolist()
        return sum(ratio[b] for b in buckets) / len(buckets) if buckets else 0.0

    ordered = sorted(score(t) for d, t in rows if d in held)
    place = quality.TRUSTED_LOSS * (len(ordered) - 1)
    low = int(place)
    level = ordered[low] + (place - low) * (ordered[min(low + 1, len(ordered) - 1)] - ordered[low])
    assert model.threshold == pytest.approx(level - quality.MARGIN)
    want = sorted((d or -1, score(t) >= level - quality.MARGIN and not (n < 50 or 100 * rep > 50 * n)) for d, t in rows for n, *_, rep in [quality.base_features((t or "").encode())])
    got = quality.score_documents(docs, model).collect()
    assert sorted((r["doc_id"] or -1, r["kept"]) for r in got) == want
    assert all(r["score"] == pytest.approx(score(dict(rows)[r["doc_id"]])) for r in got if r["doc_id"] != 3)


def test_every_trusted_document_counts(spark):
    """More trusted documents than any sample of the model once took."""
    from pyspark.sql import functions as F

    n = 20_600
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "xyz").otherwise("abc").alias("text")).repartition(3)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    chosen = dict(quality.trusted_ids(labels))
    assert len(chosen) == n
    counts = {text: [sum(1 for d in range(n) if (d % 100 == 0) == rare and (chosen[d] or not fits)) for fits in (True, False)] for text, rare in (("xyz", True), ("abc", False))}
    fitting = sum(chosen.values())
    model = quality.fit(docs, labels)
    ratio = {t: math.log((f + 1) / (fitting + quality.BUCKETS)) - math.log((r + 1) / (n + quality.BUCKETS)) for t, (f, r) in counts.items()}
    for text, want in ratio.items():
        assert model.log_ratio[quality.trigram_buckets(text.encode())[0]] == pytest.approx(want)
    assert model.threshold == pytest.approx(min(ratio.values()) - quality.MARGIN)
    assert quality.lower_level(spark.createDataFrame([(float(x),) for x in range(3001)], "score double"), 0.001) == pytest.approx(3.0)


def test_random_reply_trees(spark):
    rng = random.Random(21)
    rows = []
    for tree in [*range(6), None]:
        size = rng.randint(1, 25)
        for m in range(size):
            rows.append((tree, m, rng.choice([None, *range(m)]) if m else rng.choice([None, 99]), rng.choice(["user", "assistant"]), f"t{tree} {m} <|", rng.choice([0.0, 1.0, 2.0, None])))
    rows += [(50, m, m - 1 if m else None, "assistant" if m % 2 else "user", f"long {m}", 1.0) for m in range(300)]
    got = {}
    for r in chat.format_trees(spark.createDataFrame([(*r, "x", 1) for r in rows], "tree long, message long, parent long, role string, text string, score double, leaf string, rank int"), None).collect():
        spans = list(zip(r["loss_spans"][::2], r["loss_spans"][1::2], strict=True))
        got[r["conv_id"], r["leaf"]] = (r["rank"], r["branch_score"], chat.read_turns(r["formatted"]), [chat.unescape(r["formatted"][a:b]) for a, b in spans])
    want = {}
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        paths = []
        for leaf in set(own) - {r[2] for r in own.values()}:
            path, at = [], leaf
            while at in own:
                path.append(own[at])
                at = own[at][2]
            paths.append((-sum(m[5] or 0.0 for m in path), leaf, path[::-1]))
        learned = set()
        for rank, (score, leaf, path) in enumerate(sorted(paths, key=lambda p: p[:2]), 1):
            mine = [m for m in path if m[3] == "assistant" and m[1] not in learned]
            learned |= {m[1] for m in mine}
            want[tree, leaf] = (rank, -score, [(m[3], m[4]) for m in path], [m[4] for m in mine])
    assert got == want


def planted_documents():
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(60)
    rows = [(i, "\n".join([text(30), text(30), *(["one common line of many documents"] if i % 2 else [])])) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(4)]  # exact copies
    rows += [(110 + i, rows[i + 5][1].replace(rows[i + 5][1].split(" ")[25], "changed", 1)) for i in range(4)]  # near copies
    rows += [(120 + i, f"{text(40)} {passage} {text(40)}") for i in range(3)]  # a shared passage
    rows += [(130, None), (131, ""), (None, text(70)), (None, text(70)), (7, text(70)), (140, "the same words again " * 40), (141, text(30_000))]
    return rows


def test_pipeline_against_plain_python(spark):
    import corpus_pipeline
    from skeinwork.llm import shingles, simhash

    rows = planted_documents()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n int, cls string").repartition(3)
    plain = lambda df: sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in df.collect()))
    # quality rules without a trusted document are the base rules
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    first = quality.filter_documents(docs, model)
    good = [(d, t) for d, t in rows for n, *_, rep in [quality.base_features((t or "").encode())] if n >= 50 and 100 * rep <= 50 * n]
    assert plain(first) == sorted((-1 if d is None else d, t) for d, t in good) and first.columns == docs.columns
    # lines
    second = corpus_pipeline.line_deduplication(spark, first, "")
    lined = [(d, "\n".join(x for x in t.split("\n") if x != "one common line of many documents")) for d, t in good]
    assert plain(second) == sorted((-1 if d is None else d, t) for d, t in lined) and second.columns == docs.columns
    # near copies: of a component the least doc_id stays
    third = corpus_pipeline.near_deduplication(spark, second, "")
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for _, t in lined]
    part = list(range(len(lined)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if shingles.alike(len(sets[i] & sets[j]), len(sets[i]), len(sets[j]), 4, 5)]
    for i, j in links * 3:
        low, high = sorted((part[i], part[j]))
        part = [low if x == high else x for x in part]
    best = {}
    for p, (d, t) in zip(part, lined, strict=True):
        best[p] = min(best.get(p, (True, math.inf, "")), (d is None, d or 0, t))
    kept = sorted((-1 if none else d, t) for none, d, t in best.values())
    assert len(links) >= 6 and plain(third) == kept and third.columns == docs.columns
    # repeated strings of 50 bytes
    fourth = corpus_pipeline.suffix_deduplication(spark, third, "")
    started, out = {}, []
    for d, t in kept:
        raw = t.encode()
        for i in range(len(raw) - 49):
            started[raw[i : i + 50]] = min(started.get(raw[i : i + 50], d), d)
    for d, t in kept:
        raw, gone = t.encode(), set()
        for i in range(len(raw) - 49):
            if started[raw[i : i + 50]] < d:
                gone.update(range(i, i + 50))
        out.append((d, bytes(b for i, b in enumerate(raw) if i not in gone).decode("utf-8", "ignore")))
    assert plain(fourth) == sorted(out) and out != kept
    # packing: every id once
    packed = corpus_pipeline.pack_sequences(spark, fourth, "").collect()
    assert sum(r["length"] for r in packed) == sum(r["doc_tokens"] for r in packed if r["start"] == 0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_licence_expressions_stand_once(spark):
    """The words of a line are found by one expression, and the features of a line travel without its words."""
    docs = spark.createDataFrame([(1, "licensed under the apache license version 2.0\nplain words"), (2, None)], "doc_id long, text string")
    plans, select = [], type(docs).groupBy

    def watch(self, *columns):
        if columns == ("word",):
            plans.append(self._jdf.queryExecution().optimizedPlan().toString())
        return select(self, *columns)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(docs), "groupBy", watch)
        licences.word_shares(docs)
    assert len(plans) == 1 and plans[0].count("regexp_extract_all") == 1


def test_licence_in_one_long_line(spark):
    model = licences.train([])
    text = "licensed under the apache license version 2.0 " + " ".join(f"w{i}" for i in range(100_000))
    found = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert (found["n_notices"], found["licences"]) == (1, "apache")


def test_sparse_rows():
    rows = [(0, 2), (), (1,), (0, 1, 2)]
    dense = np.array([[i in r for i in range(3)] + [True] for r in rows], dtype=np.float32)
    w, v = np.arange(8, dtype=np.float32).reshape(4, 2), np.arange(8, dtype=np.float32).reshape(4, 2) - 3
    sparse = licences.SparseRows(rows, 3)
    assert (sparse.times(w) == dense @ w).all() and (sparse.back(v) == dense.T @ v).all()
