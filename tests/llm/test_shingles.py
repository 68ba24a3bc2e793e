"""Near copies by exact similarity, against brute force."""

import random

import corpus_pipeline

from skeinwork.llm import shingles, simhash


def planted():
    """Texts with near copies at many similarities, short ones, equal ones and a dense family."""
    rng = random.Random(3)
    made = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = []
    for n in (3, 6, 12, 40, 120, 120, 300):
        base = made(n)
        texts.append(" ".join(base))
        for edits in range(1, 6):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    family = made(150)
    texts += [" ".join(family[:i] + [f"y{i}"] + family[i + 1 :]) for i in range(60)]
    texts += [" ".join(family[:75] + made(75)) for _ in range(10)]
    return [*texts, texts[0], texts[-1].upper(), "", " \n", "one", "one"]


def brute_force(texts):
    """The component (least index) of each text under all pairs of similarity 4 / 5."""
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    part = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0]
    for i, j in links * 2:
        low, high = sorted((part[i], part[j]))
        part = [low if x == high else x for x in part]
    return part, sets, links


def test_near_copies_in_chunks(spark, monkeypatch):
    texts = planted()
    part, *_ = brute_force(texts)
    monkeypatch.setattr(shingles, "BUCKET_CLASSES", 8)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, cls int, n string").repartition(3)
    common, chunks = shingles.common_shingles(docs, 5)
    assert chunks.max() > 3 and (common[1:] > common[:-1]).all()
    out = shingles.drop_near_copies(docs, 5, 7, (4, 5))
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(part))


def test_near_copies_whole(spark):
    texts = planted()
    part, _, links = brute_force(texts)
    far = [(i, j) for i, j in links if (simhash.fingerprint(texts[i].encode(), 5) ^ simhash.fingerprint(texts[j].encode(), 5)).bit_count() > 7]
    assert far  # pairs that a budget of 7 bits loses
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    out = corpus_pipeline.near_deduplication(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(part))
    rows, parts = shingles.near_copies(shingles.keyed(docs), 5, 7, (4, 5))
    assert rows.count() == len(texts)
    assert corpus_pipeline.near_deduplication(spark, docs.limit(0), "").count() == 0


def test_null_and_repeated_ids(spark):
    rng = random.Random(5)
    a, b, c, d = (" ".join(f"w{rng.randrange(9000)}" for _ in range(60)) for _ in range(4))
    rows = [(None, a), (None, b), (7, b), (5, c), (5, d), (None, d.upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = simhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in found) == [(0, 0), (0, 5), (0, 7), (5, 5), (5, 5), (7, 7)]
    near = corpus_pipeline.near_deduplication(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in near) == sorted([(0, a), (7, b), (5, c), (5, d)])
    after = corpus_pipeline.suffix_deduplication(spark, spark.createDataFrame([*near, near[0]], docs.schema), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in after) == sorted((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in [*near, near[0]])
