"""Divergence audit, centroid clustering and decontamination against plain Python."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from skeinwork.llm import clustering, decontamination, divergence

SF_DIRS = [d for d in ("/root/testdata/sf0.001",) if os.path.isdir(d)]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- operator 11

DOCS = [
    ("en", "a", "The cat, the CAT and Ünder the Éa"), ("en", "a", "cat dog the"), ("en", "b", "dog the cat x1y"), ("en", "b", None), ("en", None, "the dog"),
    (None, "a", "lone words"), ("fr", "a", ""), ("fr", "z", "  "), ("en", "c", "éa Éa éa"), ("en", "c", "éa ünder Ünder"), ("en", "d", "12 -- 34"), ("en", "a", "cat dog the"), ("en", "é", "rare éa zzz zzz"),
]


def audit_brute(rows, least, top):
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t))) for a, b, t in rows]
    held, counts, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        held[lang].update(set(words))
        counts[lang, source].update(words)
        langs[lang].update(words)
    kept = {lang: sorted(w for w, n in c.items() if n >= least) for lang, c in held.items()}
    out = []
    for (lang, source), mine in counts.items():
        terms = kept.get(lang, [])

        def shares(c, terms=terms):
            total = sum(c[t] for t in terms)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(terms)) for t in terms}

        p, q = shares(mine), shares(langs[lang])
        pairs = [(s, sum((p[t] - o[t]) ** 2 // o[t] for t in terms)) for (other, s), c in counts.items() if other == lang and s != source for o in [shares(c)]]
        over = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in terms if mine[t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", over, top)):
            ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(ordered, 1)]
    return sorted(out)


def audit_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("bound,ranked", [(50_000, 4096), (0, 2)])
def test_divergence_brute_force(spark, monkeypatch, bound, ranked):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", bound)
    monkeypatch.setattr(divergence, "RANKED_TERMS", ranked)
    monkeypatch.setattr(divergence, "TASK_TERMS", 3)
    monkeypatch.setattr(divergence, "PIECE", 4)
    rng = random.Random(1)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)]
    rows = DOCS + [(rng.choice(["de", "en"]), rng.choice("abcde"), " ".join(rng.choices(words, weights=range(1, 61), k=rng.randrange(30)))) for _ in range(60)]
    df = spark.createDataFrame([(*r, i, "x", 5) for i, r in enumerate(rows)], "lang string, source string, text string, doc_id long, term string, n int").repartition(3)
    assert audit_rows(divergence.audit(df, top=7)) == audit_brute(rows, 3, 7)


def test_divergence_without_terms(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
    rows = [("en", "a", "one"), ("en", "b", None), ("en", "b", "one")]
    assert audit_rows(divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string"))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_divergence_long_text(spark):
    rows = [("en", "a", "ab " * 700_000 + "b"), ("en", "b", "b" * 3_000_000), ("en", "b", "b ab"), ("en", "c", "b ab"), ("en", "c", "b ab")]
    assert audit_rows(divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string"))) == audit_brute(rows, 3, 200)


# ---- operator 12


def cluster_brute(rows, k=8, rounds=10, dim=64):
    kept = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    now = [list(v) for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(now))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[place(v)[1]].append(v)
        now = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(now)]
    placed = [(i, *place(v)) for i, v in kept]
    each = Counter()
    for _, d, j in placed:
        each[j] += d
    return sorted(((i, j, d, each[j], sum(each.values()), clustering.centroid_digest(now[j])) for i, d, j in placed), key=str)


def clustered(df, **how):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], clustering.centroid_digest(r["centroid"])) for r in clustering.cluster_vectors(df, **how).collect()), key=str)


def vectors(seed, n, dim=64, spread=0.05):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((5, dim))
    return [(i, [float(x) for x in middles[rng.integers(5)] + spread * rng.standard_normal(dim)]) for i in range(n)]


@pytest.mark.parametrize("kind", ["double", "float"])
def test_clustering_brute_force(spark, kind):
    rows = vectors(1, 150) + [(500 + i, [float((i >> (j % 3)) % 2) - 0.5 for j in range(64)]) for i in range(12)]  # the last repeat and tie
    rows += [(None, [0.25] * 64), (3, [0.25] * 64), (700, None), (701, [0.5] * 63), (702, [None] + [0.5] * 63), (703, [math.nan] + [0.5] * 63), (704, [math.inf] + [0.5] * 63), (705, []), (706, [0.0] * 64)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, whole string, cluster int").repartition(3)
    want = cluster_brute([(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()])
    got = clustered(df)
    assert got == want and len(got) == 165


def test_clustering_few_and_none(spark):
    kind = "vec_id long, embedding array<double>"
    assert clustered(spark.createDataFrame([], kind)) == [] == clustered(spark.createDataFrame([(1, [1.0])], kind))
    rows = [(i, [float(i % 2)] * 64) for i in range(5)]
    assert clustered(spark.createDataFrame(rows, kind)) == cluster_brute(rows)


def test_screening_spares_distances():
    """Bounds never lose the nearest centroid (ties to the smaller number), and most distances are not computed."""
    rng = np.random.default_rng(2)
    middles = rng.integers(-3000, 3000, (8, 64))
    middles[7] = middles[2]  # a tie in every component
    whole = middles[rng.integers(0, 8, 4000)] + rng.integers(-40, 40, (4000, 64))
    centroids = clustering.Centroids.of(middles.tolist())
    cluster, distance, computed = centroids.nearest(whole, clustering._segment_norms(whole, clustering.SEGMENTS))
    every = ((whole[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert computed < 0.3 * every.size
    large = rng.integers(-(1 << 27) + 1, 1 << 27, (200, 64))
    far = clustering.Centroids.of(large[:8].tolist())
    cluster, distance, _ = far.nearest(large, clustering._segment_norms(large, clustering.SEGMENTS))
    exact = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(large[:8])) for v in large]
    assert [(int(d), int(c)) for d, c in zip(distance, cluster, strict=True)] == exact


# ---- operator 13

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks_brute(docs, items):
    told = [WORD.findall(low(t)) for t in items.values()]
    windows = defaultdict(set)
    for item, words in zip(items, told, strict=True):
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, found = WORD.findall(low(text)), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        out.append((doc, len(words), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=str)


def leaks_rows(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in df.collect()), key=str)


def leak_case(seed, short=True):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Élan", "été", "ÉLAN"]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = {1: say(30), 2: say(10), 30: say(14), 4: None, 5: " ,. "}
    items |= {6: items[1][-60:], 10: items[1]}
    items |= {7: say(9), 8: "w1 w2 w3", 9: "Solo"} if short else {}
    docs = [(i, say(rng.randrange(60))) for i in range(40)]
    for i in range(40, 80):  # parts of items, some of exactly ten words
        words = (items[rng.choice([1, 2, 30])] or "").split()
        at, n = rng.randrange(len(words)), rng.choice([9, 10, 11, 20])
        docs.append((i, f"{say(rng.randrange(15))} | {', '.join(words[at : at + n])}. {say(rng.randrange(15))}".upper() if i % 2 else " ".join(words[at : at + n])))
    docs += [(None, items[1]), (3, items[1]), (81, None), (82, ""), (83, "solo SOLO x"), (84, (items[2] + " ") * 3000)]
    return docs, items


@pytest.mark.parametrize("seed,short,bound", [(1, True, 200_000), (2, False, 200_000), (3, True, 0)])
def test_decontamination_brute_force(spark, monkeypatch, seed, short, bound):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", bound)
    docs, items = leak_case(seed, short)
    df = spark.createDataFrame([(*d, "x", 1, "h", 2) for d in docs], "doc_id long, text string, n_hit string, key int, h string, salt int").repartition(3)
    bench = spark.createDataFrame([(i, t, "y") for i, t in items.items()], "item_id int, text string, start string")
    out = decontamination.mark_contaminated(df, bench)
    assert out.columns == ["doc_id", "text", "key", "h", "salt", "n_words", "n_hit", "items", "contaminated"]
    assert leaks_rows(out) == leaks_brute(docs, items)


def test_decontamination_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id int, text string")
    assert leaks_rows(decontamination.mark_contaminated(docs, items)) == [(1, 2, 0, [], False)]
    one = spark.createDataFrame([(None, "a b")], "item_id int, text string")
    assert decontamination.mark_contaminated(docs.limit(0), one).count() == 0
    assert leaks_rows(decontamination.mark_contaminated(docs, one)) == [(1, 2, 2, [""], True)]


def test_winnowing_guarantee(spark):
    """Any ten shared words share a fingerprint, whatever surrounds them; and far fewer grams are kept than there are."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    shared = [f"s{i}" for i in range(10)]
    texts = [" ".join([f"a{rng.randrange(10**6)}" for _ in range(rng.randrange(40))] + shared + [f"b{rng.randrange(10**6)}" for _ in range(rng.randrange(40))]) for _ in range(30)] + [" ".join(f"z{i}" for i in range(20_000))]
    prints = decontamination.let(decontamination._hashes(decontamination.words_of(F.col("text"))), lambda w: decontamination.fingerprints(w, 10))
    found = [set(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "text string").select(prints).collect()]
    assert all(a & b for a in found[:30] for b in found[:30])
    assert len(found[30]) < 0.4 * 20_000


def test_decontamination_is_native(spark, monkeypatch):
    """No plan has a Python node."""
    plans, store = [], decontamination.stored

    def watch(df, label, *more):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return store(df, label, *more)

    monkeypatch.setattr(decontamination, "stored", watch)
    docs, items = leak_case(5)
    out = decontamination.mark_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id int, text string"))
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert len(plans) == 5 and not any(re.search("Python|Arrow|Pandas", p) for p in plans)


# ---- all three against their SQL


@pytest.mark.parametrize("sf_dir", SF_DIRS)
@pytest.mark.parametrize("module", [divergence, clustering, decontamination])
def test_against_sql(spark, module, sf_dir):
    import duckdb

    db = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    got = module.query(spark, sf_dir)
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({module.ORACLE_SQL})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
