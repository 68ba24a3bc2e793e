import hashlib
import random
from collections import defaultdict

import numpy as np

from skeinwork.llm import bwt, suffix_dedup


def test_merged_transforms():
    rng = random.Random(3)
    for _ in range(150):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 12))]
        depth = rng.randint(1, 6)
        got, want = defaultdict(set), defaultdict(set)
        for s, o, b in zip(*(x.tolist() for x in bwt.repeated_intervals(texts, depth, rng.choice([5, 20, 1000]))), strict=True):
            got[b].add((s, o))
        for i, t in enumerate(texts):
            for j in range(len(t) - depth + 1):
                want[t[j : j + depth]].add((i, j))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def brute(rows):
    first = {}
    for d, t in rows:
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(first.get(t[i : i + 50], d), d)
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def sample(seed, n):
    rng = random.Random(seed)
    words = [bytes(rng.choice(b"abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    passages = [b" ".join(rng.choice(words) for _ in range(25)) for _ in range(8)]
    rows = []
    for d in range(n):
        text = b" ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))
        if rng.random() < 0.6:
            cut = rng.randint(0, len(text))
            text = text[:cut] + rng.choice(passages)[rng.randint(0, 30) :] + text[cut:]
        if rows and rng.random() < 0.3:
            text = rng.choice(rows)[1]
            if text and rng.random() < 0.7:
                cut = rng.randint(0, len(text) - 1)
                text = text[:cut] + b"#" + text[cut + rng.randint(0, 3) :]
        if rng.random() < 0.1:
            text = rng.choice([b"ab", b"a"]) * rng.randint(10, 90)
        rows.append((rng.randint(0, 10**6) if d % 9 else 77, text))
    return rows


def run(spark, rows, **limits):
    df = spark.createDataFrame([(d, t.decode(), 1) for d, t in rows], "doc_id long, text string, part int").repartition(3)
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]).decode()) for r in suffix_dedup.remove_repeats(df, give="digest", **limits).collect())


def test_brute_force(spark):
    rows = sample(5, 160)
    assert run(spark, rows) == brute(rows)


def test_small_limits(spark, monkeypatch):
    for name, value in (("HOT_SEGMENTS", 2), ("WIDE_ANCHOR", 5), ("FLUSH_BYTES", 6000), ("CHUNK_BYTES", 3000), ("SHARD_BYTES", 700), ("GROUP_BYTES", 2000), ("REGROUP_BYTES", 900)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = sample(6, 120)
    assert run(spark, rows, fan=3, part_bytes=900) == brute(rows)


def test_one_string_in_all_documents_and_one_id_on_many_rows(spark, monkeypatch):
    for name, value in (("HOT_SEGMENTS", 4), ("WIDE_ANCHOR", 6)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(8)
    common = bytes(rng.choice(b"abcdefgh ") for _ in range(70))
    rows = [(i, b"%d " % rng.randrange(10**6) + common + b" %d" % rng.randrange(10**6)) for i in range(90)]
    rows += [(500, common + b" of one id %d" % i) for i in range(40)] + [(500, b"a text of one id that repeats under it and in no other document %d" % (i // 2)) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_slices():
    rng = random.Random(1)
    text = bytes(rng.choice(b"abcdef ") for _ in range(900))
    whole = suffix_dedup.segments_of([(0, 0, False, False, text)])
    cut = suffix_dedup.segments_of([(0, at, at > 0, at + 300 < 900, text[at : at + 300 + 49]) for at in range(0, 900, 300)])
    starts = lambda e: sorted(s + i for s, n in zip(e.start.tolist(), e.strings.tolist(), strict=True) for i in range(n))
    assert starts(whole) == starts(cut) == list(range(851))


def test_nulls_and_characters(spark):
    text = "é" * 60
    df = spark.createDataFrame([(1, text), (2, "x" + text), (3, None), (4, ""), (None, text)], "doc_id long, text string")
    out = suffix_dedup.remove_repeats(df)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["n_removed"] == 120 and bytes(got[None]["kept"]).decode() == text  # a null id is the least
    assert got[3]["n_bytes"] == got[4]["n_bytes"] == 0
    kept = {r["doc_id"]: r["text"] for r in suffix_dedup.kept_texts(df).collect()}
    assert kept[2] == "x"
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_halves_of_runs():
    rng = random.Random(11)
    text = bytes(rng.choice(b"abcd") for _ in range(4000))
    e = suffix_dedup.segments_of([(0, 0, False, False, text)])
    runs = [text[s : s + n + 49] for s, n in zip(e.start.tolist(), e.strings.tolist(), strict=True)]
    halves = suffix_dedup.sided(runs)
    of_string = {}
    for i, (run, cut, h) in enumerate(halves):
        end = halves[i + 1][1] if i + 1 < len(halves) and halves[i + 1][0] == run else len(runs[run]) - 49
        assert cut < end
        for o in range(cut, end):
            assert of_string.setdefault(runs[run][o : o + 50], h) == h
    assert len(of_string) == len({text[i : i + 50] for i in range(len(text) - 49)})
