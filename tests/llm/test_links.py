"""SimHash, components, and embeddings against brute force."""

import random

import numpy as np
import pytest
import xxhash

from skeinwork.llm import embeddings, simhash
from skeinwork.llm.components import connected_components


def groups(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*pairs, (None, 5)], "a long, b long")).collect()}
    want = groups(201, pairs)
    assert got == {x: want[x] for x in {x for p in pairs if p[0] != p[1] for x in p}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint():
    text = "The quick\tbrown fox  jumps\nover"
    words = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h))
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b" \n") == 0 and simhash.fingerprint("É a".encode()) == xxhash.xxh64_intdigest("É a".encode(), 42)


@pytest.mark.parametrize(("budget", "seed"), [(4, 1), (2, 2), (7, 3)])
def test_trie_links(spark, budget, seed):
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) for _ in range(120)} | {0, (1 << 64) - 1}
    for base in list(fps)[:25]:
        for _ in range(rng.randrange(8)):
            for bit in rng.sample(range(64), rng.randint(1, budget + 1)):
                base ^= 1 << bit
            fps.add(base)
    fps = sorted(fps)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    links = simhash.link_fingerprints(spark.createDataFrame(rows, "id long, fp long"), budget)
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    want = groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= budget])
    assert [got.get(i, i) for i in range(len(fps))] == want


@pytest.mark.parametrize("most", [6, 40, 500])
def test_split_buckets(spark, most):
    rng = random.Random(most)
    base = rng.getrandbits(63)
    fps = {base ^ sum(1 << b for b in rng.sample(range(24), rng.randint(0, 6))) for _ in range(400)} | {rng.getrandbits(63) for _ in range(100)}
    fps = sorted(fps)
    rows = spark.createDataFrame([(i, f, 7 if i % 5 else i) for i, f in enumerate(fps)], "id long, fp long, bucket long")
    dealt = [tuple(r) for r in simhash.split_buckets(rows, most).collect()]
    held = {}
    for i, f, bucket in dealt:
        assert fps[i] == f
        held.setdefault(bucket, set()).add(i)
    hot = {i for i in range(len(fps)) if i % 5}
    met = {(i, j) for members in held.values() for i in members for j in members}
    assert {(i, j) for i in hot for j in hot} <= met and all((i, j) not in met for i in hot for j in range(0, len(fps), 5) if len(hot) > most)
    assert max(map(len, held.values())) <= 2 * most + 10 and sum(map(len, held.values())) == len(dealt)
    links = simhash.link_fingerprints(rows.select("id", "fp"), 3, bucket_most=most)
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    want = groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_dense_bucket():
    fp = np.array(sorted({sum(1 << b for b in random.Random(i).sample(range(12), 3)) for i in range(2000)}), dtype=np.uint64)
    label = simhash.trie_links(fp, np.zeros(len(fp), dtype=np.int64), 4)
    want = groups(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 4])
    assert label.tolist() == want


def test_tables_cover_the_budget():
    for count in (10, 10**6, 10**9):
        masks = simhash.table_masks(count, 4)
        for seed in range(200):
            differ = sum(1 << b for b in random.Random(seed).sample(range(64), 4))
            assert any(not m & differ for m in masks)


def test_near_duplicates(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text, "x"), (3, text + " end", "x"), (9, None, None), (8, "", "x"), (7, "other words here now", "x"), (5, text, "x")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    got = sorted((r["doc_id"], r["component_id"]) for r in out.collect())
    far = (simhash.fingerprint(text.encode()) ^ simhash.fingerprint((text + " end").encode())).bit_count()
    joined = 3 if far <= 4 else 5
    assert got == [(3, 3), (5, joined), (5, joined), (7, 7), (8, 8), (9, 8)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("most", [4096, 7])
def test_embeddings(spark, most):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 16))
    near = x[:20] + 0.12 * rng.standard_normal((20, 16))
    x = np.concatenate([x, near, 3 * x[:5]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 16), (202, [float("nan")] + [1.0] * 15), (203, [None] + [1.0] * 15), (204, []), (205, [1.0, 2.0]), (206, [2.0, 4.0])]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    want = groups(len(x), [(i, j) for i, j in zip(*np.nonzero(linked), strict=True)])
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell_most=most)
    got = {r["vec_id"]: r for r in out.collect()}
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert all(got[i]["n_links"] <= linked[i].sum() for i in range(len(x))) and found >= 0.9 * linked.sum()
    if found == linked.sum():
        assert [got[i]["component_id"] for i in range(len(x))] == want
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (200, 201, 202, 203, 204))
    assert got[205]["n_links"] == got[206]["n_links"] == 1 and got[206]["component_id"] == 205 and not got[206]["kept"]
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_windows_by_rank():
    rng = np.random.default_rng(4)
    for n in (1, 50, 700):
        lines = rng.standard_normal((8, n)).astype(np.float32)
        counts = (np.abs(lines[:, :20, None] - lines[:, None, :]) <= 0.4).sum(axis=0)
        q, o = embeddings.collision_candidates(lines[:, :20], embeddings.sorted_lines(lines), 0.4, 4)
        assert sorted(zip(q.tolist(), o.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in np.nonzero(counts >= 4)), strict=True))


def test_embeddings_null_and_repeated_ids(spark):
    a, b, c = [1.0, 0.1, 0.0], [1.0, 0.11, 0.0], [0.0, 0.0, 1.0]
    rows = [(None, a, 1, "x"), (7, b, 2, "x"), (None, c, 3, "x"), (None, None, 4, None), (4, b, 5, "y"), (4, c, 6, "y"), (4, c, 6, "y")]
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, label string"))
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in out.collect()))
    assert got == sorted([(0, 2, 4, False), (7, 2, 4, False), (4, 2, 4, True), (0, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (0, 0, 0, True)])
    alone = embeddings.near_duplicates(spark.createDataFrame([(None, a), (None, b)], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in alone.collect()] == [(None, 1, None, True)] * 2
