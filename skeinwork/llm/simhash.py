"""Operator 2: SimHash near-dedup with a binary trie self-join.

Distinct fingerprints go to tables in which some blocks of bits must agree (fingerprints within the budget agree in at
least one table). Within a bucket of a table the fingerprints are a binary trie, held as a sorted array whose nodes are
ranges. The trie is joined with itself: node pairs go down together, differing bits add up, and a pair is dropped once
they exceed the budget. Pairs of subtrees already known to be linked throughout are dropped as well, and each bucket gives
a spanning forest of its links, so a dense group never turns into all of its pairs. A bucket of very many fingerprints is
dealt in chunks, and each two chunks of it are a trie of their own, in a task of their own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import as_bytes, map_rows, released, stored
from skeinwork.llm.components import connected_components

BITS, SEED = 64, 42
WORDS, BUDGET = 4, 4
#: Tables are chosen so that a bucket holds about so many fingerprints at most, were they spread evenly: joining a
#: fingerprint with half of 128 others in each of 5 tables costs about what sorting it into 10 more tables does.
BUCKET_MEAN = 128
#: Rows that are joined at once (whole buckets), and the most of a bucket that one task joins; larger ones are dealt by pairs of chunks.
CHUNK, BUCKET_MOST = 1 << 16, 1 << 14


def shingle_hashes(raw: bytes, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's shingles in their order, repeats too; a text of fewer words is one shingle."""
    found = raw.lower().split()
    if not found:
        return np.empty(0, dtype="<u8")
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    width = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=False)], dtype="<u8")


def fingerprint_of(h: np.ndarray) -> int:
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(raw: bytes, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a text's bytes as an unsigned number; 0 without words."""
    return fingerprint_of(shingle_hashes(raw, words))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; null and empty texts have fingerprint 0."""

    def start():
        def one(values):
            fp = fingerprint(values[1], words)
            yield values[0], fp - (1 << 64) if fp >> 63 else fp

        return one

    return map_rows(docs.select(docs["doc_id"].cast("long"), as_bytes(docs["text"])), start, {"doc_id": ("long", pa.int64()), "fp": ("long", pa.int64())})


def table_masks(count: int, budget: int, mean: int = BUCKET_MEAN) -> list[int]:
    """Masks of bits that agree in a table. Of b blocks at most `budget` differ, so some choice of b - budget agrees.

    b is the least at which `count` spread fingerprints leave at most `mean` in a bucket, up to budget + 3.
    """
    for blocks in range(budget + 1, budget + 4):
        cuts = [BITS * i // blocks for i in range(blocks + 1)]
        masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        chosen = [reduce(or_, pick) for pick in combinations(masks, blocks - budget)]
        if count <= mean << min(m.bit_count() for m in chosen):
            break
    return chosen


def _labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least index linked with each of n items, links being a-b and those that `label` already holds."""
    label = np.arange(n) if label is None else label.copy()
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for end in (a, b):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    while not np.array_equal(label, label[label]):
        label = label[label]
    return label


def _descend(fp: np.ndarray, first: np.ndarray, last: np.ndarray, budget: int, label: np.ndarray) -> np.ndarray:
    """Joins tries with themselves; fp is sorted within the roots [first, last). Returns labels with the links found added."""
    changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
    pure = lambda lo, hi: changes[hi - 1] == changes[lo]
    al, ah, bl, bh = first, last, first, last
    differ = np.zeros(len(first), dtype=np.int8)
    left, right = [], []
    for bit in reversed(range(BITS)):
        if not len(al):
            break
        ones = np.concatenate([[0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        same = (al == bl) & (ah == bh)
        other = ~same
        parts = [
            (al, am, bl, bm, differ),
            (am, ah, bm, bh, differ),
            (al, am, bm, bh, differ + 1),
            (am[other], ah[other], bl[other], bm[other], differ[other] + 1),
        ]
        al, ah, bl, bh, differ = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (al < ah) & (bl < bh) & (differ <= budget)
        keep &= ~((al == bl) & (ah - al == 1) & (bh - bl == 1))
        al, ah, bl, bh, differ = (x[keep] for x in (al, ah, bl, bh, differ))
        linked = (label[al] == label[bl]) & pure(al, ah) & pure(bl, bh)
        leaves = (ah - al == 1) & (bh - bl == 1) & ~linked
        near = leaves & (np.bitwise_count(fp[al] ^ fp[bl]) <= budget)
        left.append(al[near])
        right.append(bl[near])
        keep = ~(linked | leaves)
        al, ah, bl, bh, differ = (x[keep] for x in (al, ah, bl, bh, differ))
    return _labels(len(fp), np.concatenate(left), np.concatenate(right), label) if left else label


def trie_links(fp: np.ndarray, bucket: np.ndarray, budget: int) -> np.ndarray:
    """The least index linked with each fingerprint inside its bucket; rows are sorted by bucket and fingerprint."""
    edges = np.nonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[0]
    last = np.concatenate([edges[1:], [len(fp)]])
    wide = last - edges > 1
    first, last = edges[wide], last[wide]
    label = np.arange(len(fp))
    if len(first):
        dense = (last - first).max() > 2 * BUCKET_MEAN
        for step in [1, 2, budget] if dense and budget > 2 else [budget]:
            label = _descend(fp, first, last, step, label)
    return label


def split_buckets(rows: DataFrame, most: int) -> DataFrame:
    """(id, fp, bucket) with no bucket of much more than `most` rows: the rows of a larger one are dealt by hash in chunks of
    half as many, and each goes to the buckets of its chunk with every other chunk, so that any two rows still meet."""
    chunks = F.ceil(F.count(F.lit(1)) / F.lit(max(1, most // 2))).cast("int").alias("chunks")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), chunks).filter((F.col("size") > most) & (F.col("chunks") > 2))
    dealt = rows.join(stored(sizes.select("bucket", "chunks"), "wide-buckets"), "bucket", "left")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("chunks")).cast("int"))
    others = F.when(F.col("chunks").isNull(), F.array(F.lit(-1))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("chunks") - 1), F.col("chunk")))
    dealt = dealt.withColumn("other", F.explode(others))
    pair = F.xxhash64("bucket", F.least("chunk", "other"), F.greatest("chunk", "other"))
    return dealt.select("id", "fp", F.when(F.col("chunks").isNull(), F.col("bucket")).otherwise(pair).alias("bucket"))


def link_fingerprints(distinct: DataFrame, budget: int = BUDGET, bucket_most: int = BUCKET_MOST) -> DataFrame:
    """Links (a, b) that connect all ids whose fingerprints are within the budget, directly or by others.

    distinct holds (id, fp), each fingerprint once. A bucket gives fewer links than it has rows.
    """
    distinct = stored(distinct.select("id", "fp"), "distinct-fingerprints")
    masks = table_masks(distinct.count(), budget)
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for i, m in enumerate(masks)))
    rows = distinct.select("id", "fp", F.explode(tables).alias("x")).select("id", "fp", F.xxhash64("x.t", "x.key").alias("bucket"))
    rows = split_buckets(rows, bucket_most)
    flipped = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))  # the order of unsigned numbers
    parted = rows.repartition("bucket").sortWithinPartitions("bucket", flipped)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def join(ids, fp, bucket):
            label = trie_links(fp.view(np.uint64), bucket, budget)
            at = np.nonzero(label != np.arange(len(label)))[0]
            return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[label[at]])], names=["a", "b"])

        held = [np.empty(0, dtype=np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, batch.column(n).to_numpy()]) for h, n in zip(held, ("id", "fp", "bucket"), strict=True)]
            if len(held[0]) >= CHUNK:
                cut = int(np.searchsorted(held[2], held[2][-1], "left"))
                if cut:
                    yield join(*(h[:cut] for h in held))
                    held = [h[cut:] for h in held]
        if len(held[0]):
            yield join(*held)

    return parted.mapInArrow(released(task), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """Per row of docs: doc_id, fp (signed long), component_id, the least doc_id that links of fingerprints reach.

    Fingerprints link when they differ in at most `budget` bits; equal ones always do, and texts without words (null and
    empty ones too) share fingerprint 0, linked like any other. Repeated rows come out once each. A null doc_id is linked
    like any other, but names a component only if it holds no other (component_id is null then). An empty table gives
    no rows. Only doc_id and text are read. Copies collapse to their fingerprint before anything is compared, and
    fingerprints are linked under themselves, so neither null nor repeated doc_ids join or part anything.
    """
    found = stored(fingerprints(docs, words), "fingerprints")
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(link_fingerprints(distinct.select(F.col("fp").alias("id"), "fp"), budget))
    named = distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    labels = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return found.join(named.join(labels, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
