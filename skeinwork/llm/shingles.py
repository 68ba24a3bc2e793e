"""Near copies by shingle sets: links of all texts whose sets of word shingles have a Jaccard similarity of p / q.

Texts with one set are one class. Candidates are the links of the fingerprints' trie join and, so that no pair is lost, the
classes that share SHARED shingles of their prefixes: with all shingles in one order, sets of that similarity share the
first SHARED of their common ones within the first n - ceil(n p / q) + SHARED. Only candidates whose exact similarity
reaches p / q become links. Neighbours of a bucket are compared first; then only classes that are not linked yet, so a
dense group never becomes all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import checkpointed, released, scratch, stored
from skeinwork.llm.components import connected_components
from skeinwork.llm.simhash import fingerprint_of, link_fingerprints, shingle_hashes

#: The order of shingles only decides the cost: those that several of about so many rows hold come last, up to COMMON_MOST.
ORDER_SAMPLE, COMMON_MOST = 2000, 200_000
#: Prefix shingles that a pair must share (or all it needs in common, if fewer).
SHARED = 3
#: A bucket that the sample expects to hold more classes than this is dealt in chunks.
BUCKET_CLASSES = 4096
#: Up to so many keys are broadcast; more are joined.
BROADCAST_KEYS = 500_000


def alike(common: int, a: int, b: int, p: int, q: int) -> bool:
    """Whether sets of a and b items, `common` of them shared, have a Jaccard similarity of at least p / q."""
    return (p + q) * common >= p * (a + b)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with "key of row", two hashes of doc_id and text: rows of one key are alike in both."""
    parts = [F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return docs.withColumn("key of row", F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2")))


def matched(rows: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """A semi- or anti-join whose keys are broadcast if they are few enough."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys, on, how)


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, that at least two rows of a sample hold, and the part of the table that holds each, in chunks."""
    count = docs.count()
    sample = docs.filter(F.pmod(F.xxhash64(F.lit("order"), "doc_id", "text"), F.lit(max(1, count // ORDER_SAMPLE))) == 0)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.unique(shingle_hashes(raw or b"", words)) for raw in batch.column(0).to_pylist()]
            k, n = np.unique(np.concatenate([*held, np.empty(0, dtype="<u8")]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["k", "n"])

    counts = sample.select(F.col("text").cast("binary")).mapInArrow(released(task), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    found = counts.filter("n > 1").orderBy(F.desc("n"), "k").limit(COMMON_MOST).collect()
    k, n = (np.array([r[i] for r in found], dtype=np.int64) for i in (0, 1))
    order = np.argsort(k.view(np.uint64))
    chunks = -(-n[order] * max(1, count // ORDER_SAMPLE) // BUCKET_CLASSES)
    return k.view(np.uint64)[order], chunks


def classed(docs: DataFrame, words: int, p: int, q: int, common: np.ndarray) -> DataFrame:
    """Per row of keyed docs: its key, doc_id, class (a hash of the set of shingles), fingerprint, number of different
    shingles n, and its prefix: the first of its shingles, common ones last, of which any set of that similarity holds SHARED."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch in batches:
            cls, fp, n, first = [], [], [], []
            for raw in batch.column(2).to_pylist():
                h = shingle_hashes(raw or b"", words)
                s = np.unique(h)
                rare = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] != s if len(last) else np.ones(len(s), dtype=bool)
                first.append(np.concatenate([s[rare], s[~rare]])[: len(s) - -(-p * len(s) // q) + SHARED if len(s) else 0].tobytes())
                cls.append(xxhash.xxh64_intdigest(s.tobytes()))
                fp.append(fingerprint_of(h))
                n.append(len(s))
            unsigned = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (cls, fp)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *unsigned, pa.array(n, pa.int32()), pa.array(first, pa.binary())], names=["key of row", "doc_id", "cls", "fp", "n", "prefix"])

    return docs.select("key of row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        released(task), "`key of row` struct<h1: long, h2: long>, doc_id long, cls long, fp long, n int, prefix binary"
    )


def prefix_entries(rows: DataFrame, common: np.ndarray, chunks: np.ndarray) -> DataFrame:
    """(k, chunk, cls, at, n): the prefix shingles k of each class and their places; a task gives a class once. The
    classes of a shingle that very many hold are dealt in chunks."""
    shared = rows.sparkSession.sparkContext.broadcast((common[chunks > 1], chunks[chunks > 1]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hot, parts), seen = shared.value, set()
        for batch in batches:
            fresh = [i for i, (c, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)) if n and not (c in seen or seen.add(c))]
            if not fresh:
                continue
            found = [np.frombuffer(batch.column(2)[i].as_buffer(), dtype="<u8") for i in fresh]
            sizes = np.array([len(x) for x in found])
            k = np.concatenate(found)
            cls, n = (np.repeat(batch.column(c).to_numpy()[fresh], sizes) for c in (0, 1))
            at = np.arange(len(k)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            chunk = np.zeros(len(k), dtype=np.int64)
            if len(hot):
                place = np.minimum(np.searchsorted(hot, k), len(hot) - 1)
                chunk = np.where(hot[place] == k, cls.view(np.uint64) % parts[place].astype(np.uint64), 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(chunk.astype(np.int32)), pa.array(cls), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], names=["k", "chunk", "cls", "at", "n"])

    return rows.select("cls", "n", "prefix").mapInArrow(released(task), "k long, chunk int, cls long, at int, n int")


def _fits(at: np.ndarray, n: np.ndarray, i, j, p: int, q: int) -> np.ndarray:
    """How much a shared shingle at these places of both sets counts towards SHARED: 0 if it can't be one of the first
    SHARED of the common ones, more than 1 if the sets need fewer in common than that."""
    need = -(-p * (n[i] + n[j]) // (p + q))
    may = (at[i] <= n[i] - need + SHARED - 1) & (at[j] <= n[j] - need + SHARED - 1) & (q * np.minimum(n[i], n[j]) >= p * np.maximum(n[i], n[j]))
    return np.where(may, -(-SHARED // np.clip(need, 1, SHARED)), 0)


def by_bucket(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Whole buckets (by k and chunk) of rows that come sorted by them, as columns, many at a time."""
    held = [np.empty(0, dtype=np.int64)] * len(names)
    for batch in batches:
        held = [np.concatenate([h, batch.column(n).to_numpy().astype(np.int64)]) for h, n in zip(held, names, strict=True)]
        if len(held[0]):
            last = np.nonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))[0]
            if len(last):
                cut = last[-1] + 1
                yield [h[:cut] for h in held]
                held = [h[cut:] for h in held]
    if len(held[0]):
        yield held


def wide_buckets(entries: DataFrame, hot: np.ndarray, p: int, q: int) -> DataFrame:
    """The entries of buckets of at least two classes, each class once, and `near`: the one before in order of n, if it
    fits, and how much it counts (weight)."""
    shared = entries.sparkSession.sparkContext.broadcast(hot.view(np.int64))
    parted = entries.repartition("k", "chunk").sortWithinPartitions("k", "chunk", "n", "cls")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_bucket(batches, ("k", "chunk", "cls", "at", "n")):
            k, chunk, cls, at, n = held
            other = np.concatenate([[True], (k[1:] != k[:-1]) | (chunk[1:] != chunk[:-1])])
            new = other | np.concatenate([[True], cls[1:] != cls[:-1]])  # tasks may have given a class twice
            k, chunk, cls, at, n = (x[new] for x in held)
            other = other[new]
            single = other & np.concatenate([other[1:], [True]]) & ~np.isin(k, shared.value)
            i = np.arange(1, len(k))
            weight = np.concatenate([[0], np.where(other[1:], 0, _fits(at, n, i - 1, i, p, q))])
            before = pa.array(np.concatenate([[0], cls[:-1]]), mask=weight == 0)
            found = [pa.array(x) for x in (k, chunk.astype(np.int32), cls, at.astype(np.int32), n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*found, before, pa.array(weight.astype(np.int32))], names=["k", "chunk", "cls", "at", "n", "near", "weight"]).filter(pa.array(~single))

    return parted.mapInArrow(released(task), "k long, chunk int, cls long, at int, n int, near long, weight int")


def parted_pairs(entries: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b), a < b, once each: the pairs of classes of different groups (grp) that share enough buckets.

    A bucket's largest group is never paired with itself. Its classes stay in their chunk; the others visit all chunks.
    """
    sizes = entries.groupBy("k", "grp").agg(F.count(F.lit(1)).alias("size"), F.max("chunk").alias("last"))
    mains = sizes.groupBy("k").agg(F.max(F.struct("size", "grp")).alias("main"), F.max("last").alias("last"), F.count(F.lit(1)).alias("groups"))
    mains = mains.filter("groups > 1").select("k", F.col("main.grp").alias("main"), "last")
    dealt = entries.join(mains, "k").withColumn("visits", F.col("grp") != F.col("main"))
    to = F.explode(F.when(F.col("visits"), F.sequence(F.lit(0), F.col("last"))).otherwise(F.array("chunk")))
    parted = dealt.select("k", "chunk", to.alias("to"), "cls", "at", "n", "grp", "visits").select("k", F.col("to").alias("chunk"), "cls", "at", "n", "grp", F.when(F.col("visits"), F.when(F.col("chunk") == F.col("to"), 2).otherwise(1)).otherwise(0).alias("visits")).repartition("k", "chunk").sortWithinPartitions("k", "chunk", "n", "cls")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, chunk, cls, at, n, group, visits in by_bucket(batches, ("k", "chunk", "cls", "at", "n", "grp", "visits")):
            other = np.nonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (chunk[1:] != chunk[:-1])]))[0]
            ends = np.concatenate([other[1:], [len(k)]])
            bucket = np.repeat(np.arange(len(other)), ends - other)
            found, weight = [], 0
            for i in np.nonzero(visits)[0].tolist():
                lo, hi = other[bucket[i]], ends[bucket[i]]
                most = np.searchsorted(n[lo:hi], q * n[i] // p, "right") + lo  # in order of n: larger ones do not fit
                j = np.arange(np.searchsorted(n[lo:hi], -(-p * n[i] // q), "left") + lo, most)
                j = j[(group[j] != group[i]) & ((visits[j] == 0) | ((j > i) & (visits[i] == 2)))]  # two visitors meet where one is at home
                weight_of = _fits(at, n, i, j, p, q)
                j, weight_of = j[weight_of > 0], weight_of[weight_of > 0]
                found.append(np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j]), weight_of]))
                weight += len(j)
                if weight > 100_000:
                    yield _pairs(found)
                    found, weight = [], 0
            if found:
                yield _pairs(found)

    return enough(parted.mapInArrow(released(task), "a long, b long, weight int"))


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    a, b, weight = np.concatenate(found, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(weight.astype(np.int32))], names=["a", "b", "weight"])


def enough(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b), once each, that share at least SHARED shingles by their weights."""
    return pairs.groupBy("a", "b").agg(F.sum("weight").alias("weight")).filter(F.col("weight") >= SHARED).select("a", "b")


def verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame, words: int, p: int, q: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets have a Jaccard similarity of at least p / q; the sets are made again from the
    text of one row of each class."""
    pairs = stored(pairs, "shingle-pairs")
    nodes = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    chosen = matched(rows.select("cls", "key of row"), nodes, "cls", "left_semi").groupBy("cls").agg(F.min("key of row").alias("key of row"))
    chosen = stored(chosen, "shingle-nodes")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(raw or b"", words)).tobytes() for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["cls", "shingles"])

    few = chosen.count() <= BROADCAST_KEYS
    texts = docs.select("key of row", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen) if few else chosen, "key of row")
    sets = texts.select("cls", "text").mapInArrow(released(shingle), "cls long, shingles binary").dropDuplicates(["cls"])
    sets = stored(sets, "shingle-sets")
    held = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [[np.frombuffer(s, dtype="<u8") for s in batch.column(i).to_pylist()] for i in (2, 3)]
            keep = [alike(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), p, q) for a, b in zip(*both, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return held.select("a", "b", "sa", "sb").mapInArrow(released(task), "a long, b long")


def near_copies(docs: DataFrame, words: int, budget: int, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """The rows of `classed`, stored, and (cls, component) of the classes that have links: all pairs of classes with a
    similarity of at least p / q are linked, and no others. Texts without words are one class. docs are keyed."""
    p, q = similarity
    common, chunks = common_shingles(docs, words)
    rows = stored(classed(docs, words, p, q, common), "shingle-rows")
    buckets = stored(wide_buckets(prefix_entries(rows, common, chunks), common[chunks > 1], p, q), "shingle-buckets")
    near = link_fingerprints(rows.groupBy("fp").agg(F.min("cls").alias("id")), budget)
    beside = enough(buckets.filter("weight > 0").select(F.least("cls", "near").alias("a"), F.greatest("cls", "near").alias("b"), "weight"))
    first = beside.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    links = checkpointed(verified(docs, rows, first, words, p, q))
    parts = connected_components(links).withColumnsRenamed({"node": "cls", "component": "part"})
    grouped = buckets.drop("near", "weight").join(parts, "cls", "left").withColumn("grp", F.coalesce("part", "cls"))
    links = links.unionByName(verified(docs, rows, parted_pairs(grouped, p, q), words, p, q))
    return rows, connected_components(links).withColumnRenamed("node", "cls")


def drop_near_copies(docs: DataFrame, words: int, budget: int, similarity: tuple[int, int]) -> DataFrame:
    """docs with one row of each component: the one with the least doc_id; rows with a null one come last, ties go by text.

    Rows that are not linked stay, whatever their doc_id. Of rows alike in doc_id and text one stays. Null and empty texts
    are alike. An empty table stays empty; other columns may have any name.
    """
    docs = keyed(docs)
    columns = [c for c in docs.columns if c != "key of row"]
    with scratch(docs.sparkSession):  # the result reads only the table of the rows that go
        rows, parts = near_copies(docs, words, budget, similarity)
        named = rows.select("key of row", "cls", "doc_id").join(parts, "cls", "left")
        best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key of row")).alias("best")
        kept = named.groupBy(F.coalesce("component", "cls").alias("component")).agg(best).select(F.col("best.key of row").alias("key of row"))
        counted = rows.groupBy("key of row").agg(F.count(F.lit(1)).alias("n")).join(kept.withColumn("kept", F.lit(True)), "key of row", "left")
        other = stored(counted.filter("kept IS NULL OR n > 1"), "near-copies", keep=True)
    again = other.filter("kept").select("key of row")
    out = matched(docs, other.select("key of row"), "key of row", "left_anti")
    if not again.isEmpty():
        out = out.unionByName(matched(docs, again, "key of row", "left_semi").dropDuplicates(["key of row"]))
    return out.select(*columns)
