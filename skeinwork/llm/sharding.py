"""Operator 6: sharding by sampled splitters.

Records are ordered by (hash of the text, doc_id). A sample drawn with chances in proportion to size gives quantile
boundaries; records are range-partitioned by them, ranges that hold too many bytes are subdivided by fresh samples of
their own, and runs of neighbouring ranges make shards of nearly equal bytes. Equal texts are neighbours and share a
shard, unless their group is larger than a range, where doc_id divides it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import stored, widened

SHARDS = 8
#: Ranges for each shard, and size-weighted samples for each range; their product bounds what reaches the driver.
RANGES_PER_SHARD, SAMPLES_PER_RANGE = 128, 16
#: A range of more than so many times the mean is subdivided, for at most so many rounds.
OVERFULL, ROUNDS = 1.5, 4


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, and h, the hash that orders texts; null is taken as no bytes."""
    raw = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("h"))


def _draw(rows: DataFrame, rate: float, salt: int) -> DataFrame:
    """Rows that a hash of their keys draws with a chance of rate times size."""
    chance = (F.xxhash64(F.lit(salt), F.col("h"), F.col("doc_id")).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
    return rows.filter(chance < F.col("size") * rate)


def _splitters(samples: list[tuple[int, int, int]], pieces: int, rate: float) -> list[tuple[int, int]]:
    """Keys at the quantiles of the sampled bytes; a sample stands for 1/rate bytes, or its own size if that is more."""
    samples = sorted((h, doc, max(size, 1 / rate)) for h, doc, size in samples)
    weight = np.cumsum([w for *_, w in samples])
    if not len(weight):
        return []
    at = np.searchsorted(weight, weight[-1] * np.arange(1, pieces) / pieces)
    return sorted({samples[i][:2] for i in at.tolist()})


def assign_ranges(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """rows with `range`: the number of splitters that are no greater than (h, doc_id)."""
    shared = rows.sparkSession.sparkContext.broadcast((np.array([h for h, _ in splitters], dtype=np.int64), np.array([d for _, d in splitters], dtype=np.int64)))
    at_h, at_doc = rows.columns.index("h"), rows.columns.index("doc_id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, docs = shared.value
        for batch in batches:
            h, doc = batch.column(at_h).to_numpy(), batch.column(at_doc).fill_null(-(1 << 63)).to_numpy()
            low, high = np.searchsorted(hs, h, "left"), np.searchsorted(hs, h, "right")
            for first in np.unique(low[low < high]).tolist():  # few: hashes that are splitters themselves
                tied = np.nonzero((low == first) & (high > first))[0]
                last = int(high[tied[0]])
                low[tied] = first + np.searchsorted(docs[first:last], doc[tied], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low.astype(np.int32))], names=[*batch.schema.names, "range"])

    return rows.mapInArrow(task, widened(rows, range="integer"))


def find_splitters(rows: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """Boundaries of ranges of nearly equal bytes."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    rate = ranges * SAMPLES_PER_RANGE / total
    found = _splitters([(r["h"], r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["size"]) for r in _draw(rows, rate, 0).collect()], ranges, rate)
    target = total / ranges
    for salt in range(1, ROUNDS + 1):
        placed = assign_ranges(rows, found)
        full = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).filter((F.col("bytes") > OVERFULL * target) & (F.col("n") > 1)).collect()
        if not full:
            break
        again = F.broadcast(rows.sparkSession.createDataFrame([(r["range"], SAMPLES_PER_RANGE * 4 / target) for r in full], "range int, rate double"))
        chance = (F.xxhash64(F.lit(salt), F.col("h"), F.col("doc_id")).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
        drawn = placed.join(again, "range").filter(chance < F.col("size") * F.col("rate")).collect()
        before = len(found)
        for r in full:
            own = [(x["h"], x["doc_id"] if x["doc_id"] is not None else -(1 << 63), x["size"]) for x in drawn if x["range"] == r["range"]]
            found = sorted({*found, *_splitters(own, int(np.ceil(r["bytes"] / target)), SAMPLES_PER_RANGE * 4 / target)})
        if len(found) == before:
            break
    return found


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard), range.

    Shards are nearly equal in bytes: they differ by about one range. Null and empty texts have size 1; repeated rows
    are placed one by one; an empty table gives no rows. Texts are read once and never shuffled. The driver sees a
    bounded sample of keys and a row for each range. Only the id and the text are read, whatever else there is.
    """
    spark = docs.sparkSession
    rows = stored(records(docs, id_col, text_col), "shard-records")
    placed = assign_ranges(rows, find_splitters(rows, shards * RANGES_PER_SHARD))
    sums = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).orderBy("range").collect()
    total, before, slots, plan = sum(r["bytes"] for r in sums), 0, [0] * shards, []
    for r in sums:
        shard = min(shards - 1, int((before + r["bytes"] / 2) * shards / total))
        plan.append((r["range"], shard, slots[shard]))
        slots[shard] += r["n"]
        before += r["bytes"]
    ranges = F.broadcast(spark.createDataFrame(plan, "range int, shard int, first_slot long"))  # a row for each range
    number = F.expr("row_number() OVER (PARTITION BY range ORDER BY h, doc_id, text_crc32, size) - 1")
    return placed.withColumn("number", number).join(ranges, "range").select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("number")).alias("slot"), "range")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    placed = shard_documents(docs)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
