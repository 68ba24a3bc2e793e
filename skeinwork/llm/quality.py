"""Operator 8: quality rules by a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte trigrams: the trusted target (documents labelled good) and the raw corpus (every
document). A document's score is its log-likelihood ratio over its number of trigrams. The threshold lies a fixed margin
below the score that all but a fixed share of held-out trusted documents reach, so the same tables give the same verdicts.
Every trusted document counts: one half by hash fits the target, the other one is held out and calibrates.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import as_bytes, map_rows, released, scratch, stored

#: Buckets of the hashed trigrams; the model is two vectors of this length whatever the corpus.
BUCKETS = 1 << 16
#: The share of held-out trusted documents that may score under the level, and how far the threshold lies under it.
TRUSTED_LOSS, MARGIN = 0.001, 0.02
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))


def trigram_buckets(raw: bytes) -> np.ndarray:
    """The bucket of each byte trigram."""
    a = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.empty(0, dtype=np.int64)
    packed = a[:-2] | (a[1:-1] << np.uint32(8)) | (a[2:] << np.uint32(16))
    return ((packed * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for i, window in enumerate(windows):
        if often[window] > 1:
            covered[i : i + 3] = 1
    return int(covered.sum())


def base_features(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text's bytes."""
    words = raw.split()
    seen, duplicates = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            duplicates += bool(line.split())
        else:
            seen.add(line)
    return (
        len(words),
        len(b"".join(words).translate(None, _CONTINUATION)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        duplicates,
        repeated_words(words),
    )


@dataclass(frozen=True)
class RatioModel:
    """The log ratio of each bucket and the least score that is kept (None: none is fitted, all pass)."""

    log_ratio: np.ndarray
    threshold: float | None

    def score(self, raw: bytes) -> float:
        buckets = trigram_buckets(raw)
        return float(self.log_ratio[buckets].mean()) if len(buckets) else 0.0


def trusted(labels: DataFrame) -> DataFrame:
    """(doc_id, fits) of every document of which no label says it is bad: whether it fits the target or calibrates."""
    good = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).filter("q = 1")
    return good.select("doc_id", (F.xxhash64(F.lit("trusted"), F.col("doc_id")).bitwiseAND(F.lit(1)) == 0).alias("fits"))


def trusted_ids(labels: DataFrame) -> list[tuple[int, bool]]:
    """The rows of trusted() at hand, to look at small tables; fit does not use it."""
    return [tuple(r) for r in trusted(labels).collect()]


def trigram_counts(texts: DataFrame) -> np.ndarray:
    """Trigram counts by bucket over every row of texts (text); at most BUCKETS rows reach the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            held, weight = [], 0
            for text in batch.column(0).to_pylist():
                buckets = trigram_buckets(text)
                held.append(buckets)
                weight += len(buckets)
                if weight > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, weight = [], 0
            if held:
                counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    counted = texts.select(as_bytes(texts["text"])).mapInArrow(released(task), "bucket long, n long")
    counts = np.zeros(BUCKETS)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def lower_level(scores: DataFrame, share: float) -> float | None:
    """The score under which a share of all scores (score) lies, between the two nearest ones; None where there is none.

    Only the scores up to there are gathered, which are that share of them.
    """
    rows = scores.count()
    if not rows:
        return None
    place = share * (rows - 1)
    low = int(place)
    ends = sorted(r[0] for r in scores.orderBy("score").limit(min(low + 2, rows)).orderBy(F.desc("score")).limit(min(2, rows)).collect())
    return ends[0] + (place - low) * (ends[-1] - ends[0])


def fit(docs: DataFrame, labels: DataFrame) -> RatioModel:
    """The model of a corpus; without a trusted document the ratio is 0 everywhere and every document passes.

    The texts of trusted documents are found by a shuffled join, so neither their ids nor their texts need fit anywhere.
    """
    spark = docs.sparkSession
    with scratch(spark):
        texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
        known = stored(texts.join(trusted(labels).hint("shuffle_hash"), "doc_id").select("text", "fits"), "trusted")
        target = trigram_counts(known.filter("fits"))
        if not target.sum():
            return RatioModel(np.zeros(BUCKETS), None)
        raw = trigram_counts(docs)
        model = RatioModel(np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS)), None)
        shared = spark.sparkContext.broadcast(model)

        def start():
            ratio = shared.value
            return lambda values: [(ratio.score(values[0]),)]

        scores = map_rows(known.filter("NOT fits").select(as_bytes("text")), start, {"score": ("double", pa.float64())})
        level = lower_level(stored(scores, "trusted-scores"), TRUSTED_LOSS)
    return RatioModel(model.log_ratio, None if level is None else level - MARGIN)


def score_documents(docs: DataFrame, model: RatioModel) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged alike. Only doc_id and text are
    read, so other columns may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        ratio = shared.value

        def one(values):
            found = base_features(values[1])
            failed = found[0] < MIN_WORDS or 100 * found[4] > MAX_REPEAT_PERCENT * found[0]
            score = ratio.score(values[1])
            yield values[0], *found, failed, score, not failed and (ratio.threshold is None or score >= ratio.threshold)

        return one

    long, flag = ("long", pa.int64()), ("boolean", pa.bool_())
    return map_rows(
        docs.select(docs["doc_id"].cast("long"), as_bytes(docs["text"])),
        start,
        {"doc_id": long, "n_words": long, "word_chars": long, "n_symbols": long, "n_dup_lines": long, "n_repeat_words": long, "base_failed": flag, "score": ("double", pa.float64()), "kept": flag},
    )


def filter_documents(docs: DataFrame, model: RatioModel) -> DataFrame:
    """The rows of docs that score_documents keeps, with all their columns; memory is bounded by one Arrow batch."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            keep = []
            for raw in batch.column(at).cast(pa.binary()).to_pylist():
                raw = raw or b""
                n_words, *_, repeats = base_features(raw)
                keep.append(n_words >= MIN_WORDS and 100 * repeats <= MAX_REPEAT_PERCENT * n_words and (ratio.threshold is None or ratio.score(raw) >= ratio.threshold))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(released(task), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    return score_documents(docs, fit(docs, labels))
