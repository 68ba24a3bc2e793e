"""Operator 5: packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are powers of two (as many of the greatest length as fit, then the
binary digits of the rest, long pieces first). A piece is a sequence of its own, so no sequence crosses documents, none
needs padding, and sequences of equal length share a bucket, in which they are gathered to batches of equal numbers of ids.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import as_bytes, map_rows
from skeinwork.llm.tokens import UnitEncoder, tokenizer_of_file

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
END_ID = 0
#: Ids of a full batch, all of one bucket.
BATCH_IDS = 1 << 16
#: Texts are encoded together up to so many bytes.
GROUP_BYTES = 4 << 20


@cache
def _encoder(path: str) -> UnitEncoder:
    return UnitEncoder(tokenizer_of_file(path), public_tokenizers.PATTERN)


def binary_pieces(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: lengths are powers of two of at most `limit`, itself a power of two."""
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    whole, rest = divmod(n, limit)
    lengths = [limit] * whole + [1 << bit for bit in reversed(range(limit.bit_length())) if rest >> bit & 1]
    starts = np.concatenate([[0], np.cumsum(lengths)]).tolist() if lengths else []
    return list(zip(starts, lengths, strict=False))


def pack_documents(docs: DataFrame, vocabulary: str, limit: int = LIMIT, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of the length),
    batch_id, ids.

    The ids are those of the untouched tokenizer, its added tokens included. Null and empty texts are the end id alone,
    and an empty table gives no rows. Repeated rows are packed once each; null ids stay null. sequence_id numbers the
    sequences of a task after the task's own number, so it is unique, and the same again when a lost task is run again;
    so is batch_id, by which a task gathers BATCH_IDS ids of one bucket (its last batch of each bucket may be shorter).
    Memory is bounded by one Arrow batch and the longest document; nothing is shuffled. Other columns are not read.
    """

    def start():
        encoder, context = _encoder(vocabulary), TaskContext.get()
        base, made = (context.partitionId() if context else 0) << 33, 0
        end = np.array([end_id], dtype="<u4")
        open_batch, batches = {}, 0  # length: its batch that is not full, and the sequences there

        def many(rows):
            nonlocal made, batches
            for (doc, _), own in zip(rows, encoder.ids_of([raw.decode("utf-8", "replace") for _, raw in rows]), strict=True):
                ids = np.concatenate([own, end])
                for at, length in binary_pieces(len(ids), limit):
                    piece = ids[at : at + length].tobytes()
                    batch, held = open_batch.get(length, (None, 0))
                    if held * length % BATCH_IDS == 0:
                        batch, held, batches = batches, 0, batches + 1
                    open_batch[length] = batch, held + 1
                    yield doc, at, length, zlib.crc32(piece), len(ids), base + made, 0, length.bit_length() - 1, base + batch, piece if with_ids else None
                    made += 1

        return many

    long = ("long", pa.int64())
    fields = {id_col: long, "start": long, "length": long, "ids_crc32": long, "doc_tokens": long, "sequence_id": long, "offset": long, "bucket": ("int", pa.int32()), "batch_id": long, "ids": ("binary", pa.binary())}
    return map_rows(docs.select(docs[id_col].cast("long"), as_bytes(docs[text_col])), start, fields, group_bytes=GROUP_BYTES)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes the sequences with their ids, a folder for each length, whose files hold one batch after another."""
    packed.write.partitionBy("bucket").parquet(path)


def bucket_report(packed: DataFrame) -> DataFrame:
    """Sequences and ids of each bucket."""
    return packed.groupBy("bucket").agg(F.count(F.lit(1)).alias("sequences"), F.sum("length").alias("tokens"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path(VOCABULARY), with_ids=False).drop("ids")
