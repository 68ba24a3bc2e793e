"""Operator 3: byte-level BPE encoding and decoding over Arrow batches."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from skeinwork.llm.common import as_bytes, map_rows
from skeinwork.llm.tokens import UnitEncoder, read_ranks, token_bytes, tokenizer_of_ranks

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Texts are encoded together up to so many bytes.
GROUP_BYTES = 4 << 20


@cache
def _codec(ranks_path: str) -> tuple[UnitEncoder, list[bytes], np.ndarray]:
    tokenizer = tokenizer_of_ranks(read_ranks(ranks_path))
    table = token_bytes(tokenizer)
    return UnitEncoder(tokenizer, public_tokenizers.PATTERN), table, np.array([len(t) for t in table], dtype=np.int64)


def decode_ids(ids: np.ndarray, table: list[bytes]) -> bytes:
    """The bytes of the ids; characters whose bytes several tokens share come out whole as the bytes are joined first."""
    return b"".join([table[i] for i in ids.tolist()])


def character_offsets(ids: np.ndarray, text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the character after its last; a split character belongs to each of its tokens."""
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    begins = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
    return begins[np.minimum(starts + 1, ends)] - 1, begins[ends]


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, `ids` (array<int>), `starts` and `ends` (array<int>, in characters of the text).

    Null and empty texts have no ids. Rows are independent: repeated ids stay as they are; other columns are not read.
    """

    def start():
        encoder, _, lengths = _codec(ranks_path)

        def many(rows):
            found = encoder.ids_of([raw.decode("utf-8", "replace") for _, raw in rows])
            for (doc, raw), ids in zip(rows, found, strict=True):
                first, last = character_offsets(ids, raw, lengths) if len(ids) else (ids, ids)
                yield doc, ids.astype(np.int32), first.astype(np.int32), last.astype(np.int32)

        return many

    ints = ("array<int>", pa.list_(pa.int32()))
    return map_rows(docs.select(docs[id_col].cast("long"), as_bytes(docs[text_col])), start, {id_col: ("long", pa.int64()), "ids": ints, "starts": ints, "ends": ints}, flush_rows=256, group_bytes=GROUP_BYTES)


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: its id and `decoded` (binary). Null ids give no bytes; an id outside the vocabulary fails the job."""

    def start():
        _, table, _ = _codec(ranks_path)
        return lambda values: [(values[0], decode_ids(np.array(values[1] or [], dtype=np.int64), table))]

    return map_rows(encoded.select(id_col, ids_col), start, {id_col: ("long", pa.int64()), "decoded": ("binary", pa.binary())})


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass and keeps digests: n_tokens, ids_sha256, decoded_sha256.

    One row per input row. Null and empty texts have 0 tokens and the digests of nothing. Only the id and the text are
    read, so other columns may have any name.
    """

    def start():
        encoder, table, _ = _codec(ranks_path)

        def many(rows):
            found = encoder.ids_of([raw.decode("utf-8", "replace") for _, raw in rows])
            for (doc, _), ids in zip(rows, found, strict=True):
                listed = str(ids.tolist())[1:-1].replace(" ", "")
                yield doc, len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decode_ids(ids, table)).hexdigest()

        return many

    return map_rows(
        docs.select(docs[id_col].cast("long"), as_bytes(docs[text_col])),
        start,
        {id_col: ("long", pa.int64()), "n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())},
        group_bytes=GROUP_BYTES,
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path(RANKS))
