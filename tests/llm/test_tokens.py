"""BPE, packing and sharding against the libraries and by properties."""

import base64
import hashlib
import os
import random
import struct
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from skeinwork.llm import bpe, packing, sharding
from skeinwork.llm.tokens import UnitEncoder, tokenizer_of_file

PATH = public_tokenizers.path(bpe.RANKS)
PARTS = ["a", "aa", " ", "  ", "=", "-", "!", "\n", "\t", "é", "ß", "in", "er", "0", "000", "'s", "’", "中", "　", "\x85", "\xa0", "\x1c", "😀", "ж", "՘", "\r\n", "<|endoftext|>"]


def texts(n, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_round_trip(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t, "x") for i, t in enumerate(texts(800))] + [(900, None, None), (901, "word " * 30_000, ""), (0, "again", "")]
    out = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH).collect()
    want = []
    for doc, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, out)) == sorted(want)
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_encode_and_decode(spark):
    df = spark.createDataFrame([(1, "héllo wörld 😀😀"), (2, None)], "doc_id long, text string")
    encoded = bpe.encode_documents(df, PATH)
    row = encoded.filter("doc_id = 1").first()
    assert row["starts"][0] == 0 and row["ends"][-1] == len("héllo wörld 😀😀")
    assert all(a < b for a, b in zip(row["starts"], row["ends"], strict=True)) and sorted(row["starts"]) == row["starts"]
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode_documents(encoded, PATH).collect()} == {1: "héllo wörld 😀😀", 2: ""}


def test_small_cache():
    encoder, _, _ = bpe._codec(PATH)
    sample = texts(300, 9)
    want = [encoder.ids(t).tolist() for t in sample]
    small = UnitEncoder(encoder.tokenizer, public_tokenizers.PATTERN, 10, 10)
    assert [x.tolist() for x in small.ids_of(sample)] == want
    assert [small.ids(t).tolist() for t in sample] == want
    assert max(len(x) for table in (small.units, small.matches) for x in (table.young, table.old)) <= 10


def test_encoder_is_the_untouched_library(spark):
    path = public_tokenizers.path(packing.VOCABULARY)
    fresh = Tokenizer.from_file(path)
    sample = [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    sample += [*texts(3000, 5), "", " ", "\n", "a\nb", "a \nb", "a\n\nb", "x<|endoftext|>y", " <|endoftext|> ", "don't we'll 'tis", "a.'s b", "co\u0301te", "²½ word² é.", "a\u2028 b", "one\x1c two"]
    encoder = packing._encoder(path)
    want = [e.ids for e in fresh.encode_batch(sample, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.ids_of(sample)] == want
    as_text = UnitEncoder(tokenizer_of_file(path, special_as_text=True), public_tokenizers.PATTERN)
    assert as_text.ids("<|endoftext|>").tolist() == [27, 91, 437, 1659, 5239, 91, 29] and encoder.ids("<|endoftext|>").tolist() == [50256]


def test_new_words_cost_no_python_calls_each():
    """Unknown words are split, encoded and looked up many at a time, and the tables stay bounded."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijé", k=9)) + rng.choice(["", ",", ".%%%"]) for _ in range(20_000)]
    sample = [" ".join(words[at : at + 500]) + "\nx" for at in range(0, len(words), 500)]
    path = public_tokenizers.path(packing.VOCABULARY)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(sample, add_special_tokens=False)]
    for most in (1_000, 15_000, 300_000):
        encoder, calls = UnitEncoder(tokenizer_of_file(path), public_tokenizers.PATTERN, most, most), []
        sys.setprofile(lambda _, event, __, calls=calls: calls.append(event) if event in ("call", "c_call") else None)
        try:
            first = encoder.ids_of(sample)
        finally:
            sys.setprofile(None)
        assert len(calls) < 5_000
        assert [x.tolist() for x in first] == want and [x.tolist() for x in encoder.ids_of(sample[::-1])] == want[::-1]
        assert max(len(x) for table in (encoder.units, encoder.matches) for x in (table.young, table.old)) <= most // 2
    assert encoder.ids(sample[3]).tolist() == want[3]


def test_binary_pieces():
    for n in (0, 1, 1023, 1024, 1025, 5000):
        pieces = packing.binary_pieces(n)
        assert sum(length for _, length in pieces) == n and all(length & (length - 1) == 0 and length <= 1024 for _, length in pieces)
        assert [start for start, _ in pieces] == np.cumsum([0, *(length for _, length in pieces)])[:-1].tolist()


def test_packing(spark):
    path = public_tokenizers.path(packing.VOCABULARY)
    fresh = Tokenizer.from_file(path)
    rows = [(i, t, "x") for i, t in enumerate(texts(60))] + [(100, None, "x"), (101, "many words " * 2000, "x"), (101, "same id", "x")]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, bucket string").repartition(3), path).collect()
    assert len({r["sequence_id"] for r in out}) == len(out) and {r["offset"] for r in out} == {0}
    for doc, text, _ in rows[:62]:
        if doc == 101:
            continue
        ids = [*fresh.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted((r for r in out if r["doc_id"] == doc), key=lambda r: r["start"])
        assert [i for r in pieces for i in np.frombuffer(r["ids"], dtype="<u4")] == ids
        assert all(r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[r["start"] : r["start"] + r["length"]])) and r["doc_tokens"] == len(ids) and r["length"] == 1 << r["bucket"] for r in pieces)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_buckets(spark, tmp_path):
    path = public_tokenizers.path(packing.VOCABULARY)
    docs = spark.createDataFrame([(i, "some words of it " * (i % 90)) for i in range(1500)] + [(None, "no id"), (None, None)], "doc_id long, text string").coalesce(1)
    packing.write_buckets(packing.pack_documents(docs, path), str(tmp_path / "sequences"))
    back = spark.read.parquet(str(tmp_path / "sequences"))
    by_batch = {}
    for r in back.collect():
        assert r["length"] == 1 << r["bucket"] == len(r["ids"]) // 4
        by_batch.setdefault(r["batch_id"], []).append(r["length"])
    assert all(len(set(x)) == 1 and sum(x) <= packing.BATCH_IDS for x in by_batch.values())
    partial = [x for x in by_batch.values() if sum(x) < packing.BATCH_IDS]
    assert len(partial) <= 2 * 11 and any(sum(x) == packing.BATCH_IDS for x in by_batch.values())
    report = {r["bucket"]: r["tokens"] for r in packing.bucket_report(back).collect()}
    assert sum(report.values()) == sum(map(sum, by_batch.values()))


def test_sharding(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(3000)] + [(i, "the same text " * 20) for i in range(3000, 5000)] + [(7000, None), (7001, ""), (7, "again"), (None, "no id")]
    out = sharding.shard_documents(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h int").repartition(5)).collect()
    assert len(out) == len(rows)
    assert sum(r["text_crc32"] for r in out) == sum(zlib.crc32((t or "").encode()) for _, t in rows)
    sizes = [sum(r["size"] for r in out if r["shard"] == s) for s in range(8)]
    assert sum(sizes) == sum(len((t or "").encode()) + 1 for _, t in rows) and max(sizes) - min(sizes) < 0.05 * sum(sizes) / 8
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_sharding_query_row_by_row(spark):
    """Size, checksum and law of every document, slots without gaps, and shards within one text of the mean."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: (len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()), "bytes", None) for r in rows}
    out = sharding.query(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in out} == want and len(out) == len(rows)
    held = {s: [r for r in out if r["shard"] == s] for s in range(8)}
    assert sum(map(len, held.values())) == len(out)
    mean, largest = sum(size for size, *_ in want.values()) / 8, max(size for size, *_ in want.values())
    for s, found in held.items():
        assert sorted(r["slot"] for r in found) == list(range(len(found)))
        assert abs(sum(r["size"] for r in found) - mean) <= largest, s
