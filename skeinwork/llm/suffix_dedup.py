"""Operator 7: suffix-array dedup by merging shard Burrows-Wheeler transforms.

A document's bytes go when they lie in a string of SPAN bytes that also starts in a document with a smaller doc_id. Few
strings can be such, so candidates are found first, without loss: every string of SPAN bytes holds a least-hashed 16-byte
gram, its anchor, and the strings of one anchor in a row are a segment. Equal segments are known by their hash. Only
segments that share an anchor and the bytes beside it with a different segment need their bytes compared: they are dealt
by anchor, each task builds Burrows-Wheeler transforms of shards of them and merges these by refining an interleave up to
SPAN characters, after which the blocks are the repeated intervals. An anchor of very many segments is merged in shares
first; of what repeats within a share only the least document's occurrence goes on to the merge of all shares.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.bwt import repeated_intervals
from skeinwork.llm.common import as_bytes, give_back, released, scratch, stored

SPAN, GRAM, BESIDE = 50, 16, 17
WINDOW = SPAN - GRAM + 1
#: Bytes of text hashed together, bytes whose entries are sorted and sent together, and bytes of text for each part.
GROUP_BYTES, FLUSH_BYTES, PART_BYTES = 1 << 20, 8 << 20, 8 << 20
#: Entries are dealt to their part in steps of so many ways, so that a step's rows stay large whatever the number of parts.
FAN, REGROUP_BYTES = 4096, 64 << 20
#: Longer texts are cut in slices that overlap, so that a window lies in one of them.
SLICE_BYTES = 16 << 20
#: An anchor with more segments than this in one flush is sent on as hot; one with more in all is merged in shares.
HOT_SEGMENTS, WIDE_ANCHOR = 64, 2000
#: Bytes whose transforms are merged at once (more where one anchor has more), and bytes of a transform.
CHUNK_BYTES, SHARD_BYTES = 1 << 18, 1 << 16
_POSITION_BITS = np.uint64(27)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Codes of the bytes beside an anchor: none there, or cut off and so unknown.
_NOTHING, _UNKNOWN = 0, 65535
_TEXT, _SEGMENT, _DONE = 0, 1, 2


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


class Entries:
    """Segments as columns: anchor, segment hash, code left and right, document index, start, number of strings."""

    names = ("anchor", "segment", "left", "right", "doc", "start", "strings")
    kinds = (np.uint64, np.uint64, np.uint16, np.uint16, np.int64, np.int64, np.uint8)

    def __init__(self, *columns: np.ndarray):
        self.columns = columns
        for name, column in zip(self.names, columns, strict=True):
            setattr(self, name, column)

    def __len__(self) -> int:
        return len(self.columns[0])

    def take(self, at: np.ndarray) -> Entries:
        return Entries(*(c[at] for c in self.columns))

    @classmethod
    def joined(cls, parts: list[Entries]) -> Entries:
        return cls(*(np.concatenate([p.columns[i] for p in parts]) if parts else np.empty(0, dtype=k) for i, k in enumerate(cls.kinds)))


def segments_of(pieces: list[tuple[int, int, bool, bool, bytes]]) -> Entries:
    """The segments of pieces (document index, offset in it, whether text goes on before and after, bytes)."""
    buffer = np.frombuffer(b"".join(p[4] for p in pieces), dtype=np.uint8)
    if len(buffer) < SPAN:
        return Entries.joined([])
    sizes = np.array([len(p[4]) for p in pieces])
    ends = np.cumsum(sizes)
    first = ends - sizes
    piece_of = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    hashes, width = {1: buffer.astype(np.uint64) + np.uint64(1)}, 1
    while width < 32:
        h = hashes[width]
        h = h[:-width] * _M1 + h[width:]
        hashes[2 * width] = (h ^ (h >> np.uint64(29))) * _M2
        width *= 2
    grams = _mix(hashes[16])
    key = (grams & ~((np.uint64(1) << _POSITION_BITS) - np.uint64(1))) | np.arange(len(grams), dtype=np.uint64)  # of equal grams the leftmost
    least, span = key, 1
    while 2 * span <= WINDOW:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < WINDOW:
        least = np.minimum(least[: len(least) - (WINDOW - span)], least[WINDOW - span :])
    starts = np.nonzero(piece_of[: len(buffer) - SPAN + 1] == piece_of[SPAN - 1 :])[0]
    if not len(starts):
        return Entries.joined([])
    least = least[starts]
    fresh = np.concatenate([[True], (least[1:] != least[:-1]) | (piece_of[starts[1:]] != piece_of[starts[:-1]])])
    at = np.nonzero(fresh)[0]
    strings = np.diff(np.concatenate([at, [len(starts)]]))
    start, anchor = starts[at], least[at]
    where = (anchor & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))).astype(np.int64)
    size = strings - 1 + SPAN
    h32 = hashes[32]
    segment = _mix(_mix(h32[start] * _M1 + h32[start + (size - 32) // 2]) + h32[start + size - 32] + size.astype(np.uint64)) >> np.uint64(16)
    piece = piece_of[start]
    lead = np.array([p[2] for p in pieces])[piece]
    trail = np.array([p[3] for p in pieces])[piece]
    left, right = (np.zeros(len(at), dtype=np.uint16) for _ in range(2))
    h16 = hashes[16]
    fits = where - BESIDE >= first[piece]
    w = where[fits]
    left[fits] = 1 + (_mix(h16[w - BESIDE] * _M1 + h16[w - 16]) % np.uint64(_UNKNOWN - 1)).astype(np.uint16)
    left[~fits & lead] = _UNKNOWN
    fits = where + GRAM + BESIDE <= ends[piece]
    w = where[fits] + GRAM
    right[fits] = 1 + (_mix(h16[w] * _M1 + h16[w + BESIDE - 16]) % np.uint64(_UNKNOWN - 1)).astype(np.uint16)
    right[~fits & trail] = _UNKNOWN
    docs = np.array([p[0] for p in pieces], dtype=np.int64)[piece]
    offset = np.array([p[1] for p in pieces], dtype=np.int64)[piece] + start - first[piece]
    return Entries(anchor >> _POSITION_BITS, segment, left, right, docs, offset, strings.astype(np.uint8))


def judge(e: Entries, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries, e.doc indexing doc_ids: which lie in a smaller document as a whole, which need their bytes compared, and the
    number of segments of each one's anchor. Entries of segment hash 0 say that their anchor is hot elsewhere."""
    repeated, pending, different = (np.zeros(len(e), dtype=bool), np.zeros(len(e), dtype=bool), np.ones(len(e), dtype=np.int64))
    order = np.argsort(e.anchor)
    anchor = e.anchor[order]
    alike = anchor[1:] == anchor[:-1]
    at = order[np.concatenate([alike, [False]]) | np.concatenate([[False], alike])] if len(order) else order
    if len(at):  # most anchors are held once
        repeated[at], pending[at], different[at] = _judge_shared(e.take(at), doc_ids)
    return repeated, pending, different


def _judge_shared(e: Entries, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What judge says of entries whose anchors are held at least twice."""
    ids = doc_ids[e.doc]
    order = np.lexsort((ids, e.segment, e.anchor))
    anchor, segment, ids = e.anchor[order], e.segment[order], ids[order]
    new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    new_segment = new_anchor | np.concatenate([[True], segment[1:] != segment[:-1]])
    group, anchor_no = np.cumsum(new_segment) - 1, np.cumsum(new_anchor) - 1
    mark = segment == 0
    repeated = (ids > ids[new_segment][group]) & ~mark
    different = np.bincount(anchor_no[new_segment])[anchor_no]
    hot = np.bincount(anchor_no, weights=mark)[anchor_no] > 0
    beside = np.zeros(len(order), dtype=bool)
    for code in (e.left[order], e.right[order]):
        unknown = np.bincount(anchor_no, weights=code == _UNKNOWN)[anchor_no] > 0
        pair = np.lexsort((segment, code, anchor))
        a, c, s = anchor[pair], code[pair], segment[pair]
        start = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
        no = np.cumsum(start) - 1
        kinds = np.bincount(no, weights=start | np.concatenate([[True], s[1:] != s[:-1]]))[no]
        alike = np.empty(len(pair), dtype=bool)
        alike[pair] = (kinds > 1) & (c != _NOTHING)
        beside |= alike | unknown
    pending = ~repeated & ~mark & (hot | (beside & (different > 1)))
    back = [np.empty(len(order), dtype=x.dtype) for x in (repeated, pending, different)]
    for out, x in zip(back, (repeated, pending, different), strict=True):
        out[order] = x
    return tuple(back)


_PLANES = {"anchor": 5, "segment": 6, "left": 2, "right": 2, "start": 4, "strings": 1}


def _planes(column: np.ndarray, count: int) -> bytes:
    """The low `count` bytes of each number, one byte's place after another, which compresses well."""
    return np.ascontiguousarray(column.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :count].T).tobytes()


def _unplanes(raw: memoryview, n: int, count: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :count] = np.frombuffer(raw, dtype=np.uint8, count=n * count).reshape(count, n).T
    return out.reshape(-1).view("<u8")


def pack(e: Entries, at: np.ndarray, doc_ids: np.ndarray, checks: np.ndarray, names: tuple[str, ...]) -> bytes:
    """Entries `at` as bytes: their documents' ids and checksums, and the named columns; entries come sorted by document."""
    doc = e.doc[at]
    used, counts = np.unique(doc, return_counts=True)
    raw = [struct.pack("<qq", len(used), len(at)), doc_ids[used].astype("<i8").tobytes(), checks[used].astype("<u4").tobytes(), counts.astype("<u4").tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*raw, *(_planes(getattr(e, n)[at], _PLANES[n]) for n in names)]))


def unpack(blob: bytes, names: tuple[str, ...]) -> tuple[Entries, np.ndarray, np.ndarray]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    docs, n = struct.unpack_from("<qq", raw)
    ids = np.frombuffer(raw, dtype="<i8", count=docs, offset=16)
    checks = np.frombuffer(raw, dtype="<u4", count=docs, offset=16 + 8 * docs)
    counts = np.frombuffer(raw, dtype="<u4", count=docs, offset=16 + 12 * docs)
    columns, at = {"doc": np.repeat(np.arange(docs), counts)}, 16 + 16 * docs
    for name in names:
        columns[name] = _unplanes(raw[at:], n, _PLANES[name])
        at += n * _PLANES[name]
    return Entries(*(columns.get(name, np.zeros(n, dtype=k)).astype(k) for name, k in zip(Entries.names, Entries.kinds, strict=True))), ids, checks


_ALL = ("anchor", "segment", "left", "right", "start", "strings")
_COVERED, _PENDING = ("start", "strings"), ("anchor", "start", "strings")
_ROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
_CANDIDATES, _IS_COVERED, _IS_PENDING = 0, 1, 2
_NAMES = {_CANDIDATES: _ALL, _IS_COVERED: _COVERED, _IS_PENDING: _PENDING}


def _doc_parts(ids: np.ndarray, checks: np.ndarray, parts: int) -> np.ndarray:
    """The part of each text, by its id and checksum, so that rows without an id are spread."""
    return (_mix(ids.astype(np.uint64) + _mix(checks.astype(np.uint64) * _M1)) % np.uint64(parts)).astype(np.int32)


def _anchor_parts(anchor: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(anchor) % np.uint64(parts)).astype(np.int32)


def _rows(kind: int, e: Entries, chosen: np.ndarray, part_of: np.ndarray, ids: np.ndarray, checks: np.ndarray, names: tuple[str, ...]) -> list[tuple]:
    """Rows (part, kind, blob) of the chosen entries by their parts."""
    at = np.nonzero(chosen)[0]
    order = at[np.lexsort((e.start[at], e.doc[at], part_of[at]))]
    cuts = np.nonzero(np.concatenate([[True], part_of[order][1:] != part_of[order][:-1], [True]]))[0] if len(order) else []
    return [(int(part_of[order[a]]), kind, pack(e, order[a:b], ids, checks, names)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)


def _pieces(index: int, raw: bytes) -> Iterator[tuple]:
    for at in range(0, max(1, len(raw)), SLICE_BYTES):
        yield index, at, at > 0, at + SLICE_BYTES < len(raw), raw[at : at + SLICE_BYTES + SPAN - 1]


def candidates(texts: DataFrame, parts: int, ways: int) -> DataFrame:
    """(part, kind, blob): entries by anchor, and what a flush of texts decides by itself by document; a part is still its
    number's remainder by `ways`."""

    def flush(docs: list[tuple[int, bytes]]) -> list[tuple]:
        ids, checks = np.array([d for d, _ in docs], dtype=np.int64), np.array([zlib.crc32(t) for _, t in docs], dtype=np.uint32)
        found, held, weight = [], [], 0
        for piece in (p for i, (_, t) in enumerate(docs) for p in _pieces(i, t)):
            held.append(piece)
            weight += len(piece[4])
            if weight >= GROUP_BYTES:
                found.append(segments_of(held))
                held, weight = [], 0
        e = Entries.joined([*found, segments_of(held)] if held else found)
        if not len(e):
            return []
        repeated, _, different = judge(e, ids)
        hot = ~repeated & (different > HOT_SEGMENTS)
        by_doc, by_anchor = _doc_parts(ids, checks, parts)[e.doc] % ways, _anchor_parts(e.anchor, parts) % ways
        out = _rows(_IS_COVERED, e, repeated, by_doc, ids, checks, _COVERED) + _rows(_IS_PENDING, e, hot, by_doc, ids, checks, _PENDING)
        sign = np.zeros(len(e), dtype=bool)
        if hot.any():
            sign[np.nonzero(hot)[0][np.unique(e.anchor[hot], return_index=True)[1]]] = True
            e.segment[sign] = 0
        return out + _rows(_CANDIDATES, e, (~repeated & ~hot) | sign, by_anchor, ids, checks, _ALL)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, weight = [], 0
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append((doc, raw))
                weight += len(raw)
                if weight >= FLUSH_BYTES:
                    if rows := flush(docs):
                        yield _row_batch(rows)
                    docs, weight, rows = [], 0, None
                    give_back()
        if docs and (rows := flush(docs)):
            yield _row_batch(rows)

    return texts.mapInArrow(released(task), "part int, kind int, blob binary")


def regrouped(found: DataFrame, parts: int, ways: int, fan: int) -> DataFrame:
    """Rows whose part is a remainder by `ways` as rows whose part is the remainder by ways * fan."""
    dealt = found.repartition("kind", "part").sortWithinPartitions("kind", "part").select("part", "kind", "blob")

    def regroup(kind: int, blobs: list[bytes]) -> list[tuple]:
        loaded = [unpack(b, _NAMES[kind]) for b in blobs]
        base = np.cumsum([0, *(len(ids) for _, ids, _ in loaded)])
        e = Entries.joined([Entries(*x.columns[:4], x.doc + b, *x.columns[5:]) for (x, _, _), b in zip(loaded, base, strict=False)])
        ids, checks = np.concatenate([i for _, i, _ in loaded]), np.concatenate([c for *_, c in loaded])
        to = _anchor_parts(e.anchor, parts) if kind == _CANDIDATES else _doc_parts(ids, checks, parts)[e.doc]
        return _rows(kind, e, np.ones(len(e), dtype=bool), to % (ways * fan), ids, checks, _NAMES[kind])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, blobs, weight = None, [], 0
        for batch in batches:
            for part, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if blobs and (group != (part, kind) or weight > REGROUP_BYTES):
                    yield _row_batch(regroup(group[1], blobs))
                    blobs, weight = [], 0
                group = part, kind
                blobs.append(blob)
                weight += len(blob)
        if blobs:
            yield _row_batch(regroup(group[1], blobs))

    return dealt.mapInArrow(released(task), "part int, kind int, blob binary")


def to_parts(found: DataFrame, parts: int, fan: int) -> DataFrame:
    """Rows dealt by the first step as rows of their final parts."""
    ways = fan
    while ways < parts:
        found, ways = regrouped(found, parts, ways, fan), ways * fan
    return found


def verdicts(found: DataFrame, parts: int, ways: int) -> DataFrame:
    """(part, kind, blob) by document, of the first step again: what is covered and what is pending."""
    spread = F.when(F.col("kind") == _CANDIDATES, F.xxhash64("part")).otherwise(F.xxhash64(F.lit(1), "part", F.xxhash64("blob")))
    dealt = found.withColumn("deal", spread).repartition("deal").sortWithinPartitions("kind", "part").select("part", "kind", "blob")

    def decide(blobs: list[bytes]) -> list[tuple]:
        loaded = [unpack(b, _ALL) for b in blobs]
        base = np.cumsum([0, *(len(ids) for _, ids, _ in loaded)])
        e = Entries.joined([Entries(*x.columns[:4], x.doc + b, *x.columns[5:]) for (x, _, _), b in zip(loaded, base, strict=False)])
        ids, checks = np.concatenate([i for _, i, _ in loaded]), np.concatenate([c for *_, c in loaded])
        repeated, pending, _ = judge(e, ids)
        by_doc = _doc_parts(ids, checks, parts)[e.doc] % ways
        return _rows(_IS_COVERED, e, repeated, by_doc, ids, checks, _COVERED) + _rows(_IS_PENDING, e, pending, by_doc, ids, checks, _PENDING)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = None, []
        for batch in batches:
            other = []
            for p, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind != _CANDIDATES:
                    other.append((p, kind, blob))
                    continue
                if p != part and blobs:
                    if rows := decide(blobs):
                        yield _row_batch(rows)
                    blobs = []
                part = p
                blobs.append(blob)
            if other:
                yield _row_batch(other)
        if blobs and (rows := decide(blobs)):
            yield _row_batch(rows)

    return dealt.mapInArrow(released(task), "part int, kind int, blob binary")


def _ranges(blobs: list[bytes], names: tuple[str, ...]) -> dict[tuple[int, int], list[tuple]]:
    """(doc_id, checksum) -> its entries' columns `names`, from packed rows."""
    out: dict[tuple[int, int], list] = {}
    for blob in blobs:
        e, ids, checks = unpack(blob, names)
        columns = [getattr(e, n).astype(np.int64) for n in names]
        cuts = np.searchsorted(e.doc, np.arange(len(ids) + 1))
        for i, (doc, check) in enumerate(zip(ids.tolist(), checks.tolist(), strict=True)):
            out.setdefault((doc, check), []).append([c[cuts[i] : cuts[i + 1]] for c in columns])
    return {k: [np.concatenate(c) for c in zip(*v, strict=True)] for k, v in out.items()}


def _remove(raw: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs of them, and what is left, of a text and its covered ranges."""
    if not len(starts):
        return 0, 0, raw
    step = np.zeros(len(raw) + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    gone = np.cumsum(step[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()


_STATE = "kind int, part int, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, ranges binary, anchor long, start long"


def _state_table(rows: list[tuple]) -> pa.Table:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in _STATE.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def apply_verdicts(texts: DataFrame, found: DataFrame, give: Callable[[bytes, bytes], bytes]) -> DataFrame:
    """Texts with what covers them: done ones, ones that wait (with their ranges), and the segments that they wait for."""

    def group(docs: pa.Table, rows: pa.Table) -> pa.Table:
        kinds, blobs = rows.column("kind").to_pylist(), rows.column("blob").to_pylist()
        covered = _ranges([b for k, b in zip(kinds, blobs, strict=True) if k == _IS_COVERED], _COVERED)
        pending = _ranges([b for k, b in zip(kinds, blobs, strict=True) if k == _IS_PENDING], _PENDING)
        out, none = [], np.empty(0, dtype=np.int64)
        for part, doc, raw in zip(*(docs.column(n).to_pylist() for n in ("part", "doc_id", "raw")), strict=True):
            key = (doc, zlib.crc32(raw))
            starts, strings = covered.get(key, (none, none))
            if key not in pending:
                removed, spans, kept = _remove(raw, starts, strings + SPAN - 1)
                out.append((_DONE, part, doc, len(raw), removed, spans, give(raw, kept), None, None, None))
                continue
            out.append((_TEXT, part, doc, len(raw), None, None, raw, np.stack([starts, strings + SPAN - 1]).astype("<i8").tobytes(), None, None))
            for anchor, start, count in zip(*(c.tolist() for c in pending[key]), strict=True):
                out.append((_SEGMENT, part, doc, None, None, None, raw[start : start + count + SPAN - 1], struct.pack("<I", key[1]), anchor, start))
        return _state_table(out)

    return texts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(group, _STATE)


def _digest(raw: bytes) -> bytes:
    return hashlib.sha256(raw).hexdigest().encode()


def _whole_characters(raw: bytes) -> bytes:
    return raw.decode("utf-8", "ignore").encode()


#: What remove_repeats can give of the bytes that are left.
_GIVES = {
    "bytes": lambda raw, kept: bytes(kept),
    "digest": lambda raw, kept: _digest(kept),
    "text": lambda raw, kept: _whole_characters(kept),
    "keyed": lambda raw, kept: hashlib.md5(raw).digest() + _whole_characters(kept),
}


_RUNS = "deal long, part int, doc_id long, check binary, start long, strings long, bytes binary"


def sided(runs: list[bytes]) -> list[tuple[int, int, int]]:
    """(run, strings before its half, hash) of the halves of runs of strings that share their anchor: the strings with at
    least BESIDE bytes before the anchor go by these, the others by those after it. Equal strings have equal hashes."""
    buffer = np.frombuffer(b"".join(runs) + bytes(GRAM), dtype=np.uint8)
    h, width = buffer.astype(np.uint64) + np.uint64(1), 1
    while width < GRAM:
        h = h[:-width] * _M1 + h[width:]
        h, width = (h ^ (h >> np.uint64(29))) * _M2, 2 * width
    below = (np.uint64(1) << _POSITION_BITS) - np.uint64(1)
    sizes = np.array([len(r) for r in runs])
    first = np.cumsum(sizes) - sizes
    key = (_mix(h) & ~below) | np.arange(len(h), dtype=np.uint64)
    least = np.minimum.reduceat(key, np.stack([first, first + sizes - GRAM + 1]).T.ravel())[::2]
    anchors = (least & below).astype(np.int64) - first
    out = []
    for i, (run, at) in enumerate(zip(runs, anchors.tolist(), strict=True)):
        count = len(run) - SPAN + 1
        cut = min(max(at - BESIDE + 1, 0), count)
        if cut:
            out.append((i, 0, xxhash.xxh3_64_intdigest(run[at - BESIDE : at + GRAM])))
        if cut < count:
            out.append((i, cut, xxhash.xxh3_64_intdigest(run[at : at + GRAM + BESIDE], 1)))
    return out


def merged_runs(dealt: DataFrame, rest: bool) -> DataFrame:
    """Runs of strings of the segments (deal, part, doc_id, check, start, bytes), compared within each `deal`, that also
    start in a smaller document; with `rest` also the runs of the others, in halves, with their bytes and where to deal them."""
    parted = dealt.repartition("deal").sortWithinPartitions("deal")

    def merge(held: list[list]) -> pa.RecordBatch:
        _, part, doc, check, start, texts = held
        string, offset, block = repeated_intervals(texts, SPAN, SHARD_BYTES)
        docs = np.array(doc, dtype=np.int64)
        least = np.full(int(block.max()) + 1 if len(block) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, block, docs[string])
        again = docs[string] > least[block]
        # every string of every segment in order, and whether it is repeated
        sizes = np.array([len(t) - SPAN + 1 for t in texts])
        first = np.cumsum(sizes) - sizes
        gone = np.zeros(int(sizes.sum()), dtype=bool)
        gone[first[string[again]] + offset[again]] = True
        edge = np.zeros(len(gone) + 1, dtype=bool)
        edge[first], edge[-1] = True, True
        edge[1:-1] |= gone[1:] != gone[:-1]
        cuts = np.nonzero(edge)[0]
        begin, count = cuts[:-1], np.diff(cuts)
        chosen = np.ones(len(begin), dtype=bool) if rest else gone[begin]
        begin, count = begin[chosen], count[chosen]
        of = np.searchsorted(first, begin, "right") - 1
        at, deal = begin - first[of], np.zeros(len(begin), dtype=np.int64)
        left: list[bytes | None] = [None] * len(begin)
        if rest and (stays := np.nonzero(~gone[begin])[0]).size:
            kept = [texts[i][o : o + n + SPAN - 1] for i, o, n in zip(of[stays].tolist(), at[stays].tolist(), count[stays].tolist(), strict=True)]
            halves = sided(kept)
            run = np.array([r for r, *_ in halves])
            cut = np.array([c for _, c, _ in halves], dtype=np.int64)
            ends = np.where(np.concatenate([run[1:] == run[:-1], [False]]), np.concatenate([cut[1:], [0]]), count[stays][run])
            left = [None] * (len(begin) - len(stays)) + [kept[r][c : e + SPAN - 1] for r, c, e in zip(run.tolist(), cut.tolist(), ends.tolist(), strict=True)]
            away = np.nonzero(gone[begin])[0]
            deal = np.concatenate([deal[away], np.array([h for *_, h in halves], dtype=np.uint64).view(np.int64)])
            of, at, count = (np.concatenate([x[away], y]) for x, y in ((of, of[stays][run]), (at, at[stays][run] + cut), (count, ends - cut)))
        columns = [pa.array(deal), pa.array([part[i] for i in of.tolist()], pa.int32()), pa.array(docs[of]), pa.array([check[i] for i in of.tolist()], pa.binary())]
        columns += [pa.array(np.array(start, dtype=np.int64)[of] + at), pa.array(count), pa.array(left, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["deal", "part", "doc_id", "check", "start", "strings", "bytes"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [[] for _ in range(6)], 0
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if weight >= CHUNK_BYTES and values[0] != held[0][-1]:
                    yield merge(held)
                    held, weight = [[] for _ in range(6)], 0
                for column, value in zip(held, values, strict=True):
                    column.append(value)
                weight += len(values[5])
        if held[0]:
            yield merge(held)

    return parted.select("deal", "part", "doc_id", "check", "start", "bytes").mapInArrow(released(task), _RUNS)


def repeated_strings(segments: DataFrame) -> DataFrame:
    """(part, doc_id, check, start, strings): runs of strings of pending segments that also start in a smaller document.

    Segments meet by anchor. Those of wide anchors meet in shares first. What a share leaves, each different string of it
    once or in one document, meets by the anchor and the bytes beside it, or, where these are as frequent, string by string.
    """
    counts = segments.groupBy("anchor").count().filter(F.col("count") > WIDE_ANCHOR).select("anchor", F.ceil(F.col("count") / WIDE_ANCHOR).cast("int").alias("shares"))
    rows = segments.join(stored(counts, "wide-anchors"), "anchor", "left")
    share = F.when(F.col("shares").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id", "ranges", "start"), F.col("shares")))
    rows = rows.select(F.xxhash64("anchor", share).alias("deal"), F.col("shares").isNotNull().alias("wide"), "part", "doc_id", F.col("ranges").alias("check"), "start", F.col("kept").alias("bytes"))
    narrow = merged_runs(rows.filter("not wide"), rest=False)
    shared = stored(merged_runs(rows.filter("wide"), rest=True), "repeat-shares")
    left = shared.filter("bytes IS NOT NULL")
    frequent = left.groupBy("deal").count().filter(F.col("count") > WIDE_ANCHOR).select("deal", F.lit(True).alias("frequent"))
    left = left.join(stored(frequent, "wide-sides"), "deal", "left")
    strings = F.transform(F.sequence(F.lit(0).cast("long"), F.col("strings") - 1), lambda i: F.struct(i.alias("at"), F.substring(F.col("bytes"), i.cast("int") + 1, F.lit(SPAN)).alias("bytes")))
    single = left.filter("frequent").select("part", "doc_id", "check", "start", F.explode(strings).alias("x"))
    single = single.select(F.xxhash64("x.bytes").alias("deal"), "part", "doc_id", "check", (F.col("start") + F.col("x.at")).alias("start"), F.col("x.bytes").alias("bytes"))
    again = left.filter("frequent IS NULL").select("deal", "part", "doc_id", "check", "start", "bytes").unionByName(single)
    found = narrow.unionByName(shared.filter("bytes IS NULL")).unionByName(merged_runs(again, rest=False))
    return found.drop("bytes", "deal")


def finish(waiting: DataFrame, strings: DataFrame, give: Callable[[bytes, bytes], bytes]) -> DataFrame:
    def group(docs: pa.Table, rows: pa.Table) -> pa.Table:
        more: dict[tuple, list[tuple[int, int]]] = {}
        for doc, check, *run in zip(*(rows.column(n).to_pylist() for n in ("doc_id", "check", "start", "strings")), strict=True):
            more.setdefault((doc, check), []).append(run)
        out = []
        for part, doc, raw, ranges in zip(*(docs.column(n).to_pylist() for n in ("part", "doc_id", "kept", "ranges")), strict=True):
            starts, lengths = np.frombuffer(ranges, dtype="<i8").reshape(2, -1)
            own = np.array(more.get((doc, struct.pack("<I", zlib.crc32(raw))), []), dtype=np.int64).reshape(-1, 2)
            removed, spans, kept = _remove(raw, np.concatenate([starts, own[:, 0]]), np.concatenate([lengths, own[:, 1] + SPAN - 1]))
            out.append((_DONE, part, doc, len(raw), removed, spans, give(raw, kept), None, None, None))
        return _state_table(out)

    return waiting.groupBy("part").cogroup(strings.groupBy("part")).applyInArrow(group, _STATE)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", give: str = "bytes", fan: int = FAN, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (binary): by `give` the bytes that are left, the hexadecimal
    digits of their SHA-256 ("digest"), or the bytes less those of characters that a removal cut in parts ("text"), after
    the 16 bytes of the MD5 of the row's text ("keyed").

    Null and empty texts have no bytes. Rows that share a doc_id never cover each other; those that share the text as
    well have the same result. A null doc_id counts as the least of all. Texts shorter than SPAN bytes stay whole. An
    empty table gives no rows. What is left may be no valid UTF-8, so it comes as bytes. No other column is read.
    """
    raw = as_bytes(docs[text_col])
    texts = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))).alias("doc_id"), raw.alias("raw"))
    total = texts.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    parts = max(16, total // part_bytes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            checks = np.array([zlib.crc32(x) for x in batch.column(1).to_pylist()], dtype=np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(_doc_parts(batch.column(0).to_numpy(), checks, parts)), *batch.columns], names=["part", "doc_id", "raw"])

    placed = texts.mapInArrow(place, "part int, doc_id long, raw binary")
    with scratch(docs.sparkSession):
        found = to_parts(stored(verdicts(to_parts(candidates(texts, parts, fan), parts, fan), parts, fan), "repeat-verdicts"), parts, fan)
        state = stored(apply_verdicts(placed, found, _GIVES[give]), "repeat-state", ["kind"], keep=True)
    strings = repeated_strings(state.filter(F.col("kind") == _SEGMENT))
    done = state.filter(F.col("kind") == _DONE).unionByName(finish(state.filter(F.col("kind") == _TEXT).drop("kind"), strings, _GIVES[give]))
    id_back = F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id")
    return done.select(id_back, "n_bytes", "n_removed", "n_spans", "kept")


def kept_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of docs less their repeats and the bytes of characters that a removal cut in parts."""
    return remove_repeats(docs, give="text").select("doc_id", F.col("kept").cast("string").alias("text"))


def with_kept_texts(docs: DataFrame) -> DataFrame:
    """The rows of docs with the text that kept_texts gives them. Rows with null or repeated doc_ids stay, each with its
    own: they are told apart by their text, and those that share both have the same result."""
    id_of = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id of text")
    given = remove_repeats(docs, give="keyed").select(id_of, F.substring("kept", 1, 16).alias("md5 of text"), F.expr("substring(kept, 17)").cast("string").alias("text"))
    once = given.groupBy("id of text", "md5 of text").agg(F.first("text").alias("text"))
    others = docs.select(id_of, F.unhex(F.md5(as_bytes(docs["text"]))).alias("md5 of text"), *(c for c in docs.columns if c != "text"))
    return others.join(once, ["id of text", "md5 of text"]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    return remove_repeats(docs, give="digest").select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))
