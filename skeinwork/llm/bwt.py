"""Burrows-Wheeler transforms of collections of short strings, and their merge by refining an interleave."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class ShardBwt:
    """A shard's suffixes in order: the character before each (0: none, the suffix is a whole string), the row of the suffix
    one longer, and the position. Positions count the strings' characters one after another, each string with its terminator.
    """

    chars: np.ndarray
    longer: np.ndarray
    positions: np.ndarray


def shard_bwt(text: np.ndarray, lengths: np.ndarray, depth: int = 1 << 62) -> ShardBwt:
    """The transform of strings given as one array of characters 1 to 255; terminators are least and ordered as their strings.

    Suffixes that agree in their first `depth` characters may come in any order.
    """
    ends = np.cumsum(lengths + 1) - 1
    n = int(lengths.sum()) + len(lengths)
    inner = np.ones(n, dtype=bool)
    inner[ends] = False
    coded = np.zeros(n + 8, dtype=np.uint8)
    coded[:n][inner] = text
    string = np.repeat(np.arange(len(lengths)), lengths + 1)
    left = ends[string] - np.arange(n)  # characters before the terminator
    key = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | np.where(i < left, coded[i : i + n], 0).astype(np.uint64)
    order = np.argsort(key, kind="stable")  # of equal ones that end, the one of the earlier string comes first
    ended = left[order] < 8
    fresh = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (ended[1:] & ended[:-1])])
    rank, width = np.empty(n, dtype=np.int64), 8
    while width < depth:  # each round sorts what is still tied by twice as many characters
        first = np.nonzero(fresh)[0]
        start = first[np.cumsum(fresh) - 1]
        rank[order] = start
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.nonzero(tied)[0]
        if not len(at):
            break
        members = order[at]
        ahead = rank[np.minimum(members + width, n - 1)]
        by = np.argsort(rank[members] * (n + 1) + ahead, kind="stable")
        order[at] = members[by]
        ahead, own = ahead[by], rank[members[by]]
        fresh[at] = np.concatenate([[True], (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])])
        width *= 2
    row = np.empty(n, dtype=np.int64)
    row[order] = np.arange(n)
    before = np.maximum(order - 1, 0)
    chars = np.where((order > 0) & inner[before], coded[before], 0).astype(np.uint8)
    return ShardBwt(chars, row[before], order)


def merge_blocks(shards: list[ShardBwt], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows (counted over the shards one after another) whose suffixes share their first `depth` characters with
    another's, in the merged order, and the block of each.

    A round takes the interleave of suffixes sorted by h characters to h + 2: read in the present order, the two characters
    before them deal the suffixes two places longer, stably, so no suffix is compared again. What a round leaves together
    is a block, whose suffixes have a common prefix of that length. A suffix alone in its block is settled and leaves the
    interleave, as all longer ones that end in it are alone too. An odd depth begins with a round of one character.
    """
    starts = np.cumsum([0, *(len(s.chars) for s in shards)])
    chars = np.concatenate([s.chars for s in shards])
    longer = np.concatenate([s.longer + a for s, a in zip(shards, starts, strict=False)]).astype(np.int32)
    second = chars[longer]
    pairs = np.where((chars > 0) & (second > 0), second.astype(np.uint16) << 8 | chars, 0).astype(np.uint16)
    far = longer[longer]
    rows, block = np.arange(len(chars), dtype=np.int32), np.zeros(len(chars), dtype=np.int32)
    for code, onward in [(chars, longer)] * (depth % 2) + [(pairs, far)] * (depth // 2):
        before = code[rows]
        dealt = np.argsort(before, kind="stable")
        before = before[dealt]
        inside = int(np.searchsorted(before, 1))  # the others are whole strings
        dealt, before = dealt[inside:], before[inside:]
        if not len(dealt):
            rows, block = rows[:0], block[:0]
            break
        block = block[dealt]
        fresh = np.concatenate([[True], (before[1:] != before[:-1]) | (block[1:] != block[:-1]), [True]])
        shared = ~(fresh[:-1] & fresh[1:])
        block = np.cumsum(fresh[:-1], dtype=np.int32)[shared]
        rows = onward[rows[dealt[shared]]]
    return rows.astype(np.int64), block.astype(np.int64)


def repeated_intervals(texts: list[bytes], depth: int, shard_bytes: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, block) of every suffix that shares its first `depth` characters with another, in merged order."""
    none = (np.empty(0, dtype=np.int64),) * 3
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    text = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if not len(text):
        return none
    used = np.zeros(256, dtype=bool)
    used[text] = True
    if used.all():
        raise ValueError("a collection may use 255 different bytes at most")  # UTF-8 never uses all of them
    text = np.cumsum(used).astype(np.uint8)[text]
    group = (np.cumsum(lengths + 1) - 1) // shard_bytes
    cuts = [0, *(np.nonzero(group[1:] != group[:-1])[0] + 1).tolist(), len(texts)]
    at = np.concatenate([[0], np.cumsum(lengths)])
    shards = [shard_bwt(text[at[a] : at[b]], lengths[a:b], depth) for a, b in zip(cuts, cuts[1:], strict=False)]
    rows, block = merge_blocks(shards, depth)
    positions = np.concatenate([s.positions for s in shards])
    offsets = np.cumsum([0, *(len(s.positions) for s in shards)])[:-1]
    place = (positions + np.repeat(offsets, [len(s.positions) for s in shards]))[rows]
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    string = np.searchsorted(first, place, "right") - 1
    return string, place - first[string], block
