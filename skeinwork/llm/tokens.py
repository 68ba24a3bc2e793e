"""Byte-level BPE through the tokenizers library, with whole units of text kept between calls."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer, models, pre_tokenizers

#: The first of some white space: a match of the splitting pattern always begins there.
_CUT = re.compile(r"(?<=\S)(?=[ \n\r\t])").split
#: White space that is not alone between other characters (for Arrow's expressions), so that not every space begins a match.
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUNS = rf"{_BLANK}{{2}}|\A{_BLANK}|{_BLANK}\z"
#: Marks after a word that the pattern need not split.
_MARKS = "!#$%&)*,./:;<=>?@]|}~-"
#: What is left of such a unit: letters that both libraries class alike, and the white space before them (for Arrow's expressions).
_PLAIN = r"\A[ \n]?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2af}]+\z"
#: Below this character the regex module and the tokenizers library class all characters alike; units beyond it go to the library whole.
_AGREED = "\u0500"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the others get code points from 256 upward in order of value.
    """
    printable = [chr(b).isprintable() and not chr(b).isspace() for b in range(256)]
    out, spare = [], 256
    for value, shown in enumerate(printable):
        out.append(chr(value) if shown else chr(spare))
        spare += not shown
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """The token of each rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def tokenizer_of_ranks(ranks: dict[bytes, int]):
    """A byte-level BPE tokenizer of the tokenizers library that merges by ranks.

    Every way to cut a token in two known tokens is a merge, in order of the token's rank, and a match that is a token
    itself is taken whole; so the pair whose joined token has the least rank is merged first.
    """
    shown = byte_characters()
    name = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = [
        (name[token[:cut]], name[token[cut:]])
        for token in sorted(ranks, key=ranks.__getitem__)
        for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    ]
    made = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return made


def tokenizer_of_file(path: str, special_as_text: bool = False):
    """The tokenizer of a file; with special_as_text the strings of special tokens in a text are ordinary text."""
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = special_as_text
    return made


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id, by the reversed byte table."""
    value = {c: b for b, c in enumerate(byte_characters())}
    table = [b""] * (max(tokenizer.get_vocab().values()) + 1)
    for shown, token_id in tokenizer.get_vocab().items():
        table[token_id] = bytes(value[c] for c in shown) if all(c in value for c in shown) else shown.encode()
    return table


def gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of runs, given by start and size, one run after another."""
    ends = np.cumsum(sizes)
    return ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


class Runs:
    """Runs of ids, each by its start and size in one array; `keys` are the texts that they are of."""

    def __init__(self, keys: pa.Array, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.keys, self.ids, self.starts, self.sizes = keys, ids, starts, sizes

    def __len__(self) -> int:
        return len(self.keys)

    def at(self, places: np.ndarray) -> Runs:
        """Some of the runs, with no more than their own keys and ids."""
        starts, sizes = self.starts[places], self.sizes[places]
        return Runs(self.keys.take(pa.array(places)), gathered(self.ids, starts, sizes), np.cumsum(sizes) - sizes, sizes)

    @staticmethod
    def joined(parts: list[Runs]) -> Runs:
        """The runs of one part after those of another."""
        before = np.cumsum([0, *(len(p.ids) for p in parts)])
        starts = np.concatenate([p.starts + n for p, n in zip(parts, before, strict=False)])
        return Runs(pa.concat_arrays([p.keys for p in parts]), np.concatenate([p.ids for p in parts]), starts, np.concatenate([p.sizes for p in parts]))

    @staticmethod
    def none() -> Runs:
        return Runs(pa.array([], pa.large_string()), np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


class Recent:
    """A bounded table of what was computed last: an older and a younger half; what is asked for again moves to the younger.

    A lookup hashes the table, so a call with few keys computes them instead.
    """

    def __init__(self, compute: Callable[[pa.Array], Runs], most: int):
        self.compute, self.half = compute, max(1, most // 2)
        self.young, self.old = Runs.none(), Runs.none()

    def of(self, keys: pa.Array) -> Runs:
        """The ids of each of different keys; unknown ones are computed all at once."""
        if len(keys) * 100 < len(self.young) + len(self.old):
            return self.compute(keys)
        held = Runs.joined([self.young, self.old])
        found = pc.fill_null(pc.index_in(keys, value_set=held.keys), -1).to_numpy().astype(np.int64)
        unknown = found < 0
        new = self.compute(keys.filter(pa.array(unknown)))
        found[unknown] = len(held) + np.arange(len(new))
        every = Runs.joined([held, new])
        missed = found[found >= len(self.young)]
        if len(self.young) + len(missed) > self.half:
            self.young, self.old = every.at(missed[: self.half]), self.young if len(missed) <= self.half else every.at(missed[self.half : 2 * self.half])
        else:
            self.young = Runs.joined([self.young, every.at(missed)])
        return Runs(keys, every.ids, every.starts[found], every.sizes[found])


class UnitEncoder:
    """Encodes texts unit by unit, a unit being a word in the sense of white space, with the white space before it.

    The splitting pattern begins a match at every such place, so units never share a token. The different units of a call
    are looked up once; unknown ones are split by the pattern, and unknown matches are encoded many at a time. The ids of
    the most recent units and matches stay in bounded tables, which workers keep between tasks. Added tokens are cut out
    of texts first, as the library does, unless the tokenizer's encode_special_tokens makes them ordinary text.
    """

    def __init__(self, tokenizer, pattern: str, most_units: int = 300_000, most_matches: int = 300_000):
        self.tokenizer = tokenizer
        self.split = regex.compile(pattern).findall
        self.units, self.matches = Recent(self._encode, most_units), Recent(self._encode_matches, most_matches)
        self.words = Tokenizer.from_str(tokenizer.to_str())  # the same merges, for matches already shown, with a space between them
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.words.encode_special_tokens = True
        self.lengths = np.array([len(t) for t in token_bytes(tokenizer)], dtype=np.int64)
        self.shown = "".join(byte_characters())[:0xFF] + " "  # no text holds that byte, which parts matches
        self.added = {} if tokenizer.encode_special_tokens else {t.content: (i, t) for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.plain_added = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for _, t in self.added.values())

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text as unsigned 32-bit integers."""
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; a call with many texts costs less."""
        if self.cut_added is None or not any(map(self.cut_added.search, texts)):
            return self._ordinary(texts)
        if not self.plain_added:
            return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        parts = [self.cut_added.split(text) for text in texts]  # ordinary text and added tokens by turns
        found = iter(self._ordinary([x for p in parts for x in p[::2]]))
        return [np.concatenate([next(found) if i % 2 == 0 else np.array([self.added[x][0]], dtype="<u4") for i, x in enumerate(p)]) for p in parts]

    def _ordinary(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts without added tokens."""
        given = pa.array(texts, pa.large_string())
        runs = pc.match_substring_regex(given, _RUNS)
        pieces = [_CUT(t) for t in given.filter(runs).to_pylist()]
        split = pc.split_pattern(pc.replace_substring(given.filter(pc.invert(runs)), "\n", " \n"), " ")
        coded = split.flatten().dictionary_encode()
        bare, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        listed = pc.if_else(pc.starts_with(bare, "\n"), bare, pc.binary_join_element_wise(pa.scalar("", bare.type), bare, pa.scalar(" ", bare.type)))
        counts = pc.list_value_length(split).to_numpy().astype(np.int64)
        heads = np.cumsum(counts) - counts
        # units without the space that the split took: those at a text's start, and the pieces of untidy texts
        whole = pa.concat_arrays([listed, bare.take(pa.array(codes[heads])), pa.array(list(chain.from_iterable(pieces)), bare.type)]).dictionary_encode()
        place = whole.indices.to_numpy().astype(np.int64)
        codes, cut = place[codes], place[len(bare) + len(heads) :]
        codes[heads] = place[len(bare) : len(bare) + len(heads)]
        found = self.units.of(whole.dictionary)

        def joined(codes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
            sizes = found.sizes[codes]
            return np.split(gathered(found.ids, found.starts[codes], sizes), np.cumsum(sizes)[np.cumsum(counts) - 1][:-1]) if len(counts) else []

        of_tidy, of_cut = iter(joined(codes, counts)), iter(joined(cut, np.array([len(p) for p in pieces], dtype=np.int64)))
        return [next(of_cut if run else of_tidy) for run in runs.to_pylist()]

    def _encode(self, units: pa.Array) -> Runs:
        """The ids of each unit."""
        left = pc.utf8_rtrim(units, characters=_MARKS)
        plain = pc.match_substring_regex(left, _PLAIN)
        simple, others = units.filter(plain), units.filter(pc.invert(plain)).to_pylist()
        # a line feed, a word with the space before it, and marks: three parts of each unit, which may be empty
        data, bounds = _bytes_of(simple)
        words = bounds[:-1] + pc.binary_length(left.filter(plain)).to_numpy()
        cuts = np.append(np.stack([bounds[:-1], bounds[:-1] + pc.starts_with(simple, "\n").to_numpy(zero_copy_only=False), words], axis=1).ravel(), len(data))
        parts = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data))
        agreed = [unit.isascii() or max(unit) < _AGREED for unit in others]
        lists = [self.split(unit) for unit, known in zip(others, agreed, strict=True) if known]
        rare = [e.ids for e in self.tokenizer.encode_batch_fast([u for u, known in zip(others, agreed, strict=True) if not known], add_special_tokens=False)]
        listed = pa.concat_arrays([parts.filter(pa.array(np.diff(cuts) > 0)), pa.array(list(chain.from_iterable(lists)), pa.large_string())]).dictionary_encode()
        found, codes = self.matches.of(listed.dictionary), listed.indices.to_numpy()
        sizes = found.sizes[codes]
        ids = np.concatenate([gathered(found.ids, found.starts[codes], sizes), np.array(list(chain.from_iterable(rare)), dtype="<u4")])
        # the matches of each unit, then the ids of each: in the order of the parts, simple units before the others
        counts = np.concatenate([(np.diff(cuts) > 0).reshape(-1, 3).sum(axis=1), np.array([len(x) for x in lists], dtype=np.int64)])
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        own = np.concatenate([np.diff(ends), np.array([len(x) for x in rare], dtype=np.int64)])
        order, split = np.empty(len(units), dtype=np.int64), np.array(agreed, dtype=bool)
        mask = plain.to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~mask)
        order[np.concatenate([np.flatnonzero(mask), rest[split], rest[~split]])] = np.arange(len(units))
        return Runs(units, ids, (np.cumsum(own) - own)[order], own[order])

    def _encode_matches(self, matches: pa.Array) -> Runs:
        """The ids of each match of the pattern, of which none is empty."""
        ids, sizes = [], []
        for at in range(0, len(matches), 20_000):
            data, bounds = _bytes_of(matches[at : at + 20_000])
            shown = np.insert(data, bounds[1:-1], 0xFF).tobytes().decode("latin-1").translate(self.shown)
            ids.append(np.array(self.words.encode_batch_fast([shown], add_special_tokens=False)[0].ids, dtype="<u4"))
            sizes.append(np.diff(np.searchsorted(np.cumsum(self.lengths[ids[-1]]), bounds[1:]) + 1, prepend=0))
        own = np.concatenate([np.zeros(0, dtype=np.int64), *sizes])
        return Runs(matches, np.concatenate([np.zeros(0, dtype="<u4"), *ids]), np.cumsum(own) - own, own)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large strings, and where each begins and the last ends."""
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return held[bounds[0] : bounds[-1]], bounds - bounds[0]
