"""Ids of a byte-level BPE tokenizer, where each distinct run of text is encoded once while a table lasts.

A unit is a run of white space and the run of other characters after it. No pre-token reaches over the
begin of a unit, so the ids of a text are those of its units in turn. Units of ASCII and the letters of
U+00C0 to U+00FF are cut into pre-tokens and merged side by side; all others, and long pre-tokens, go to the
tokenizer library.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import KEPT, SPACE, Texts, steps
from .packing import Merges, WordIds
from .tokens import byte_symbols

#: Longer pre-tokens go to the library.
LONGEST = 64
LETTER, DIGIT, SIGN, WHITE = 0, 1, 2, 3
_KIND = np.full(256, SIGN, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = LETTER
_KIND[48:58] = DIGIT
_KIND[SPACE] = WHITE
#: Apostrophes (contractions) and control characters are left to the library.
_ODD = np.zeros(256, bool)
_ODD[[*range(0x00, 0x09), *range(0x0E, 0x20), 0x27, 0x7F]] = True


def after_wide_space(buf: np.ndarray) -> np.ndarray:
    """For each byte, whether the character before it is white space beyond ASCII (or a control that some call so)."""
    one, two, three = (np.concatenate([np.zeros(k, np.uint8), buf[:-k]])[: len(buf)] for k in (1, 2, 3))
    out = (one >= 0x1C) & (one <= 0x1F)
    if (buf >= 0x80).any():
        out |= (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
        out |= (three == 0xE1) & (two == 0x9A) & (one == 0x80)
        out |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF)) & (one >= 0x80)
        out |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
        out |= (three == 0xE3) & (two == 0x80) & (one == 0x80)
    return out


class Units(Texts):
    """Texts whose words are units."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = buf, offsets.astype(np.int64)
        self.n, self._sums = len(offsets) - 1, None
        space = SPACE[buf]
        first = np.zeros(len(buf) + 1, bool)
        first[self.offsets] = True
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins &= ~after_wide_space(buf)
        begins |= first[:-1]
        self.space = space
        self.starts = np.flatnonzero(begins)
        self.ends = np.append(self.starts[1:], len(buf))[: len(self.starts)]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.words = np.diff(self.first)


def pre_tokens(t: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and units of the pre-tokens in simple units, and which units are not simple."""
    buf, n = t.buf, len(t.buf)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none, np.zeros(len(t.starts), bool)
    ahead = np.append(buf[1:], 32)
    odd = _ODD[buf] | ((buf == 0x3C) & (ahead == 0x7C))
    wide = buf >= 0x80
    if wide.any():
        lead = buf == 0xC3
        trail = np.append(False, lead[:-1])
        odd |= wide & ~lead & ~trail
        odd |= trail & ((buf == 0x97) | (buf == 0xB7))
    sums = np.zeros(n + 1, np.int32)
    np.cumsum(odd, out=sums[1:])
    slow = sums[t.ends] > sums[t.starts]
    kind = _KIND[buf]
    white = kind == WHITE
    border = np.append(True, kind[1:] != kind[:-1])
    border[t.starts] = True
    ends = np.zeros(n + 1, bool)
    ends[t.ends] = True
    # the last white space before other characters of its unit begins a pre-token, which goes on if it is a space
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~ends[1:-1])
    border[last] = True
    border[last[buf[last] == 0x20] + 1] = False
    starts = np.flatnonzero(border)
    unit = np.searchsorted(t.starts, starts, "right") - 1
    size = np.append(starts[1:], n) - starts
    slow[unit[size > LONGEST]] = True
    fast = ~slow[unit]
    return starts[fast], size[fast], unit[fast], slow


class ByteMerges(Merges):
    """Merges of a vocabulary without word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, pairs = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.inner = self.final = np.array([vocab[x] for x in byte_symbols()], np.int64)
        self.width, self.none = max(vocab.values()) + 1, np.int32(len(pairs))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key, rank = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64), np.arange(len(pairs), dtype=np.int32)
        # pairs by hash, so that most pairs that never merge are told by one look
        self.shift = np.uint64(64 - self.TABLE_BITS)
        self.slots, self.slot_ranks = np.full(1 << self.TABLE_BITS, -1, np.int64), np.full(1 << self.TABLE_BITS, self.none, np.int32)
        at = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.slots[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.slots[at[put]], self.slot_ranks[at[put]] = key[put], rank[put]
            left = np.ones(len(key), bool)
            left[put] = False
            key, rank, at = key[left], rank[left], (at[left] + 1) & ((1 << self.TABLE_BITS) - 1)

    #: Slots of the table of pairs, some five for each.
    TABLE_BITS = 18

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = self._slot(key)
        have = self.slots[at]
        out = self.slot_ranks[at]
        other = np.flatnonzero((have != key) & (have >= 0))
        out[have != key] = self.none
        at = at[other]
        while len(other):
            at = (at + 1) & ((1 << self.TABLE_BITS) - 1)
            have = self.slots[at]
            hit = have == key[other]
            out[other[hit]] = self.slot_ranks[at[hit]]
            on = ~hit & (have >= 0)
            other, at = other[on], at[on]
        return out


class ByteIds(WordIds):
    """Ids of texts by units."""

    SLOTS = 1 << 21

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.merges = Tokenizer.from_file(path), ByteMerges(path)
        self.renew()

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of units in turn, and how many each has."""
        t = Units(np.frombuffer(b"".join(words), np.uint8), np.zeros(1, np.int64))
        t.starts = np.cumsum([0, *map(len, words)])[:-1]
        t.ends = np.append(t.starts[1:], len(t.buf))
        starts, size, unit, odd = pre_tokens(t)
        ids, n = self.merges.ids(t.buf, starts, size)
        sizes = np.bincount(unit, n, len(words)).astype(np.int64)
        if not odd.any():
            return ids, sizes
        at = np.flatnonzero(odd).tolist()
        others = [x.ids for x in self.library.encode_batch_fast([words[i].decode() for i in at], add_special_tokens=False)]
        sizes[at] = list(map(len, others))
        out, of_odd = np.empty(sizes.sum(), np.int64), np.repeat(odd, sizes)
        out[~of_odd], out[of_odd] = ids, np.concatenate(others)
        return out, sizes

    def of_texts(self, column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first row, the ids of each text from there)."""
        for row, plain in steps(column, most=1 << 18):
            t = Units(plain.buf, plain.offsets)
            ids, n = self.of_words(t)
            yield row, np.split(ids, np.concatenate([[0], np.cumsum(n)])[t.first[1:-1]])


_byte_ids: dict[str, ByteIds] = {}
KEPT["bytebpe"] = _byte_ids.clear


def byte_ids(path: str) -> ByteIds:
    """One table for each worker process."""
    if path not in _byte_ids:
        _byte_ids[path] = ByteIds(path)
    return _byte_ids[path]
