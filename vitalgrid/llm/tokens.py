"""Token counts (operator 5) by a finite-state compilation of a word-end BPE tokenizer.

The tokenizer file is compiled to two deterministic machines. The *lexer* reads characters
and marks where pre-tokens begin; white space takes every state of it back to the start.
The *merger* reads the bytes of one pre-token. Its state is what the next byte can still
change: the tokens that end at the latest positions. Each transition carries the change in
the number of emitted tokens, so a path's sum is the token count of what was read. Its
transitions are computed when first taken and then kept.

For a chunk of text, the state map says for each state before it the state after it and the
tokens between. As white space brings all states together, the map of a chunk is: the piece
before its first white space (read in whatever state the chunk begins), the count of the
closed part, and the open piece at the end. Such maps form a monoid, so the chunks of a text
compose by a parallel prefix scan; see ``ChunkMap``. Most runs between white space are simple
(ASCII and the letters of U+00C0 to U+00FF); ``Lanes`` reads the pre-tokens of a whole step of
such runs side by side through one transition table and adds them up by prefix sums.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import reduce
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import KEPT, LOWER, Texts, batched, steps, texts_of

#: Distinct words whose counts one task keeps; the table starts anew beyond it.
WORDS_KEPT = 200_000
#: States of the transducer that one task keeps.
STATES_KEPT = 120_000
#: Code points of a chunk, the unit that is mapped on its own.
CHUNK_CHARS = 1 << 16
#: str.split() takes these for white space, the tokenizer does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


class Merger:
    """The byte-level transducer of one pre-token.

    A state is a tuple of the last tokens of the best segmentation of each prefix that a later
    token can still reach back to; the tokenization of a prefix without word end is unique, as
    is the last token of it. A token may follow another only if merging the two texts in rank
    order gives these two tokens again.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.vocab = model["vocab"]
        self.parts: dict[str, tuple[str, str]] = {}
        for pair in self.rank:
            self.parts.setdefault(pair[0] + pair[1], pair)
        self.symbol = byte_symbols()
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.follows: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, tuple[str, ...]] = {}
        self.ending: dict[str, list[str]] = {}
        #: what some token begins with: a position counts only while the text from it on is among these
        self.begins = {v[:i] for v in self.vocab for i in range(1, len(v) + 1)}
        self.reset()

    def merged(self, text: str, end: bool = False) -> tuple[str, ...]:
        """Tokens by repeated merging of the best-ranked neighbours; the definition that the machine must meet."""
        parts = list(text)
        if end and parts:
            parts[-1] += self.suffix
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 40))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return tuple(parts)

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merging keeps ``left`` and ``right`` apart, when each is what its own bytes merge to.

        Undo the merges of both sides, latest first. If the two tokens at the border could have
        merged before the merge that was undone last, they would have, and the pair never arises.
        """
        key = (left, right)
        apart = self.follows.get(key)
        if apart is None:
            rank, parts, most = self.rank, self.parts, len(self.rank)
            while True:
                joint = rank.get((left, right))
                if joint is not None and joint < most:
                    apart = False
                    break
                a, b = parts.get(left), parts.get(right)
                if a is None and b is None:
                    apart = True
                    break
                if b is None or (a is not None and rank[a] > rank[b]):
                    most, left = rank[a], a[1]
                else:  # on a tie of ranks the pair on the left merges first
                    most, right = rank[b] + 1, b[0]
            self.follows[key] = apart
        return apart

    def is_token(self, text: str, end: bool) -> bool:
        """Whether merging makes one token of the text."""
        key = text + self.suffix if end else text
        if key not in self.whole:
            self.whole[key] = self.merged(text, end) if key in self.vocab or len(text) == 1 else ()
        return len(self.whole[key]) == 1

    def step(self, state: int, symbol: str, end: bool) -> tuple[int, int]:
        """Read one byte: the state after it, and by how much the number of tokens so far changes.

        At the end of a pre-token there is no state.

        A state is the text from the first position at which a token may still begin, and for
        each position the last token before it and the count there less the latest count;
        None where no token can begin. It is known by its number.
        """
        text, marks = self.states[state]
        text += symbol
        found = None
        for at in range(len(text) - 1, -1, -1):
            if marks[at] is None:
                continue
            body = text[at:]
            if not self.is_token(body, end):
                continue
            last, count = marks[at]
            right = body + self.suffix if end else body
            if not last or self.may_follow(last, right):
                found = (right, count + 1)
                break
        if found is None:  # cannot happen for a vocabulary with all bytes
            raise ValueError(f"no segmentation of {text!r}")
        delta = found[1]
        if end:
            return 0, delta
        same = self.marks.setdefault  # equal marks are one object
        marks = (*marks, (found[0], delta))
        marks = tuple(same(x := (m[0], m[1] - delta), x) if m is not None and (at == len(text) or text[at:] in self.begins) else None for at, m in enumerate(marks))
        first = next(at for at, m in enumerate(marks) if m is not None)
        known = (text[first:], marks[first:])
        after = self.numbers.get(known)
        if after is None:
            after = self.numbers[known] = len(self.states)
            self.states.append(known)
        return after, delta

    def reset(self) -> None:
        """The machine with its start state alone."""
        start = ("", (("", 0),))
        self.states, self.numbers = [start], {start: 0}
        #: what was read one by one: state and byte to (state, delta), and with an end to delta
        self.moves: dict[int, tuple[int, int]] = {}
        self.ends: dict[int, int] = {}
        self.marks: dict[tuple[str, int], tuple[str, int]] = {}
        self.follows.clear()

    def count(self, piece: bytes) -> int:
        """Tokens of one pre-token, by running the machine over its bytes."""
        state, total, moves = 0, 0, self.moves
        *inner, last = piece
        for b in inner:
            key = state << 8 | b
            got = moves.get(key)
            if got is None:
                got = moves[key] = self.step(state, self.symbol[b], False)
            state = got[0]
            total += got[1]
        key = state << 8 | last
        delta = self.ends.get(key)
        if delta is None:
            delta = self.ends[key] = self.step(state, self.symbol[last], True)[1]
        return total + delta


class ChunkMap(NamedTuple):
    """The state map of a chunk: ``head`` is read in the state before it; without a white space ``closed`` is None."""

    head: str
    closed: int | None
    tail: str


class WordCounts(dict):
    """Tokens of a run of characters without white space; kept for up to ``WORDS_KEPT`` runs."""

    def __init__(self, path: str):
        super().__init__()
        self.merger = Merger(path)
        import regex

        self.lexer = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{L}\p{N}]+")
        self.special = re.compile("|".join(map(re.escape, self.merger.specials)))

    def __missing__(self, run: str) -> int:
        # Runs of a chunk: no white space of any kind inside.
        if len(self) >= WORDS_KEPT:
            self.clear()
        if run[-1] in ",.!?;:" and run[:-1].isalpha() and "İ" not in run:  # letters and one sign are two pre-tokens
            return self[run[:-1]] + self[run[-1]]
        text = self.normal(run)
        if text.isascii() and text.isalpha():
            n = self.merger.count(text.encode())
        else:
            n = sum(self.merger.count(x.encode()) for x in self.lexer.findall(text))
        self[run] = n
        return n

    @staticmethod
    def normal(run: str) -> str:
        """Composed form, then each character in lower case by itself."""
        return run.lower() if run.isascii() else unicodedata.normalize("NFC", run).replace("Σ", "σ").lower()

    def chunk_map(self, chunk: str) -> ChunkMap:
        if not chunk:
            return ChunkMap("", None, "")
        runs = chunk.split() if not SEPARATORS.search(chunk) else [x for x in WHITE.split(chunk) if x]
        if not runs:
            return ChunkMap("", 0, "")
        starts, ends = chunk.startswith(runs[0]), chunk.endswith(runs[-1])
        if len(runs) == 1 and starts and ends:
            return ChunkMap(chunk, None, "")
        head = runs.pop(0) if starts else ""
        tail = runs.pop() if ends else ""
        return ChunkMap(head, sum(map(self.__getitem__, runs)), tail)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First ``a``, then ``b``; associative."""
        if a.closed is None:
            return ChunkMap(a.head + b.head, b.closed, b.tail)
        if b.closed is None:
            return ChunkMap(a.head, a.closed, a.tail + b.head)
        joint = a.tail + b.head
        return ChunkMap(a.head, a.closed + (self[joint] if joint else 0) + b.closed, b.tail)

    def applied(self, m: ChunkMap) -> int:
        """The count if the chunk is a whole text."""
        return (self[m.head] if m.head else 0) + (m.closed or 0) + (self[m.tail] if m.tail else 0)

    def plain(self, text: str) -> int:
        chunks = (text[i : i + CHUNK_CHARS] for i in range(0, len(text), CHUNK_CHARS))
        return self.applied(reduce(self.compose, map(self.chunk_map, chunks), ChunkMap("", None, "")))

    def run(self, run: str) -> int:
        """Tokens of a run without ASCII white space."""
        if run not in self:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[run] = self.count(run)
        return self[run]

    def count(self, text: str) -> int:
        """Tokens of a whole text; each special string is one token and parts what stands around it."""
        if "<|" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


#: Kinds of bytes in simple words.
LETTER, DIGIT, SIGN, OTHER = 1, 2, 3, 0
#: Longer pre-tokens are read one by one.
LONGEST = 64
_KIND = np.full(256, SIGN, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = LETTER
_KIND[48:58] = DIGIT


def simple_pre_tokens(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, starts, sizes and words of the pre-tokens in simple words, and which words are not simple."""
    buf, n = t.buf, len(t.buf)
    low = LOWER[buf]
    ahead = np.append(buf[1:], 32)
    wide = buf >= 0x80
    odd = buf == 0x27
    odd |= (buf == 0x3C) & (ahead == 0x7C)
    odd |= ((buf < 0x20) | (buf == 0x7F)) & ~t.space
    if wide.any():
        lead = buf == 0xC3
        trail = np.append(False, lead[:-1])
        odd |= wide & ~lead & ~trail
        odd |= trail & ((buf == 0x97) | (buf == 0xB7))
        low = low + (np.uint8(0x20) * (trail & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)))
    sums = np.zeros(n + 1, np.int32)
    np.cumsum(odd, out=sums[1:])
    slow = sums[t.ends] > sums[t.starts]
    kind = _KIND[low]
    kind[t.space] = OTHER
    border = np.append(True, kind[1:] != kind[:-1])
    border |= kind == DIGIT
    border[t.starts] = True
    border &= ~t.space
    starts = np.flatnonzero(border)
    word = np.searchsorted(t.starts, starts, "right") - 1
    stops = np.minimum(np.append(starts[1:], n), t.ends[word])
    size = stops - starts
    slow[word[size > LONGEST]] = True
    fast = ~slow[word]
    return low, starts[fast], size[fast], word[fast], slow


class Lanes:
    """Runs the merger over many pre-tokens at once: one gather a byte position."""

    #: Bytes that simple runs can have once in lower case, by number; two-byte letters are C3 and 9F to BF.
    SYMBOLS = np.array([b for b in range(33, 256) if (b < 127 and not 65 <= b <= 90) or b == 0xC3 or 0x9F <= b < 0xC0])
    #: Longer texts are read chunk by chunk.
    TEXT_BYTES = 1 << 22

    def __init__(self, path: str):
        self.counts = WordCounts(path)
        self.merger = self.counts.merger
        self.number = np.zeros(256, np.int64)
        self.number[self.SYMBOLS] = np.arange(len(self.SYMBOLS))
        self.width = len(self.SYMBOLS)
        self.renew()

    def renew(self) -> None:
        self.merger.reset()
        self.rows = 0
        self.next = np.empty(0, np.int32)
        self.delta = np.empty(0, np.int8)
        self.end = np.empty(0, np.int8)
        self.grow()

    def grow(self) -> None:
        """Room for the states that the merger has by now."""
        if len(self.merger.states) <= self.rows:
            return
        rows = max(self.rows + 16_384, len(self.merger.states))
        more = (rows - self.rows) * self.width
        self.next = np.concatenate([self.next, np.full(more, -1, np.int32)])
        self.delta = np.concatenate([self.delta, np.zeros(more, np.int8)])
        self.end = np.concatenate([self.end, np.full(more, -128, np.int8)])
        self.rows = rows

    def _learn(self, at: np.ndarray, end: bool) -> None:
        for u in np.unique(at).tolist():
            state, symbol = divmod(u, self.width)
            after, delta = self.merger.step(state, self.merger.symbol[self.SYMBOLS[symbol]], end)
            self.grow()
            if end:
                self.end[u] = delta
            else:
                self.next[u], self.delta[u] = after, delta

    def run(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token; ``symbols`` are numbers of bytes."""
        order = np.argsort(-lengths.astype(np.int16), kind="stable")
        at, size = starts[order], lengths[order]
        longer = np.searchsorted(-size, -np.arange(1, LONGEST + 2), "right")  # how many have that length or more
        total, state = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for j in range(int(size[0]) if len(size) else 0):
            go, stop = longer[j + 1], longer[j]  # lanes below go read on, those from go to stop end here
            key = state[:stop] * self.width + symbols[at[:stop] + j]
            ends = self.end[key[go:]]
            if (missing := ends == -128).any():
                self._learn(key[go:][missing], True)
                ends = self.end[key[go:]]
            total[go:stop] += ends
            key = key[:go]
            after = self.next[key]
            if (missing := after < 0).any():
                self._learn(key[missing], False)
                after = self.next[key]
            total[:go] += self.delta[key]
            state[:go] = after
        out = np.empty(len(at), np.int64)
        out[order] = total
        return out

    def _fresh(self) -> None:
        if len(self.merger.states) > STATES_KEPT:
            self.renew()

    def count(self, t: Texts) -> np.ndarray:
        """Tokens of each text."""
        self._fresh()
        if not len(t.starts):
            return np.zeros(t.n, np.int64)
        if len(t.buf) > self.TEXT_BYTES:  # steps hold one such text alone
            return np.array([self.counts.count(t.text(i).decode()) for i in range(t.n)])
        low, starts, size, word, slow = simple_pre_tokens(t)
        got = np.bincount(word, self.run(self.number[low], starts, size), len(t.starts)).astype(np.int64)
        raw = t.buf.tobytes()
        for i in np.flatnonzero(slow).tolist():
            got[i] = self.counts.run(raw[t.starts[i] : t.ends[i]].decode())
        return np.diff(np.concatenate([[0], np.cumsum(got)])[t.first])


_lanes: dict[str, Lanes] = {}
KEPT["tokens"] = _lanes.clear


def lanes(path: str) -> Lanes:
    """One machine for each worker process."""
    if path not in _lanes:
        _lanes[path] = Lanes(path)
    return _lanes[path]


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit``) of every whole text.

    Null and empty texts have no bytes and no tokens. Rows are independent: repeated rows and
    null ids give a row each, other columns are ignored, and no row is moved. Texts of any
    length are read, very long ones chunk by chunk.
    """
    path = public_tokenizers.path(tokenizer)

    def run(batches):
        machine = lanes(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for row, t in steps(texts_of(batch)):
                n = machine.count(t)
                yield pa.RecordBatch.from_arrays([ids.slice(row, t.n), pa.array(np.diff(t.offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return batched(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
