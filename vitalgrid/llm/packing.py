"""Packing (operator 4): documents into token windows, by non-negative least squares over length combinations."""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import KEPT, Texts, batched, begin_task, materialise, steps, texts_of
from .tokens import byte_symbols, simple_pre_tokens

#: Tokens of a grain: lengths are counted in grains, and documents are cut only where one ends.
GRAIN = 16
#: Pieces that one task ranks or packs greedily, about.
PART_PIECES = 2_000
#: Bytes from which a single text is tokenized in parts.
LONG_TEXT = 1 << 22


class Merges:
    """Byte-pair merges of many words side by side: in each word the best-ranked pair next, until none is left."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix, pairs = model["vocab"], model["end_of_word_suffix"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        symbols = byte_symbols()
        self.inner = np.array([vocab[x] for x in symbols], np.int64)
        self.final = np.array([vocab[x + suffix] for x in symbols], np.int64)
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = np.int32(len(pairs))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def ids(self, low: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens (bytes of ``low`` from ``starts``), all in turn, and how many each has."""
        owner = np.repeat(np.arange(len(starts)), size)
        at = np.repeat(starts - np.cumsum(size) + size, size) + np.arange(len(owner))
        token = self.inner[low[at]]
        last = np.cumsum(size) - 1
        token[last] = self.final[low[at[last]]]
        rank = np.full(len(token), self.none)
        inside = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else last
        rank[inside] = self.rank(token[inside], token[inside + 1])
        done = []
        while len(token):
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            count = np.diff(np.append(begin, len(owner)))
            best = np.repeat(np.minimum.reduceat(rank, begin), count)
            if (over := best == self.none).any():
                done.append((owner[over], token[over]))
                go = ~over
                token, owner, rank, best = token[go], owner[go], rank[go], best[go]
            p = np.flatnonzero(rank == best)
            if not len(p):
                continue
            # of overlapping equal pairs the first, third and so on: the number in its run is even
            run = np.flatnonzero(np.append(True, np.diff(p) != 1))
            p = p[(np.arange(len(p)) - np.repeat(run, np.diff(np.append(run, len(p))))) % 2 == 0]
            token[p] = self.made[rank[p]]
            stay = np.ones(len(token), bool)
            stay[p + 1] = False
            p = p - np.arange(len(p))  # one symbol less for each merge before
            token, owner, rank = token[stay], owner[stay], rank[stay]
            near = np.concatenate([p, p[p > 0] - 1])
            rank[near] = self.none
            near = near[near + 1 < len(token)]
            near = near[owner[near] == owner[near + 1]]
            rank[near] = self.rank(token[near], token[near + 1])
        if not done:
            return np.empty(0, np.int64), np.zeros(len(starts), np.int64)
        owner, token = (np.concatenate(x) for x in zip(*done))
        return token[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(starts))


class WordIds:
    """Ids of texts, where each distinct word is encoded once while the table lasts.

    White space of U+0009 to U+000D and U+0020 ends every pre-token and belongs to none, so a text's ids are those of
    its words in turn. Words are known by their 64-bit hash, in a table of fixed size that starts anew when half full.
    New words of ASCII and the letters of U+00C0 to U+00FF are merged side by side, others go to the tokenizer library.
    """

    SLOTS, CHUNK = 1 << 20, 1 << 15

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.merges = Tokenizer.from_file(path), Merges(path)
        self.renew()

    def renew(self) -> None:
        self.keys, self.place = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32)
        self.begin, self.size, self.ids = np.zeros(self.SLOTS // 2, np.int32), np.zeros(self.SLOTS // 2, np.int32), np.zeros(1 << 18, np.int32)
        self.words = self.used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where it is new: linear probing, all words side by side."""
        mask = np.uint64(self.SLOTS - 1)
        out, left, slot = np.full(len(h), -1, np.int32), np.arange(len(h)), h & mask
        while len(left):
            have = self.keys[slot]
            hit = have == h[left]
            out[left[hit]] = self.place[slot[hit]]
            on = ~hit & (have != 0)
            left, slot = left[on], (slot[on] + np.uint64(1)) & mask
        return out

    def _add(self, h: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New words by hash, with all their ids in turn."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        new = np.arange(self.words, self.words + len(h))
        self.begin[new], self.size[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.words, self.used = self.words + len(h), self.used + len(ids)
        mask, slot = np.uint64(self.SLOTS - 1), h & np.uint64(self.SLOTS - 1)
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.place[slot[put]] = h[put], new[put]
            left = np.ones(len(h), bool)
            left[put] = False
            h, new, slot = h[left], new[left], (slot[left] + np.uint64(1)) & mask

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words in turn, and how many each has."""
        raw = b" ".join(words)
        t = Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        low, starts, size, word, odd = simple_pre_tokens(t)
        ids, n = self.merges.ids(low, starts, size)
        sizes = np.bincount(word, n, len(words)).astype(np.int64)
        if not odd.any():
            return ids, sizes
        at = np.flatnonzero(odd).tolist()
        others = [x.ids for x in self.library.encode_batch_fast([words[i].decode() for i in at], add_special_tokens=False)]
        sizes[at] = list(map(len, others))
        out, of_odd = np.empty(sizes.sum(), np.int64), np.repeat(odd, sizes)
        out[~of_odd], out[of_odd] = ids, np.concatenate(others)
        return out, sizes

    def of_words(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and how many each word has."""
        h = np.maximum(t.word_hash(), np.uint64(1))
        out, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for a in range(0, len(h), self.CHUNK):
            part = h[a : a + self.CHUNK]
            at = self._find(part)
            if (at < 0).any():
                if self.words + self.CHUNK > self.SLOTS // 2:
                    self.renew()
                    at = np.full(len(part), -1)
                new, first = np.unique(part[at < 0], return_index=True)
                where = a + np.flatnonzero(at < 0)[first]
                self._add(new, *self.encode([t.buf[x:y].tobytes() for x, y in zip(t.starts[where].tolist(), t.ends[where].tolist())]))
                at = self._find(part)
            n = self.size[at]
            rows = np.repeat(self.begin[at] - np.cumsum(n) + n, n)
            rows += np.arange(len(rows))
            out.append(self.ids[rows])
            sizes.append(n)
        return np.concatenate(out), np.concatenate(sizes)

    def of_texts(self, column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first row, the ids of each text from there); a very long text is read part by part, cut at white space."""
        for row, t in steps(column, most=1 << 18):
            if t.n == 1 and len(t.buf) > LONG_TEXT:
                at, ids = 0, []
                while at < len(t.buf):
                    # the end of the last word that ends within the bound, or of the one that runs over it
                    k = max(int(np.searchsorted(t.ends, at + LONG_TEXT, "right")) - 1, int(np.searchsorted(t.starts, at)))
                    to = int(t.ends[k]) if k < len(t.ends) else len(t.buf)
                    ids.append(self.of_words(Texts(t.buf[at:to], np.array([0, to - at])))[0])
                    at = to
                yield row, [np.concatenate(ids)]
            else:
                ids, n = self.of_words(t)
                yield row, np.split(ids, np.concatenate([[0], np.cumsum(n)])[t.first[1:-1]])


_word_ids: dict[str, WordIds] = {}
KEPT["packing"] = _word_ids.clear


def word_ids(path: str) -> WordIds:
    """One table for each worker process."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def shift_tables(n_bytes: int) -> np.ndarray:
    """4 x 256 tables of the CRC-32 of a message after ``n_bytes`` zero bytes were added, less the CRC of these."""
    zero = zlib.crc32(bytes(n_bytes))

    def shifted(crc: int) -> int:
        # crc32 is affine: feeding zeros from state crc, corrected by feeding them from nothing
        return zlib.crc32(bytes(n_bytes), crc) ^ zero

    return np.array([[shifted(b << (8 * k)) for b in range(256)] for k in range(4)], np.uint32)


def combine_crcs(blocks: list[np.ndarray], lengths: np.ndarray, grain: int = GRAIN) -> np.ndarray:
    """CRC-32 of whole pieces from the CRCs of their grains (4 bytes an id); ``lengths`` in ids."""
    full, out = shift_tables(4 * grain), np.zeros(len(blocks), np.uint32)
    n = np.array([len(b) for b in blocks])
    tail = lengths - (n - 1) * grain
    wide = np.zeros((len(blocks), n.max() if len(n) else 0), np.uint32)
    for i, b in enumerate(blocks):
        wide[i, : len(b)] = b
    turn = lambda t, c: t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]
    for j in range(wide.shape[1]):
        inner = np.flatnonzero(j < n - 1)
        out[inner] = turn(full, out[inner]) ^ wide[inner, j]
    for k in np.unique(tail) if len(n) else ():
        at = np.flatnonzero(tail == k)
        out[at] = turn(shift_tables(4 * int(k)), out[at]) ^ wide[at, n[at] - 1]
    return out.astype(np.int64)


def patterns(grains: int) -> list[dict[int, int]]:
    """Shallow combinations that fill a window: one or two lengths repeated, or three different ones."""
    found = {}
    for a in range(1, grains + 1):
        for i in range(1, grains // a + 1):
            rest = grains - a * i
            if rest == 0:
                found[((a, i),)] = None
            for j in range(1, rest + 1):
                if rest % j == 0 and (b := rest // j) < a:
                    found[((a, i), (b, j))] = None
    for a in range(3, grains):
        for b in range(2, a):
            if 0 < (c := grains - a - b) < b:
                found[((a, 1), (b, 1), (c, 1))] = None
    return [dict(x) for x in found]


def solve_repeats(histogram: np.ndarray, window_grains: int, rounds: int = 400) -> list[tuple[dict[int, int], int]]:
    """(combination, how often) so that lengths are used about as often as the histogram has them.

    Non-negative least squares of relative counts by accelerated projected gradients, then rounding;
    a combination is never taken more often than the lengths left allow. ``histogram[g]`` counts the
    pieces of g grains, whole windows included.
    """
    have = histogram.astype(np.int64).copy()
    out = [({window_grains: 1}, int(have[window_grains]))] if have[window_grains] else []
    have[window_grains] = 0
    some = set(np.flatnonzero(have).tolist())
    combos = [p for p in patterns(window_grains) if p.keys() <= some]
    if not combos:
        return out
    # Three entries a column at most, so the matrix is kept as lengths and their weighted counts.
    at = np.array([(*p, 0, 0)[:3] for p in combos])
    many = np.array([(*p.values(), 0, 0)[:3] for p in combos], float)
    weight = 1 / np.sqrt(have + 1.0)  # rare lengths count as much as frequent ones
    many *= weight[at]
    norm = np.sqrt((many * many).sum(1))
    many /= norm[:, None]
    target = have * weight
    lengths_of = lambda x: np.bincount(at.ravel(), (many * x[:, None]).ravel(), window_grains + 1)
    combos_of = lambda r: (many * r[at]).sum(1)
    v = np.ones(len(combos))
    for _ in range(30):  # largest eigenvalue, for the step
        v = combos_of(lengths_of(v))
        size = np.linalg.norm(v)
        v /= size
    x, y, t = np.zeros(len(combos)), np.zeros(len(combos)), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - combos_of(lengths_of(y) - target) / (1.05 * size))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    x = x / norm
    for k in np.argsort(-x, kind="stable").tolist():
        n = min(int(np.rint(x[k])), *(int(have[g]) // m for g, m in combos[k].items())) if x[k] >= 0.5 else 0
        if n > 0:
            out.append((combos[k], n))
            for g, m in combos[k].items():
                have[g] -= n * m
    return out


def greedy(lengths: list[int], window: int, grain: int = GRAIN) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset): the longest that fits, and a cut where much room is left."""
    left = sorted((n, i) for i, n in enumerate(lengths))
    begin = [0] * len(lengths)
    out, sequence, used = [], 0, 0
    while left:
        room = window - used
        at = bisect.bisect_right(left, (room, len(lengths))) - 1
        if at >= 0:
            n, i = left.pop(at)
            out.append((i, begin[i], n, sequence, used))
            used += n
        elif room >= 4 * grain:
            n, i = left.pop()
            take = room // grain * grain
            out.append((i, begin[i], take, sequence, used))
            begin[i] += take
            bisect.insort(left, (n - take, i))
            used += take
        else:
            sequence, used = sequence + 1, 0
        if used == window:
            sequence, used = sequence + 1, 0
    return out


def pack_documents(docs: DataFrame, window: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset for each piece. A
    document is its ids and then ``end_id``; null and empty texts have that id alone. Whole windows
    are cut off long documents. For the rest a histogram of lengths, of fixed size, is collected; combinations
    of lengths that fill a window get repeat counts by non-negative least squares, and pieces take the
    slots of their length in any order. What is left over is packed greedily, in parts, with cuts.
    Every row is packed for itself, so repeated rows and null ids give pieces each; other columns are ignored.
    """
    path = public_tokenizers.path(tokenizer)
    grains = window // GRAIN
    if grains * GRAIN != window:
        raise ValueError(f"window must be a multiple of {GRAIN}")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        begin_task("packing")
        machine = word_ids(path)
        for batch in batches:
            doc = batch.column(batch.schema.get_field_index("doc_id"))
            for row, texts in machine.of_texts(texts_of(batch)):
                rows, start, length, total, crcs = [], [], [], [], []
                for i, ids in enumerate(texts, row):
                    raw = np.append(ids, end_id).astype("<u4").tobytes()
                    n = len(raw) // 4
                    part = np.array([zlib.crc32(raw[k : k + 4 * GRAIN]) for k in range(0, len(raw), 4 * GRAIN)], np.uint32)
                    for s in range(0, n, window):
                        rows.append(i)
                        start.append(s)
                        length.append(min(window, n - s))
                        total.append(n)
                        crcs.append(part[s // GRAIN : s // GRAIN + grains].tobytes())
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(rows)), *(pa.array(x, pa.int64()) for x in (start, length, total)), pa.array(crcs, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "crcs"])

    pieces = batched(docs.select("doc_id", "text")).mapInArrow(cut, f"doc_id {kind}, start long, length long, doc_tokens long, crcs binary")
    pieces = materialise(pieces.withColumns({"rid": F.monotonically_increasing_id(), "grains": F.ceil(F.col("length") / GRAIN).cast("int")}))
    histogram = np.zeros(grains + 1, np.int64)
    for r in pieces.groupBy("grains").count().collect():
        histogram[r["grains"]] = r["count"]
    solved = solve_repeats(histogram, grains)

    # Ranks among pieces of a length: hashed parts are counted, then numbered for themselves.
    parts = max(1, int(histogram.sum()) // PART_PIECES)
    ranked = pieces.withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("grains").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranked.groupBy("grains", "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("grains", "part").orderBy("rid")))
    ranked = ranked.join(offsets, ["grains", "part"]).withColumn("rank", F.col("before") + F.col("nth") - 1)

    # Slots of a length: the first ranks go to the first combination that has it, and so on.
    slots: dict[int, tuple[list, list]] = {}
    base = 0
    for combo, n in solved:
        slot = 0
        for g, m in combo.items():
            lows, what = slots.setdefault(g, ([0], []))
            what.append((base, m, slot))
            lows.append(lows[-1] + n * m)
            slot += m
        base += n
    table = {g: (np.array(lows), np.array(what)) for g, (lows, what) in slots.items()}

    @F.pandas_udf("sequence long, slot int")
    def seat(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, slot = np.full(len(rank), -1), np.zeros(len(rank), np.int64)
        g, r = length.to_numpy(), rank.to_numpy()
        for value in np.unique(g):
            if value in table:
                lows, what = table[value]
                at = np.flatnonzero((g == value) & (r < lows[-1]))
                k = np.searchsorted(lows, r[at], "right") - 1
                nth = r[at] - lows[k]
                sequence[at] = what[k, 0] + nth // what[k, 1]
                slot[at] = what[k, 2] + nth % what[k, 1]
        return pd.DataFrame({"sequence": sequence, "slot": slot.astype(np.int32)})

    seated = materialise(ranked.withColumn("seat", seat("grains", "rank")).select("doc_id", "start", "length", "doc_tokens", "crcs", "rid", "seat.sequence", "seat.slot"))
    along = Window.partitionBy("sequence").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    fitted = seated.where("sequence >= 0").withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0)))
    columns = ["doc_id", "start", "length", "doc_tokens", "crcs", "sequence", "offset"]
    rest = seated.where("sequence < 0")
    rest_parts = max(1, rest.count() // PART_PIECES)

    def pack_rest(group: pa.Table) -> pa.Table:
        size = group.column("length").to_pylist()
        order = np.argsort(group.column("rid").to_numpy(), kind="stable").tolist()
        crcs, start = group.column("crcs").to_pylist(), group.column("start").to_pylist()
        got = greedy([size[i] for i in order], window)
        rows = [order[x[0]] for x in got]
        part = group.column("part")[0].as_py()
        return pa.table(
            [
                group.column("doc_id").take(pa.array(rows, pa.int64())), pa.array([start[i] + x[1] for i, x in zip(rows, got)], pa.int64()), pa.array([x[2] for x in got], pa.int64()),
                group.column("doc_tokens").take(pa.array(rows, pa.int64())), pa.array([crcs[i][4 * (x[1] // GRAIN) : 4 * -(-(x[1] + x[2]) // GRAIN)] for i, x in zip(rows, got)], pa.binary()),
                pa.array([base + (x[3] * rest_parts + part) for x in got], pa.int64()), pa.array([x[4] for x in got], pa.int64()),
            ], names=columns,
        )

    packed = rest.withColumn("part", F.pmod(F.xxhash64("rid", F.lit(5)), F.lit(rest_parts)).cast("int")).groupBy("part")
    packed = packed.applyInArrow(pack_rest, f"doc_id {kind}, start long, length long, doc_tokens long, crcs binary, sequence long, offset long")

    def finish(batches):
        for batch in batches:
            length = batch.column(2).to_numpy()
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                crc = combine_crcs([np.frombuffer(x, np.uint32) for x in b.column(4).to_pylist()], length[at : at + 2048])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc), b.column(3), b.column(5), b.column(6)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    both = fitted.select(*columns).union(packed.select(*columns))
    return both.mapInArrow(finish, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
