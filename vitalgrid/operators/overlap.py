"""Overlap of texts: word and n-gram bags, longest common subsequences, corpus BLEU.

Both sides stand in one row, so nothing is shuffled: words become whole numbers in one go for a whole batch, runs of
words numbers of pairs of numbers, and bags are compared after one sort.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cache, wraps
from itertools import chain, count, pairwise
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from ..functions.stems import TOKENS, stem
from ..functions.text import ASCII_PUNCTUATION
from ..session import small_batches


#: Rows that a step of a batch takes, so that what it makes of their words stays small.
STEP_ROWS = 128


def _by_steps(f: Callable) -> Callable:
    """A function of arrays that works on some rows at a time."""

    @wraps(f)
    def run(*columns: pa.Array):
        parts = [f(*(c.slice(at, STEP_ROWS) for c in columns)) for at in range(0, max(len(columns[0]), 1), STEP_ROWS)]
        return np.concatenate(parts)

    return run


def _numbered(*lists: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each array of lists of words: the words' numbers (equal words, equal numbers in all of them) and their rows."""
    flat = [x.flatten() for x in lists]
    words = pa.concat_arrays([f.cast(pa.large_string()) for f in flat]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = [np.repeat(np.arange(len(x)), np.array([n or 0 for n in x.value_lengths().to_pylist()], np.int64)) for x in lists]
    return list(zip(np.split(words, np.cumsum([len(f) for f in flat])[:-1]), rows))


def _runs(sides: list[tuple[np.ndarray, np.ndarray]], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the runs of ``n`` words of each row, and their rows."""
    out = sides
    for k in range(1, n):
        joined, rows = [], []
        for (first, row), (word, whole) in zip(out, sides):
            # the run of k words at a place goes on with the word k places on, if that is in the row
            size = np.bincount(whole, minlength=int(whole[-1]) + 1 if len(whole) else 0)
            begin = np.cumsum(size) - size
            runs = np.cumsum(np.maximum(size - (k - 1), 0)) - np.maximum(size - (k - 1), 0)
            nth = np.arange(len(first)) - runs[row] if len(row) else row
            on = nth + k < size[row] if len(row) else np.zeros(0, bool)
            joined.append(np.stack([first[on], word[begin[row[on]] + nth[on] + k]]))
            rows.append(row[on])
        pairs = np.concatenate(joined, axis=1)
        _, numbers = np.unique(pairs[0] * (pairs[1].max(initial=0) + 1) + pairs[1], return_inverse=True)
        out = list(zip(np.split(numbers.ravel(), np.cumsum([j.shape[1] for j in joined])[:-1]), rows))
    return out


def _row_runs(sides: list[tuple[np.ndarray, np.ndarray]], most: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """``_runs`` of one to ``most`` words, numbered from 0 on for each row apart: no two rows have a number in common."""

    def numbered(keys: list[np.ndarray]) -> list[np.ndarray]:
        found = pa.array(np.concatenate(keys)).dictionary_encode().indices.to_numpy().astype(np.int64)
        return np.split(found, np.cumsum([len(k) for k in keys])[:-1])

    width = max(w.max(initial=0) for w, _ in sides) + 1
    words = numbered([row * width + w for w, row in sides])
    yield [(w, row) for w, (_, row) in zip(words, sides)]
    width, runs = max(w.max(initial=0) for w in words) + 1, words
    for k in range(1, most):
        on = [row[k:] == row[: max(len(row) - k, 0)] for _, row in sides]
        found = numbered([run[: len(o)][o] * width + w[k:][o] for run, w, o in zip(runs, words, on)])
        runs = [np.zeros(len(o), np.int64) for o in on]
        for run, f, o in zip(runs, found, on):
            run[o] = f
        yield [(f, row[: len(o)][o]) for f, (_, row), o in zip(found, sides, on)]


def common_runs(a: pa.Array, b: pa.Array, n: int = 1) -> np.ndarray:
    """For each row how many runs of ``n`` words of one list are matched one to one by equal runs of the other; nulls have none."""
    return _matched(_numbered(a, b), n, len(a))


def _matched(sides: list[tuple[np.ndarray, np.ndarray]], n: int, rows: int) -> np.ndarray:
    (x, row_x), (y, row_y) = _runs(sides, n)
    width = max(x.max(initial=0), y.max(initial=0)) + 1
    kx, nx = np.unique(row_x * width + x, return_counts=True)
    ky, ny = np.unique(row_y * width + y, return_counts=True)
    both, i, j = np.intersect1d(kx, ky, assume_unique=True, return_indices=True)
    return np.bincount(both // width, np.minimum(nx[i], ny[j]), rows).astype(np.int64)


def _clip(runs: list[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
    """``common_runs`` of two of the sides of ``_row_runs``."""
    (x, row), (y, _) = runs
    many = max(x.max(initial=-1), y.max(initial=-1)) + 1
    owner = np.zeros(many, np.int64)
    owner[x] = row
    return np.bincount(owner, np.minimum(np.bincount(x, minlength=many), np.bincount(y, minlength=many)), rows).astype(np.int64)


def _characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of strings and their rows; nulls have none."""
    texts = [(x or "").encode("utf-32-le") for x in column.to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint32).astype(np.int64), np.repeat(np.arange(len(texts)), [len(t) // 4 for t in texts])


@F.arrow_udf(DoubleType())
def character_bleu(candidate: pa.Array, reference: pa.Array) -> pa.Array:
    """BLEU-4 by characters: geometric mean of n-gram precisions, from two characters on smoothed by one, with the brevity penalty; 0 without a character in common."""
    return pa.array(_character_bleu(candidate, reference))


@_by_steps
def _character_bleu(candidate: pa.Array, reference: pa.Array) -> np.ndarray:
    n, sides = len(candidate), [_characters(candidate), _characters(reference)]
    size, other = (np.bincount(row, minlength=n) for _, row in sides)
    logs, none = np.zeros(n), np.zeros(n, bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(1, 5):
            hit, total = _matched(sides, k, n), np.maximum(size - (k - 1), 0)
            none |= hit == 0 if k == 1 else False
            logs += np.log((hit + (k > 1)) / (total + (k > 1)))
        score = np.exp(logs / 4 + np.minimum(0.0, 1 - other / size))
    return np.where(none, 0.0, score)


@F.arrow_udf(DoubleType())
def sari(source: pa.Array, candidate: pa.Array, reference: pa.Array) -> pa.Array:
    """Mean over n up to 4 of the F1 of kept and of added n-grams of words and the precision of deleted ones; ratios of nothing are 1."""
    return pa.array(_sari(source, candidate, reference))


@_by_steps
def _sari(source: pa.Array, candidate: pa.Array, reference: pa.Array) -> np.ndarray:
    return _sari_of(_row_runs(_numbered(source, candidate, reference), 4), len(source))


def _sari_of(all_runs: Iterable[list[tuple[np.ndarray, np.ndarray]]], rows: int) -> np.ndarray:
    total = np.zeros(rows)
    for runs in all_runs:
        many = max(x.max(initial=-1) for x, _ in runs) + 1
        owner, (s, c, r) = np.zeros(many, np.int64), np.zeros((3, many), bool)
        for has, (x, row) in zip((s, c, r), runs):
            owner[x], has[x] = row, True
        count = lambda has: np.bincount(owner[has], minlength=rows)  # noqa: E731, B023
        ratio = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 1.0)
        part = np.zeros(rows)
        for got, want in ((c & s, r & s), (c & ~s, r & ~s)):
            hit = count(got & want)
            p, q = ratio(hit, count(got)), ratio(hit, count(want))
            part += np.where(p + q > 0, 2 * p * q / np.where(p + q > 0, p + q, 1), 0.0)
        gone = s & ~c
        total += (part + ratio(count(gone & ~r), count(gone))) / 3
    return total / 4


@cache
def _common(n: int) -> Callable:
    @F.arrow_udf(LongType())
    def common(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(_by_steps(lambda x, y: common_runs(x, y, n))(a, b))

    return common


def overlap_scores(common: Column, size_a: Column, size_b: Column) -> list[Column]:
    """F1, precision (of a) and recall (of b); 0 without anything in common."""
    some = common > 0
    zero = F.lit(0.0)
    return [F.when(some, 2 * common / (size_a + size_b)).otherwise(zero).alias("f1"), F.when(some, common / size_a).otherwise(zero).alias("precision"), F.when(some, common / size_b).otherwise(zero).alias("recall")]


def run_scores(rows: DataFrame, key: str, a: str, b: str, n: int = 1) -> DataFrame:
    """(key, f1, precision, recall) of two word arrays as bags of runs of ``n`` words; 0 where nothing is in common."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)) - (n - 1), F.lit(0))
    counted = small_batches(rows).select(key, size(a).alias("_a"), size(b).alias("_b"), _common(n)(a, b).alias("_c"))
    return counted.select(key, *overlap_scores(F.col("_c"), F.col("_a"), F.col("_b")))


def rouge_runs(rows: DataFrame, key: str, a: str, b: str, most: int = 2) -> DataFrame:
    """(key, rouge1, rouge2, ...): F1 of runs of one to ``most`` words of two word arrays, in one pass."""
    size = lambda c, n: F.greatest(F.coalesce(F.size(c), F.lit(0)) - (n - 1), F.lit(0))
    grams = range(1, most + 1)
    counted = small_batches(rows).select(key, _clipped(most)(a, b).alias("_c"), *(size(c, n).alias(f"_{x}{n}") for n in grams for x, c in (("a", a), ("b", b))))
    return counted.select(key, *(overlap_scores(F.col("_c")[n - 1], F.col(f"_a{n}"), F.col(f"_b{n}"))[0].alias(f"rouge{n}") for n in grams))


def increments(symbols: dict[int, int], words: np.ndarray, state: int, mask: int) -> list[int]:
    """For each of ``words`` the bits at which the longest common subsequence with the other text's prefix grows by one.

    ``symbols`` has for each word number the bits of its places in the other text. A bit outside ``mask`` parts texts
    that are read side by side: what carries over from one stops there.
    """
    out = []
    for w in words.tolist():
        u = state & symbols.get(w, 0)
        state = ((state + u) | (state - u)) & mask
        out.append(mask ^ state)
    return out


def common_places(r: np.ndarray, c: np.ndarray) -> list[int]:
    """Places in ``r`` of one longest common subsequence with ``c``, taken from the ends; on a tie a word of ``r`` is left out before one of ``c``."""
    symbols: dict[int, int] = {}
    for i, w in enumerate(r.tolist()):
        symbols[w] = symbols.get(w, 0) | 1 << i
    mask, step = (1 << len(r)) - 1, len(c) if len(r) * len(c) < 1 << 20 else isqrt(len(c)) + 1
    # columns at every ``step`` words are kept, those between are made again when the way back reaches them
    starts, state = [mask], mask
    for k in range(step, len(c), step or 1):
        state = mask ^ increments(symbols, c[k - step : k], state, mask)[-1]
        starts.append(state)
    i, j, out, block, columns = len(r), len(c), [], -1, []
    while i and j:
        if r[i - 1] == c[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
            continue
        if (j - 1) // step != block:
            block = (j - 1) // step
            columns = increments(symbols, c[block * step : (block + 1) * step], starts[block], mask)
        if columns[(j - 1) % step] >> (i - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence."""
    symbols: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        symbols[w] = symbols.get(w, 0) | 1 << i
    mask = (1 << len(a)) - 1
    return increments(symbols, b, mask, mask)[-1].bit_count() if len(a) and len(b) else 0


def summary_hits(gold: list[np.ndarray], given: list[np.ndarray]) -> int:
    """Words of the gold sentences that the union of their common subsequences with all given sentences holds, each word as often as both texts have it."""
    return _hits(*([tuple(x.tolist()) for x in side] for side in (gold, given)))


def _hits(golds: list[tuple[int, ...]], givens: list[tuple[int, ...]]) -> int:
    """``summary_hits``; gold words that no given sentence has may be left out."""
    sides = [Counter(w for x in side for w in x) for side in (golds, givens)]
    # A gold sentence that is also given is whole; of the others only words that are given count, and equal pairs of sentences are compared once.
    kinds, whole = set(givens), {}
    for r in set(golds):
        whole[r] = {i for i, w in enumerate(r) if w in sides[1]} if r in kinds else set()
    left = [r for r in whole if r not in kinds]
    shared = {r: [i for i, w in enumerate(r) if w in sides[1]] for r in left}
    # These are read side by side against a given one: a free bit parts them.
    symbols: dict[int, int] = {}
    at, mask, places = 0, 0, []
    for r in left:
        for i in shared[r]:
            symbols[r[i]] = symbols.get(r[i], 0) | 1 << at
            mask |= 1 << at
            at += 1
        places.append(at - len(shared[r]))
        at += 1
    for c in kinds if mask else ():
        own = {w: symbols[w] for w in set(c) if w in symbols}
        if not own:
            continue
        found = increments(own, np.array([w for w in c if w in own]), mask, mask)[-1]
        for k, r in zip(places, left):
            n = len(shared[r])
            if len(whole[r]) < n and (bits := found >> k & ((1 << n) - 1)):
                here = [i for i in shared[r] if r[i] in own]  # a word of gold that the other has not is left out anyhow
                if bits.bit_count() == len(here):
                    whole[r].update(here)
                elif bits.bit_count() == 1:  # ``common_places`` ends at the last word of c, or else at the first of r
                    whole[r].add(next((i for i in reversed(here) if r[i] == c[-1]), here[0]))
                else:
                    whole[r].update(here[i] for i in common_places(np.array([r[i] for i in here]), np.array(c)))
    hits = 0
    for r in golds:
        for i in sorted(whole[r]):
            w = r[i]
            if sides[0][w] > 0 and sides[1][w] > 0:
                hits += 1
                sides[0][w] -= 1
                sides[1][w] -= 1
    return hits


def _sentences(column: pa.Array, other: pa.Array) -> list[list[list[np.ndarray]]]:
    """For each of two arrays of texts (lists of sentences, these of words) the sentences as word numbers, row by row."""
    flat = [x.flatten() for x in (column, other)]
    numbered = _numbered(*flat)
    out = []
    for texts, sentences, (words, _) in zip((column, other), flat, numbered):
        size = np.array([n or 0 for n in sentences.value_lengths().to_pylist()], np.int64)
        parts = np.split(words, np.cumsum(size)[:-1]) if len(size) else []
        many = np.array([n or 0 for n in texts.value_lengths().to_pylist()], np.int64)
        ends = np.cumsum(many)
        out.append([parts[e - m : e] for m, e in zip(many.tolist(), ends.tolist())])
    return out


@F.arrow_udf(LongType())
def summary_common(gold: pa.Array, given: pa.Array) -> pa.Array:
    """``summary_hits`` of two arrays of sentences, each an array of words."""
    return pa.array(_by_steps(lambda x, y: np.array([summary_hits(a, b) for a, b in zip(*_sentences(x, y))], np.int64))(gold, given))


@F.arrow_udf(LongType())
def subsequence(a: pa.Array, b: pa.Array) -> pa.Array:
    """The length of the longest common subsequence of two word arrays; nulls have no words."""
    n = len(a)
    sides = [np.split(w, np.searchsorted(row, np.arange(1, n))) for w, row in _numbered(a, b)]
    return pa.array([common_length(x, y) for x, y in zip(*sides)] if n else [], pa.int64())


class _Stems(dict):
    """Numbers of the stems of the words that a worker has seen, -1 for the end of a sentence; each word is stemmed once."""

    def __init__(self, most: int = 1 << 20):
        self.numbers, self.most = {}, most
        self.update(dict.fromkeys((b"\n", b".", b"!", b"?"), -1))

    def __missing__(self, word: bytes) -> int:
        number = self.numbers.setdefault(stem(word.decode()), len(self.numbers))
        if len(self) < self.most:
            self[word] = number
        return number

    def bounded(self) -> _Stems:
        """These, or new ones where there are too many; numbers are compared within a text only."""
        return self if len(self.numbers) < self.most else _Stems(self.most)


_stems = _Stems()


def _cut(tokens: np.ndarray) -> list[tuple[int, ...]]:
    """The sentences that have words."""
    out, ends = tokens.tolist(), np.flatnonzero(tokens < 0).tolist()
    return [tuple(out[a + 1 : b]) for a, b in pairwise([-1, *ends, len(out)]) if b > a + 1]


def _summary_rouge(given: list[bytes], gold: list[bytes]) -> np.ndarray:
    """ROUGE-1, ROUGE-2 and the summary-level one of texts in lower case, as UTF-8."""
    global _stems
    _stems = _stems.bounded()
    texts = [[np.array(list(map(_stems.__getitem__, TOKENS.findall(x))), np.int64) for x in side] for side in (given, gold)]
    words = [[t[t >= 0] for t in side] for side in texts]
    n, sides = len(given), [(np.concatenate(side) if side else np.zeros(0, np.int64), np.repeat(np.arange(len(side)), [len(w) for w in side])) for side in words]
    hits = [_clip(runs, n) for runs in _row_runs(sides, 2)]
    known = np.zeros(len(_stems.numbers) + 1, bool)
    known[-1] = True  # ends of sentences stay
    shared = []
    for a, b in zip(*texts):
        known[a] = True
        shared.append(_hits(_cut(b[known[b]]), _cut(a)))
        known[a[a >= 0]] = False
    hits.append(np.array(shared, np.int64))
    size = np.array([[len(w) for w in side] for side in words], np.int64).reshape(2, n)
    both = [np.maximum(size - less, 0).sum(0) for less in (0, 1, 0)]
    return np.stack([np.where(h > 0, 2 * h / np.maximum(t, 1), 0.0) for h, t in zip(hits, both)], axis=1)


#: White space made one kind.
_SPACES = bytes.maketrans(b"\t\n\r\f", b"    ")


def _word_numbers(*sides: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """As ``_numbered``, of texts in lower case, as UTF-8: their words without signs."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    out = []
    for side in sides:
        words = [list(map(numbers.__getitem__, filter(None, x.translate(_SPACES, ASCII_PUNCTUATION.encode()).split(b" ")))) for x in side]
        out.append((np.fromiter(chain.from_iterable(words), np.int64, sum(map(len, words))), np.repeat(np.arange(len(side)), [len(x) for x in words])))
    return out


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


@F.arrow_udf(ArrayType(DoubleType()))
def _rouge(given: pa.Array, gold: pa.Array) -> pa.Array:
    return pa.array(_by_steps(lambda a, b: _summary_rouge(_texts(a), _texts(b)))(given, gold).tolist(), pa.list_(pa.float64()))


def rouge(rows: DataFrame, key: str, given: str, gold: str) -> DataFrame:
    """(key, rouge1, rouge2, rougeLsum): F1 of stemmed words, pairs of words, and of the summary-level subsequence.

    ``given`` and ``gold`` are texts; null and empty ones score 0.
    """
    r = small_batches(rows).select(key, _rouge(F.lower(given), F.lower(gold)).alias("_r"))
    return r.select(key, *(F.col("_r")[k].alias(n) for k, n in enumerate(("rouge1", "rouge2", "rougeLsum"))))


@F.arrow_udf(ArrayType(DoubleType()))
def _summary_scores(given: pa.Array, gold: pa.Array, source: pa.Array) -> pa.Array:
    """ROUGE-1, ROUGE-2, ROUGE-Lsum, SARI, matched runs of one to four words, words given, words of gold."""

    def run(*columns: pa.Array) -> np.ndarray:
        a, b, c = map(_texts, columns)
        n, (x, y, z) = len(a), _word_numbers(a, b, c)
        runs = list(_row_runs([z, x, y], 4))
        counts = [_clip(k[1:], n) for k in runs] + [np.bincount(side[1], minlength=n) for side in (x, y)]
        return np.column_stack([_summary_rouge(a, b), _sari_of(runs, n), *counts])

    return pa.array(_by_steps(run)(given, gold, source).tolist(), pa.list_(pa.float64()))


def summary_scores(rows: DataFrame, given: str, gold: str, source: str) -> DataFrame:
    """One row: means of rouge1, rouge2, rouge_L and sari (times 100), and bleu of the whole; of texts, each read once."""
    r = small_batches(rows).select(_summary_scores(*(F.lower(F.coalesce(F.col(c), F.lit(""))) for c in (given, gold, source))).alias("_s"))
    at = lambda k: F.col("_s")[k]
    means = [F.avg(at(k)).alias(n) for k, n in enumerate(("rouge1", "rouge2", "rouge_L"))] + [F.avg(100 * at(3)).alias("sari")]
    sums = [F.sum(at(n + 3).cast("long")).alias(f"_c{n}") for n in range(1, 5)] + [F.sum(F.greatest(at(8) - (n - 1), F.lit(0.0)).cast("long")).alias(f"_t{n}") for n in range(1, 5)]
    s = r.agg(*means, *sums, F.sum(at(9).cast("long")).alias("_r"))
    return s.select("rouge1", "rouge2", "rouge_L", "sari", _bleu(4)[0].cast(DoubleType()).alias("bleu"))


@cache
def _clipped(most: int) -> Callable:
    @F.arrow_udf(ArrayType(LongType()))
    def clipped(a: pa.Array, b: pa.Array) -> pa.Array:
        runs = _by_steps(lambda x, y: np.stack([common_runs(x, y, n) for n in range(1, most + 1)], axis=1))
        return pa.array(runs(a, b).tolist(), pa.list_(pa.int64()))

    return clipped


def corpus_bleu(rows: DataFrame, given: str, gold: str, by: tuple[str, ...] = (), most: int = 4) -> DataFrame:
    """(by, bleu, brevity, precisions, n): BLEU of a whole corpus of word arrays, from 0 to 100, one reference a row.

    Clipped and all n-grams are summed over the corpus; only then precisions, their geometric mean and the brevity
    penalty are taken. A precision without hits is halved once more for each such n, from 1/2 of a hit on; 0 if no word is right, or without words.
    """
    size = lambda c, n: F.greatest(F.coalesce(F.size(c), F.lit(0)) - (n - 1), F.lit(0))
    grams = range(1, most + 1)
    counted = small_batches(rows).select(*by, F.size(F.coalesce(F.col(gold), F.array().cast("array<string>"))).alias("_r"), _clipped(most)(given, gold).alias("_c"), *(size(given, n).alias(f"_t{n}") for n in grams))
    s = counted.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_r").alias("_r"), *(F.sum(F.col("_c")[n - 1]).alias(f"_c{n}") for n in grams), *(F.sum(f"_t{n}").alias(f"_t{n}") for n in grams))
    score, brevity, precisions = _bleu(most)
    return s.select(*by, score.cast(DoubleType()).alias("bleu"), brevity.alias("brevity"), F.array(*precisions).alias("precisions"), "n")


def _bleu(most: int) -> tuple[Column, Column, list[Column]]:
    """BLEU, brevity penalty and precisions from _c1, ... (matched runs), _t1, ... (all of them) and _r (words of the reference)."""
    misses, precisions = F.lit(0), []
    for n in range(1, most + 1):
        c, t = F.col(f"_c{n}"), F.col(f"_t{n}")
        misses = misses + F.when(c == 0, 1).otherwise(0)
        precisions.append(F.when(t > 0, F.when(c > 0, c / t).otherwise(1 / (F.pow(F.lit(2.0), misses) * t))).otherwise(F.lit(0.0)))
    brevity = F.when(F.col("_t1") == 0, 0.0).when(F.col("_t1") >= F.col("_r"), 1.0).otherwise(F.exp(1 - F.col("_r") / F.col("_t1")))
    logs = sum((F.log(p) for p in precisions[1:]), F.log(precisions[0]))
    score = F.when((F.col("_c1") > 0) & (precisions[-1] > 0), 100 * brevity * F.exp(logs / most)).otherwise(F.lit(0.0))
    return score, brevity, precisions
