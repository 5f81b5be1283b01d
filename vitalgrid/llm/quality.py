"""Quality rules (operator 9): a short-circuit cascade ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Texts, batched, mix, steps, texts_of, window_hash, window_starts

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True


def later_copies(group: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items with a group and a hash: which equal an earlier item of their group, and which equal any other."""
    later, any_ = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        keys = hashes ^ mix(group.astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys, kind="stable")
        same = (keys[order][1:] == keys[order][:-1]) & (group[order][1:] == group[order][:-1])
        later[order[1:][same]] = True
        any_[order[1:][same]] = any_[order[:-1][same]] = True
    return later, any_


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``size`` words that starts at one of ``starts``."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + size, n), -1)
    return np.cumsum(edges[:-1]) > 0


def base_stats(t: Texts, window: int = 8) -> dict[str, np.ndarray]:
    """The counts that every document gets, rejected or not."""
    points = (t.buf & 0xC0) != 0x80
    out = {"n_words": t.words.astype(np.int64), "word_chars": t.count(points & ~t.space), "n_symbols": t.count(SYMBOLS[t.buf])}
    breaks = np.flatnonzero(t.buf == 0x0A)
    begin = np.concatenate([t.offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(t.n), np.searchsorted(t.offsets, breaks, "right") - 1])
    order = np.lexsort((begin, doc))
    begin, doc = begin[order], doc[order]
    end = np.empty_like(begin)
    if len(begin):
        end[:-1] = np.where(doc[1:] == doc[:-1], begin[1:] - 1, t.offsets[doc[:-1] + 1])
        end[-1] = t.offsets[-1]
    full = np.searchsorted(t.starts, end) > np.searchsorted(t.starts, begin)
    begin, end, doc = begin[full], end[full], doc[full]
    later, _ = later_copies(doc, t.span_hash(begin, end))
    out["n_dup_lines"] = np.bincount(doc[later], minlength=t.n).astype(np.int64)
    out["n_lines"] = np.bincount(doc, minlength=t.n).astype(np.int64)
    at = window_starts(t, window)
    owner = t.doc_of_word()
    _, twice = later_copies(owner[at], window_hash(t.word_hash(), window)[at] if len(at) else np.empty(0, np.uint64))
    inside = covered(at[twice], window, len(t.starts))
    out["n_repeat_words"] = np.bincount(owner[inside], minlength=t.n).astype(np.int64)
    return out


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps texts, their counts and the rows still alive to a verdict for each of these rows."""

    name: str
    rejects: Callable[[Texts, dict[str, np.ndarray], np.ndarray], np.ndarray]
    stats: dict = field(default_factory=dict, compare=False)


def _symbol_density(t, s, rows):
    return 10 * s["n_symbols"][rows] > s["n_words"][rows]


def _word_length(t, s, rows):
    n, chars = s["n_words"][rows], s["word_chars"][rows]
    return (chars < 2 * n) | (chars > 15 * n)


def _repeated_lines(t, s, rows):
    return 2 * s["n_dup_lines"][rows] > s["n_lines"][rows]


def _alive(t: Texts, rows: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(place in rows, row, first byte, end byte) of the rows still alive: a rule reads these alone."""
    return ((k, i, int(t.offsets[i]), int(t.offsets[i + 1])) for k, i in enumerate(rows.tolist()))


def _shouting(t, s, rows):
    """More than half of the letters are capitals."""
    out = np.empty(len(rows), bool)
    for k, _, a, b in _alive(t, rows):
        out[k] = 2 * np.count_nonzero(_UPPER[t.buf[a:b]]) > np.count_nonzero(_LETTER[t.buf[a:b]])
    return out


def _letterless_words(t, s, rows):
    """Less than 7 in 10 words have a letter."""
    out = np.empty(len(rows), bool)
    for k, i, a, b in _alive(t, rows):
        sums = np.concatenate([[0], np.cumsum(_LETTER[t.buf[a:b]])])
        words = slice(t.first[i], t.first[i + 1])
        out[k] = 10 * np.count_nonzero(sums[t.ends[words] - a] > sums[t.starts[words] - a]) < 7 * s["n_words"][i]
    return out


def _few_distinct_words(t, s, rows):
    """One word makes up more than 3 in 10 words of a text of 50 words or more."""
    out = np.zeros(len(rows), bool)
    for k, i, _, _ in _alive(t, rows):
        if s["n_words"][i] >= 50:
            words = slice(t.first[i], t.first[i + 1])
            out[k] = 10 * np.unique(t.span_hash(t.starts[words], t.ends[words]), return_counts=True)[1].max() > 3 * s["n_words"][i]
    return out


RULES = (
    Rule("few_distinct_words", _few_distinct_words),
    Rule("letterless_words", _letterless_words),
    Rule("shouting", _shouting),
    Rule("symbol_density", _symbol_density),
    Rule("word_length", _word_length),
    Rule("repeated_lines", _repeated_lines),
)


def order_rules(rules: Sequence[Rule], texts: Iterator[Texts]) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) on a sample, best rejection per cost first; ties by name."""
    seconds, hits, n = dict.fromkeys((r.name for r in rules), 0.0), dict.fromkeys((r.name for r in rules), 0), 0
    for t in texts:
        stats, rows = base_stats(t), np.arange(t.n)
        n += t.n
        for r in rules:
            t._sums = None  # each rule pays for its own hashes
            began = time.perf_counter()
            hits[r.name] += int(r.rejects(t, stats, rows).sum())
            seconds[r.name] += time.perf_counter() - began
    table = [(r.name, seconds[r.name] / max(n, 1), hits[r.name] / max(n, 1)) for r in rules]
    return sorted(table, key=lambda x: (-x[2] / max(x[1], 1e-9), x[0]))


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 1000, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Count-based base check for every text, then the rule cascade for the texts that pass it.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_lines and rejected_by (the first rule of the cascade that rejects, else null).
    The order of the rules comes from about ``sample_rows`` rows: the cost of each rule in
    seconds a text and its share of rejections. It changes the work and ``rejected_by``, never
    ``kept``, since a text is kept if no rule rejects it. A null or empty text has zeros and
    fails the base check. Repeated rows and null ids are scored as any other row; other
    columns are ignored. 64-bit hashes stand for windows and lines within one text.
    """
    by_name = {r.name: r for r in rules}
    sample = docs.select("text").sample(0.1, seed=7).limit(sample_rows).toArrow()
    order = [x[0] for x in order_rules(rules, (t for _, t in steps(sample.column("text"))))] if sample.num_rows else list(by_name)

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for row, t in steps(texts_of(batch)):
                s = base_stats(t)
                failed = (s["n_words"] < min_words) | (100 * s["n_repeat_words"] > max_repeat_percent * s["n_words"])
                by = np.full(t.n, None, object)
                alive = np.flatnonzero(~failed)
                for name in order:
                    if not len(alive):
                        break
                    bad = by_name[name].rejects(t, s, alive)
                    by[alive[bad]] = name
                    alive = alive[~bad]
                kept = np.zeros(t.n, bool)
                kept[alive] = True
                cols = [ids.slice(row, t.n), *(pa.array(s[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(kept), pa.array(s["n_lines"]), pa.array(by, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "rejected_by"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return batched(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, rejected_by string")
