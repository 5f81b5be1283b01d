"""Document fingerprints (operator 6): a Merkle tree over sections, paragraphs and their pieces."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, batched, shuffle_width, steps

_NEAR = np.random.default_rng(77).integers(1, 2**64, (4, 256), dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)
_VALUES = np.zeros(256, np.uint32)
_VALUES[_DIGITS] = np.arange(64)

#: One in so many words begins a piece, one in so many paragraphs ends a section: chosen by their
#: own bytes, so a change moves only the borders beside it.
PIECE_WORDS, SECTION_PARAGRAPHS = 3, 4
#: Bytes of a piece at most; longer ones (a text without spaces) are cut there.
PIECE_BYTES = 256


class Tree:
    """A Merkle tree: the root, section digests, paragraph digests, and 24-bit marks of the pieces below."""

    def __init__(self, root: str, sections: list[str], in_section: list[int], paragraphs: list[str], in_paragraph: list[int], marks: np.ndarray):
        self.root, self.sections, self.in_section = root, sections, in_section
        self.paragraphs, self.in_paragraph, self.marks = paragraphs, in_paragraph, marks
        self._keys: np.ndarray | None = None

    def __str__(self) -> str:
        """``root:section/paragraph=pieces,paragraph=pieces;section/...``"""
        digits = _DIGITS[(self.marks[:, None] >> np.array([18, 12, 6, 0], np.uint32)) & np.uint32(63)].tobytes().decode()
        out, p, at = [], 0, 0
        for digest, n in zip(self.sections, self.in_section):
            parts = []
            for q in range(p, p + n):
                to = at + 4 * self.in_paragraph[q]
                parts.append(f"{self.paragraphs[q]}={digits[at:to]}")
                at = to
            p += n
            out.append(f"{digest}/{','.join(parts)}")
        return f"{self.root}:{';'.join(out)}"

    @classmethod
    def parse(cls, fingerprint: str) -> Tree:
        root, _, body = fingerprint.partition(":")
        sections, in_section, paragraphs, in_paragraph, digits = [], [], [], [], []
        for s in body.split(";"):
            digest, _, rest = s.partition("/")
            parts = [p.split("=") for p in rest.split(",")]
            sections.append(digest)
            in_section.append(len(parts))
            for d, marks in parts:
                paragraphs.append(d)
                in_paragraph.append(len(marks) // 4)
                digits.append(marks)
        v = _VALUES[np.frombuffer("".join(digits).encode(), np.uint8)].reshape(-1, 4)
        return cls(root, sections, in_section, paragraphs, in_paragraph, (v[:, 0] << 18) | (v[:, 1] << 12) | (v[:, 2] << 6) | v[:, 3])

    @staticmethod
    def keyed(marks: np.ndarray) -> np.ndarray:
        """Sorted marks, the k-th of equal ones told apart by k."""
        m = np.sort(marks).astype(np.uint64)
        return np.sort(m | ((np.arange(len(m)) - np.searchsorted(m, m)).astype(np.uint64) << np.uint64(24)))

    def keys(self) -> np.ndarray:
        if self._keys is None:
            self._keys = self.keyed(self.marks)
        return self._keys

    def without(self, equal: Counter) -> np.ndarray:
        """Keys of the marks outside the sections that were found equal."""
        left, at, keep, p = Counter(equal), 0, np.ones(len(self.marks), bool), 0
        for digest, n in zip(self.sections, self.in_section):
            size = sum(self.in_paragraph[p : p + n])
            if left[digest] > 0:
                left[digest] -= 1
                keep[at : at + size] = False
            at, p = at + size, p + n
        return self.keyed(self.marks[keep])


def _piece_cuts(t: Texts, begin: np.ndarray) -> np.ndarray:
    """Where pieces begin: at words chosen by the bytes before them in their paragraph."""
    low = begin[np.searchsorted(begin, t.starts, "right") - 1]
    gap, low = t.starts[t.starts > low], low[t.starts > low]
    key = np.zeros(len(gap), np.uint64)
    for j in range(4):
        key += np.where(gap - 2 - j >= low, _NEAR[j][t.buf[np.maximum(gap - 2 - j, 0)]], np.uint64(0))
    key = (key ^ (key >> np.uint64(29))) * _ODD
    return gap[(key >> np.uint64(40)) % np.uint64(PIECE_WORDS) == 0]


def trees(t: Texts) -> Iterator[Tree]:
    """The tree of each text; the pieces of all of them are hashed in one go."""
    lines = np.flatnonzero(t.buf == 0x0A)
    begin = np.sort(np.concatenate([t.offsets[:-1], lines + 1]), kind="stable")  # of paragraphs, an empty text has one
    owner = np.concatenate([np.arange(t.n), np.searchsorted(t.offsets, lines, "right") - 1])
    owner.sort()
    last = np.append(owner[1:] != owner[:-1], True)
    end = np.where(last, t.offsets[owner + 1], np.append(begin[1:], 0) - 1)
    cuts = _piece_cuts(t, begin)
    starts = np.union1d(cuts, begin[end > begin])
    inside = np.searchsorted(begin, starts, "right") - 1  # empty paragraphs have no piece: the last of equal begins
    starts, inside = starts[starts < end[inside]], inside[starts < end[inside]]
    stops = np.minimum(np.append(starts[1:], len(t.buf)), end[inside])
    if len(starts) and (stops - starts).max() > PIECE_BYTES:
        parts = -(-(stops - starts) // PIECE_BYTES)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, stops, inside = np.repeat(starts, parts) + nth * PIECE_BYTES, np.repeat(stops, parts), np.repeat(inside, parts)
        stops = np.minimum(stops, starts + PIECE_BYTES)
    marks = (t.span_hash(starts, stops) >> np.uint64(40)).astype(np.uint32)
    pieces = np.bincount(inside, minlength=len(begin))
    to = np.concatenate([[0], np.cumsum(pieces)])
    first = np.searchsorted(owner, np.arange(t.n + 1))
    raw = t.buf.tobytes()
    hash_ = hashlib.blake2b
    for i in range(t.n):
        a, b = first[i], first[i + 1]
        digests = [hash_(raw[x:y], digest_size=16).digest() for x, y in zip(begin[a:b].tolist(), end[a:b].tolist())]
        sections, in_section, at = [], [], 0
        for k, d in enumerate(digests):
            if d[0] % SECTION_PARAGRAPHS == 0 or k == len(digests) - 1:
                sections.append(hash_(b"".join(digests[at : k + 1]), digest_size=16).digest())
                in_section.append(k + 1 - at)
                at = k + 1
        root = hash_(b"".join(sections), digest_size=16).hexdigest()
        yield Tree(root, [s.hex()[:8] for s in sections], in_section, [d.hex()[:8] for d in digests], pieces[a:b].tolist(), marks[to[a] : to[b]])


def merkle(texts: Iterable[str]) -> list[Tree]:
    """Trees of texts.

    Paragraphs are the \\n-split lines, a section is a run of them. A paragraph's digest is of
    its bytes, a section's of its paragraphs' digests, the root of the sections' digests, so equal
    roots mean equal texts. The root keeps 128 bits; below it digests are cut to locate edits
    only: 32 bits for sections and paragraphs, and for each piece of a few words 24 bits.
    """
    return [tree for _, t in steps(pa.array(texts, pa.large_string())) for tree in trees(t)]


def likeness(a: Tree, b: Tree) -> float:
    """Shared content of two fingerprints, from 0 to 1 (equal texts only).

    Walks down from the roots: all pieces of equal sections are shared, and of the rest
    equal pieces. Twice the number of shared pieces over the pieces of both.
    """
    if a.root == b.root:
        return 1.0
    total = len(a.marks) + len(b.marks)
    equal = Counter(a.sections) & Counter(b.sections)
    left, right = (a.without(equal), b.without(equal)) if equal else (a.keys(), b.keys())
    shared = len(a.marks) - len(left)
    if len(left) and len(right):
        at = np.minimum(np.searchsorted(right, left), len(right) - 1)
        shared += int((right[at] == left).sum())
    return min(2 * shared / total, 1 - 1e-9) if total else 1 - 1e-9


def edits(a: Tree, b: Tree) -> list[int]:
    """The paragraphs of ``a`` (from 0) that no equal branch of ``b`` covers."""
    sections, paragraphs = set(b.sections), set(b.paragraphs)
    out, p = [], 0
    for digest, n in zip(a.sections, a.in_section):
        if digest not in sections:
            out += [q for q in range(p, p + n) if a.paragraphs[q] not in paragraphs]
        p += n
    return out


def edited_text(text: str, after: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def document_fingerprints(docs: DataFrame, rows_a_bucket: int = 1000) -> DataFrame:
    """Fingerprint of each text and of an edited text whose last half comes from the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next. Next is by ascending doc_id, after the last comes the first; null ids come before
    all others, rows with equal ids are ordered by text. A null text is empty. A single row is
    its own next. Other columns are ignored; an empty table gives an empty result.

    The ids are cut at quantiles of about ``rows_a_bucket`` rows; the row at each cut travels
    also to the bucket before it, so one shuffle of the texts brings every pair together.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = batched(docs).select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    n = rows.select("doc_id").count()
    buckets = max(1, -(-n // rows_a_bucket), min(n, 2 * shuffle_width(spark)))
    bounds = sorted({float(x) for x in rows.select(key.alias("k")).approxQuantile("k", [i / buckets for i in range(buckets)], min(0.2 / buckets, 0.01))}) if n else []

    @F.pandas_udf("array<int>")
    def places(k: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, k.to_numpy(), "right") - 1
        cut = np.isin(k.to_numpy(), bounds) if bounds else np.zeros(len(k), bool)
        at = np.maximum(at, 0)
        return pd.Series([[int(b), int((b - 1) % len(bounds))] if c else [int(b)] for b, c in zip(at, cut)])

    # Which row of the ids at a cut comes first there is settled by text, as everywhere.
    placed = rows.withColumn("places", places(key)).select("doc_id", "text", F.posexplode("places").alias("tail", "bucket"))

    def pairs(group: pa.Table) -> pa.Table:
        ids, texts, tail = group.column("doc_id").to_pylist(), group.column("text").to_pylist(), group.column("tail").to_pylist()
        own = sorted((i for i in range(len(ids)) if not tail[i]), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
        heads = sorted((i for i in range(len(ids)) if tail[i]), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
        out: list[tuple] = []
        chain = [*own, *(heads or own)[:1]]
        for at in range(0, len(own), 64):  # so many texts and their edited texts at a time
            part = chain[at : at + 65]
            prints = merkle([texts[i] for i in part])
            edited = [edited_text(texts[i], texts[j]) for i, j in zip(part, part[1:])]
            for i, text, p, q, e in zip(part, edited, prints, prints[1:], merkle(edited)):
                out.append((ids[i], len(texts[i]), hashlib.sha256(text.encode()).hexdigest(), str(p), str(e), likeness(p, e), likeness(p, q)))
        cols = list(zip(*out)) if out else [[]] * 7
        kinds = (group.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return placed.groupBy("bucket").applyInArrow(pairs, schema)
