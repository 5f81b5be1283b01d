"""Substring dedup (operator 2): repeated word windows found by super-k-mer partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Texts, batched, begin_task, compress, expand, materialise, mix, pack_ints, shuffle_width, steps, unpack_ints, window_hash

#: Words of the m-mer whose smallest hash picks the bucket of a window.
MINIMISER = 2
#: Bytes of packed strings in a bucket, about, and those that a task gathers before it sends them.
BUCKET_BYTES, SEND_BYTES = 2 << 20, 8 << 20


def super_kmers(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one minimiser: document, first word, windows in the run, and minimiser hash.

    Words are counted over all texts. A window's minimiser is the smallest hash of its m-mers,
    so equal windows have equal minimisers wherever they stand. Order is by document and position.
    """
    m = min(MINIMISER, size)
    h, w = t.word_hash(), size - m + 1
    mers = window_hash(h, m)
    n = len(h) - size + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none, np.empty(0, np.uint64)
    # smallest of w consecutive values, by doubling
    low, span = mers, 1
    while 2 * span <= w:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    low = np.minimum(low[: n], low[w - span : w - span + n])
    owner = t.doc_of_word()
    valid = np.flatnonzero(owner[:n] == owner[size - 1 : size - 1 + n])
    if not len(valid):
        return none, none, none, np.empty(0, np.uint64)
    new = np.ones(len(valid), bool)
    new[1:] = (low[valid[1:]] != low[valid[:-1]]) | (valid[1:] != valid[:-1] + 1) | (owner[valid[1:]] != owner[valid[:-1]])
    at = np.flatnonzero(new)
    return owner[valid[at]], valid[at], np.diff(np.append(at, len(valid))), low[valid[at]]


def _pack(ids: np.ndarray, keys: np.ndarray, known: np.ndarray, t: Texts, size: int, buckets: int) -> Iterator[tuple[int, bytes, list[np.ndarray]]]:
    """(bucket, packed strings, places): equal strings of this step travel once, with all their places.

    The places are four columns: how many each string has, and for each document id, row key and first word.
    """
    doc, first, windows, mini = super_kmers(t, size)
    doc, first, windows, mini = (x[known[doc]] for x in (doc, first, windows, mini))
    if not len(doc):
        return
    last = first + windows + size - 2
    begin, end = t.starts[first], t.ends[last]
    text_hash = t.span_hash(begin, end)
    bucket = (mix(mini) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((ids[doc], text_hash, bucket))
    doc, first, begin, end, bucket, text_hash = doc[order], first[order], begin[order], end[order], bucket[order], text_hash[order]
    length = end - begin
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (text_hash[1:] != text_hash[:-1]) | (bucket[1:] != bucket[:-1]) | (length[1:] != length[:-1])
    # The strings with any white space as one space: all bytes of the words, each with one space after it.
    f = np.flatnonzero(fresh)
    one = t.buf.copy()
    one[t.space] = 0x20
    double = np.append(False, t.space[1:] & t.space[:-1]) if len(t.buf) else t.space
    keep = ~double
    place = np.concatenate([[0], np.cumsum(keep)])
    raw = one[keep].tobytes()
    strings = [raw[x:y] for x, y in zip(place[begin[f]].tolist(), place[end[f]].tolist())]
    copies = np.diff(np.append(f, len(doc))).astype(np.int32)
    local = (first - t.first[doc]).astype(np.int32)
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    at = np.searchsorted(f, np.append(cuts, len(doc)))
    for k, (a, b) in enumerate(zip(cuts.tolist(), np.append(cuts[1:], len(bucket)).tolist())):
        p, q = int(at[k]), int(at[k + 1])
        yield int(bucket[a]), b"\n".join(strings[p:q]), [copies[p:q], ids[doc[a:b]], keys[doc[a:b]], local[a:b]]


def _found(packed: list[bytes], places: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, row key, first word, end word) of the words that windows of smaller documents cover, in one bucket."""
    lines: dict[bytes, int] = {}  # equal strings of several steps are one line from here on
    owner, parts = [], []
    for p, q in zip(packed, places):
        line = np.array([lines.setdefault(x, len(lines)) for x in expand(p).split(b"\n")])
        copies, *columns = unpack_ints(q, 4)
        owner.append(np.repeat(line, copies))
        parts.append(columns)
    raw = b"\n".join(lines)
    lines.clear()
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    ids, keys, at = (np.concatenate(x)[order] for x in zip(*parts))
    copies = np.bincount(owner)
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 0x0A)
    t = Texts(np.frombuffer(raw, np.uint8), np.concatenate([[0], breaks + 1, [len(raw)]]))
    # Every line holds words + size - 1 words for its windows; sort the windows, smallest document first.
    low = np.minimum.reduceat(ids, np.cumsum(copies) - copies)
    per = t.words - size + 1
    line = np.repeat(np.arange(t.n), per)
    nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    word = t.first[line] + nth
    key = window_hash(t.word_hash(), size)[word]
    order = np.argsort(key, kind="stable")
    k = key[order]
    group = np.cumsum(np.append(0, k[1:] != k[:-1]))
    count = np.bincount(group)
    some = count[group] > 1
    # Windows with one hash are compared as strings with the first of them; differing ones are told apart.
    rep = np.zeros(len(count), np.int64)
    rep[group[::-1]] = order[::-1]
    a, b = order[some], rep[group[some]]
    begin, end = t.starts[word], t.ends[word + size - 1]
    sames = np.fromiter((raw[p:q] == raw[r:s] for p, q, r, s in zip(begin[a].tolist(), end[a].tolist(), begin[b].tolist(), end[b].tolist())), bool, len(a))
    first_of = np.arange(len(key))
    first_of[a] = np.where(sames, b, a)
    if not sames.all():
        named: dict[bytes, int] = {}
        for i in a[~sames].tolist():
            first_of[i] = named.setdefault(raw[begin[i] : end[i]], i)
    least = np.full(len(key), np.iinfo(np.int64).max)
    np.minimum.at(least, first_of, low[line])
    least = least[first_of]
    # Per line and place: windows whose least document is smaller than the place's own.
    every = np.repeat(np.arange(t.n), copies)
    worth = np.zeros(t.n, bool)
    base = np.concatenate([[0], np.cumsum(per)])
    np.logical_or.at(worth, line, least < np.maximum.reduceat(ids, np.cumsum(copies) - copies)[line])
    out = [[], [], [], []]
    for p in np.flatnonzero(worth[every]).tolist():
        j = every[p]
        hit = np.flatnonzero(least[base[j] : base[j + 1]] < ids[p])
        if not len(hit):
            continue
        runs = np.split(hit, np.flatnonzero(np.diff(hit) >= size) + 1) if hit[-1] - hit[0] >= len(hit) else [hit]
        for r in runs:
            out[0].append(ids[p])
            out[1].append(keys[p])
            out[2].append(at[p] + r[0])
            out[3].append(at[p] + r[-1] + size)
    return tuple(np.array(x, np.int64) for x in out)


def bucket_count(docs: DataFrame) -> int:
    """Buckets so that one holds some megabytes of packed strings, from the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(max(2 * shuffle_width(docs.sparkSession), total * 3 / BUCKET_BYTES, 1))


def repeated_spans(docs: DataFrame, size: int = 13, buckets: int | None = None) -> DataFrame:
    """Where windows of ``size`` words repeat what a document with a smaller id has.

    Returns doc_id, row_key (32-bit hash of the text: it tells apart rows of one id) and spans, little-endian
    int64 pairs (first word, end word), for the texts that have any. Windows with one minimiser travel as one packed
    string to the minimiser's bucket. There the windows are sorted, and equal ones compared as
    strings. Strings that a step of a task finds more than once travel once, with their places.
    """
    buckets = buckets or bucket_count(docs)

    def pack(batches):
        begin_task("dedup")
        held: dict[int, tuple[list, list]] = {}
        size_held = 0

        def send():
            names, kinds = ["bucket", "packed", "places"], (pa.int32(), pa.binary(), pa.binary())
            keys = sorted(held)
            for at in range(0, len(keys), 64):
                part = keys[at : at + 64]
                cols = part, [compress(b"\n".join(held[k][0])) for k in part], [pack_ints(*map(np.concatenate, zip(*held[k][1]))) for k in part]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
            held.clear()

        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for row, t in steps(batch.column(2), most=1 << 20):
                to_row = slice(row, row + t.n)
                for k, strings, places in _pack(ids[to_row], keys[to_row], known[to_row], t, size, buckets):
                    to = held.setdefault(k, ([], []))
                    to[0].append(strings)
                    to[1].append(places)
                    size_held += len(strings)
                if size_held > SEND_BYTES:
                    yield from send()
                    size_held = 0
        yield from send()

    def sort(group: pa.Table) -> pa.Table:
        doc, key, a, b = _found(group.column("packed").to_pylist(), group.column("places").to_pylist(), size)
        order = np.lexsort((a, key, doc))
        doc, key, spans = doc[order], key[order], np.stack([a[order], b[order]], 1)
        cuts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(doc) else np.empty(0, np.int64)
        parts = [spans[x:y].tobytes() for x, y in zip(cuts, np.append(cuts[1:], len(doc)))]
        return pa.table([pa.array(doc[cuts]), pa.array(key[cuts].astype(np.int32)), pa.array(parts, pa.binary())], names=["doc_id", "row_key", "spans"])

    rows = batched(docs).select(F.col("doc_id").cast("long"), F.hash("text").alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    packed = rows.mapInArrow(pack, "bucket int, packed binary, places binary")
    spans = packed.groupBy("bucket").applyInArrow(sort, "doc_id long, row_key int, spans binary")
    return spans.groupBy("doc_id", "row_key").agg(F.collect_list("spans").alias("spans"))


def without_repeats(docs: DataFrame, size: int = 13, digest: bool = False) -> DataFrame:
    """Every row of ``docs`` with the words removed that lie in a window of a smaller document.

    Adds n_words, n_removed and kept_text (null where the text is null), and keeps all other
    columns; with ``digest`` kept_sha256 stands for text and kept_text: the SHA-256 of the kept words joined by one
    space. Words are runs of bytes other than space and U+0009 to U+000D; kept words are
    joined by one space where any was removed, else the text stays as it is. Windows are judged on
    the input. Texts of fewer than ``size`` words have none. Rows with a null id neither lose
    words nor count as smaller; rows with equal ids never remove from each other, and equal rows
    get equal results. Ids are integers of any sign. Columns named like the added ones are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text", "kept_sha256")
    marks = materialise(repeated_spans(docs, size)).toDF("_doc", "_key", "_spans")
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_row": F.hash("text")})
    joined = keyed.join(marks, (F.col("_id") == F.col("_doc")) & (F.col("_row") == F.col("_key")), "left").drop("_id", "_row", "_doc", "_key")
    names = [c for c in docs.columns if not (digest and c == "text")]
    last = "kept_sha256" if digest else "kept_text"
    schema = StructType([*(docs.schema[c] for c in names), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField(last, StringType())])

    def cut(batches):
        begin_task("dedup")
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("_spans")).to_pylist()
            n, removed, kept = [], [], []
            for text, parts in zip(batch.column(batch.schema.get_field_index("text")), spans):
                text = text.as_py()
                words = (text or "").encode().split()
                n.append(len(words))
                if parts:
                    gone = np.zeros(len(words) + 1, np.int64)
                    a, b = np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2).T
                    np.add.at(gone, a, 1)
                    np.add.at(gone, b, -1)
                    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                    removed.append(len(words) - len(stay))
                    words = [words[i] for i in stay.tolist()]
                else:
                    removed.append(0)
                if digest:
                    kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
                else:
                    kept.append(b" ".join(words).decode() if removed[-1] else text)
            keep = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [*names, "n_words", "n_removed", last])

    return joined.mapInArrow(cut, schema)
