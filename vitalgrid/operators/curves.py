"""Metrics of (row, label) cells from one pass: a row's cells stand in arrays, so a row is measured where it lies.

Counts by label and score, which labels and the whole table need, are made task by task and travel packed: sorted
scores by their differences, so a block takes a byte or two a score where rows would take tens.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, small_batches

#: Blocks that a task's counts are dealt to; parts of the range of scores that a label's are.
BUCKETS, RANGES = 2048, 64
#: Cells that a task holds before it counts and sends them.
HELD = 1 << 21
#: Place of a null score, below all others.
_NONE = np.iinfo(np.int64).min
#: What is summed over rows: each metric and the rows that have it.
BY_ROW = ("pr_auc", "roc_auc", "f1", "precision", "recall", "jaccard")


def _places(scores: pa.Array) -> np.ndarray:
    """Whole numbers in the order of the scores: null is lowest, NaN highest, zeros are one."""
    x = scores.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
    bits = bits ^ ((bits >> 63) & np.iinfo(np.int64).max)
    return np.where(scores.is_null().to_numpy(zero_copy_only=False), _NONE, bits)


def _scores(places: np.ndarray) -> pa.Array:
    bits = places ^ ((places >> 63) & np.iinfo(np.int64).max)
    return pa.array(bits.view(np.float64), mask=places == _NONE)


def _grouped(keys: tuple[np.ndarray, ...], *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct ``keys`` (the last is the first to sort by) with the sums of ``counts``."""
    if not len(keys[0]):
        return *keys, *counts
    order = np.argsort(keys[0])
    for k in keys[1:]:
        k = k[order]
        order = order[np.argsort(k.astype(np.uint16) if k.max() < 1 << 16 else k, kind="stable")]  # short numbers are sorted faster
    keys = tuple(k[order] for k in keys)
    first = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
    return *(k[first] for k in keys), *(np.add.reduceat(c[order], first) for c in counts)


def _row_ranks(place: np.ndarray, row: np.ndarray, y: np.ndarray, rows: int) -> list[np.ndarray]:
    """Average precision and AUC of each row; NaN without positives, or without both classes."""
    place, row, pos, n = _grouped((place, row), y, np.ones(len(y), np.int64))
    neg = n - pos
    total_pos, total_neg = (np.bincount(row, c, rows) for c in (pos, neg))
    before = lambda c, t: np.cumsum(c) - c - (np.cumsum(t) - t)[row]
    below_pos, below_neg = before(pos, total_pos), before(neg, total_neg)
    upto = total_pos[row] - below_pos
    precision = upto / np.maximum(upto + total_neg[row] - below_neg, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ap = np.where(total_pos > 0, np.bincount(row, pos * precision, rows) / total_pos, np.nan)
        auc = np.where(total_pos * total_neg > 0, np.bincount(row, pos * (below_neg + neg / 2), rows) / (total_pos * total_neg), np.nan)
    return [ap, auc]


def _row_ratios(row: np.ndarray, y: np.ndarray, predicted: np.ndarray, rows: int) -> list[np.ndarray]:
    """F1, precision, recall and Jaccard of each row's 0/1 predictions; without a denominator 0, F1 and Jaccard 1."""
    tp, n_p, n_t = (np.bincount(row[c], minlength=rows) for c in (y & predicted, predicted, y))
    ratio = lambda a, b, e: np.where(b > 0, a / np.maximum(b, 1), e)
    return [ratio(2 * tp, n_p + n_t, 1.0), ratio(tp, n_p, 0.0), ratio(tp, n_t, 0.0), ratio(tp, n_p + n_t - tp, 1.0)]


class _Labels(dict):
    """Numbers of the labels that a task has seen."""

    def __init__(self):
        self.hashes: list[int] = []

    def __missing__(self, label: str | None) -> int:
        self[label] = n = len(self)
        self.hashes.append(crc32((label or "").encode()))
        return n

    def of(self, labels: pa.Array) -> np.ndarray:
        coded = labels.dictionary_encode(null_encoding="encode")
        return np.array([self[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]


def _planes(numbers: np.ndarray) -> bytes:
    """The bytes of whole numbers, all first ones, then all second ones and so on: the zeros of small ones lie together."""
    return np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _packed(labels: _Labels, place: np.ndarray, code: np.ndarray, pos: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of counts, each of a range of scores of some labels."""
    share = np.clip(np.nan_to_num(_scores(place).fill_null(0.0).to_numpy(zero_copy_only=False), nan=1.0), 0.0, 1.0)
    bucket = (np.array(labels.hashes, np.int64)[code] + (share * RANGES).astype(np.int64) * 40503) % BUCKETS
    order = np.argsort(bucket, kind="stable")  # within a bucket by label and score
    ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
    names, out, at = list(labels), [], 0
    for end in ends.tolist():
        x = order[at:end]
        own, local = np.unique(code[x], return_inverse=True)
        raw = b"".join(_planes(c) for c in (np.diff(local, prepend=0), np.diff(place[x], prepend=0), pos[x], n[x]))
        out.append({"bucket": int(bucket[x[0]]), "size": end - at, "labels": [names[c] for c in own], "data": pa.compress(raw, "zstd", asbytes=True), "sums": None})
        at = end
        if len(out) == 256:
            yield pa.RecordBatch.from_pylist(out, _BLOCKS)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, _BLOCKS)


def _unpacked(block: dict, labels: _Labels) -> tuple[np.ndarray, ...]:
    m = block["size"]
    raw = np.frombuffer(pa.decompress(block["data"], m * 32, "zstd", asbytes=True), np.uint8).reshape(4, 8, m)
    local, place, pos, n = (np.ascontiguousarray(p.T).view("<i8").ravel() for p in raw)
    return np.cumsum(place), np.array([labels[x] for x in block["labels"]], np.int64)[np.cumsum(local)], pos, n


_BLOCKS = pa.schema([("bucket", pa.int32()), ("size", pa.int64()), ("labels", pa.list_(pa.string())), ("data", pa.binary()), ("sums", pa.list_(pa.float64()))])
_COUNTS = pa.schema([("label", pa.string()), ("score", pa.float64()), ("pos", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.float64()))])


def _count(by_label: bool, held: int):
    """From arrays of cells: blocks of counts (if ``by_label``), and a row of sums over rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, kept, size = _Labels(), [], 0
        sums = np.zeros((len(BY_ROW), 2))
        for batch in batches:
            if not (rows := len(batch)):
                continue
            row = np.repeat(np.arange(rows), batch.column("y").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            column = lambda name: batch.column(name).flatten()  # noqa: E731, B023
            known = column("y").is_valid().to_numpy(zero_copy_only=False)
            y = column("y").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            place = _places(column("score"))
            scored = _row_ranks(place[known], row[known], y[known], rows)
            if "predicted" in batch.schema.names:
                scored += _row_ratios(row, y == 1, column("predicted").fill_null(0).to_numpy(zero_copy_only=False) == 1, rows)
            for k, x in enumerate(scored):
                sums[k] += np.nansum(x), np.count_nonzero(~np.isnan(x))
            if by_label:
                kept.append((place[known], labels.of(column("label"))[known], y[known]))
                size += len(place)
            if size >= held:
                yield from send(labels, kept)
                kept, size = [], 0
        if kept:
            yield from send(labels, kept)
        yield pa.RecordBatch.from_pylist([{"bucket": -1, "sums": sums.ravel().tolist()}], _BLOCKS)

    def send(labels: _Labels, kept: list) -> Iterator[pa.RecordBatch]:
        place, code, y = (np.concatenate(c) for c in zip(*kept))
        counts = _grouped((place, code), y, np.ones(len(y), np.int64))
        if len(counts[0]):
            yield from _packed(labels, *counts)

    return run


def _merge(held: int):
    """From blocks: (label, score, pos, n), equal ones mostly added up, and the rows of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, kept, size = _Labels(), [], 0
        for batch in batches:
            for i in range(len(batch)):
                block = batch.slice(i, 1).to_pylist()[0]
                if block["sums"] is not None:
                    yield pa.RecordBatch.from_pylist([{"sums": block["sums"]}], _COUNTS)
                    continue
                kept.append(_unpacked(block, labels))
                size += block["size"]
                if size >= held:
                    kept = [added(kept)]
                    size = len(kept[0][0])
                    if size >= held // 2:
                        yield from rows(labels, kept[0])
                        kept, size = [], 0
        if kept:
            yield from rows(labels, added(kept))

    def added(kept: list) -> tuple[np.ndarray, ...]:
        place, code, pos, n = (np.concatenate(c) for c in zip(*kept))
        return _grouped((place, code), pos, n)

    def rows(labels: _Labels, counts: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        names = pa.array(list(labels), pa.string())
        for at in range(0, len(counts[0]), 1 << 16):
            place, code, pos, n = (c[at : at + (1 << 16)] for c in counts)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(code)), _scores(place), pa.array(pos), pa.array(n), pa.nulls(len(n), pa.list_(pa.float64()))], schema=_COUNTS)

    return run


def gathered(rows: DataFrame, key: str, label: str = "label", y: str = "y", score: str = "score", predicted: str | None = None) -> DataFrame:
    """(label, y, score, predicted if given): arrays of all cells of a key.

    Columns that are such arrays already, a row a key, are taken as they are. No shuffle where the cells of a key lie together.
    """
    kinds = {"label": (label, "string"), "y": (y, "int"), "score": (score, "double")} | ({"predicted": (predicted, "int")} if predicted else {})
    if dict(rows.dtypes)[score].startswith("array"):
        return rows.select(*(F.col(c).cast(f"array<{kind}>").alias(n) for n, (c, kind) in kinds.items()))
    cells = F.collect_list(F.struct(*(F.col(c).cast(kind).alias(n) for n, (c, kind) in kinds.items())))
    return rows.groupBy(key).agg(cells.alias("_c")).select(*(F.col(f"_c.{n}").alias(n) for n in kinds))


def row_averages(cells: DataFrame) -> DataFrame:
    """One row: the means over rows of ``BY_ROW``, each over the rows that have it; the last four where ``cells``, as ``gathered``, have predicted."""
    return _means(small_batches(cells, 10_000).mapInArrow(_count(False, HELD), _ddl(_BLOCKS)))


def _means(sums: DataFrame) -> DataFrame:
    at = lambda k: F.sum(F.col("sums")[k])
    return sums.agg(*(F.when(at(2 * k + 1) > 0, at(2 * k) / at(2 * k + 1)).alias(f"{m}_samples") for k, m in enumerate(BY_ROW)))


def counted(cells: DataFrame, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """(label, score, pos, neg): counts of the cells, some in several rows, and ``row_averages``; both from one pass.

    The pass is written to the shared folder: what is made of it by label, over all and by row reads that.
    """
    blocks = small_batches(cells, 10_000).mapInArrow(_count(True, held), _ddl(_BLOCKS)).repartition("bucket")
    spark = cells.sparkSession
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    blocks.mapInArrow(_merge(held), _ddl(_COUNTS)).write.parquet(at)
    stored = spark.read.schema(_ddl(_COUNTS)).parquet(at)
    counts = stored.where("sums is null").select("label", "score", F.col("pos").cast("double").alias("pos"), (F.col("n") - F.col("pos")).cast("double").alias("neg"))
    return counts, _means(stored.where("sums is not null"))


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.string()): "array<string>", pa.list_(pa.float64()): "array<double>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)
