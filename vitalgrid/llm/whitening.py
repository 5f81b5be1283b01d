"""Embedding whitening (operator 13): leading components by FEAST contour integration.

Entries are whole numbers after scaling, so sums and the centred second moments are summed exactly by Spark, one number
for each dimension or pair of dimensions; the covariance of d dimensions (d*d numbers, however many rows) is then known
to the last bit. Its spectrum is cut into slices at wide gaps, found by counts of eigenvalues above a shift (the inertia
of an LDL' factorisation). Each slice is a task: the quadrature of the resolvent along a circle through the slice's ends,
complex shifted solves on its nodes, projects a random block onto the slice's eigenvectors, and a Rayleigh-Ritz step
extracts them; this repeats until the residuals are at rounding level and as many are found as the inertia counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched

SCALE, SHIFT = 1024, 100_000
#: Eigenvalues of a slice, nodes of its half circle, and rounds before its block is widened.
PER_SLICE, NODES, ROUNDS = 4, 8, 6
_EPS = float(np.finfo(float).eps)


def eigenvalues_above(v: np.ndarray, shift: float) -> int:
    """The positive part of the inertia of ``v - shift``: by a symmetric factorisation with complete pivoting."""
    a = v - shift * np.eye(len(v))
    above, i, n = 0, 0, len(a)
    alpha = (1 + 17**0.5) / 8
    while i < n:
        rest = a[i:, i:]
        diagonal = np.abs(np.diagonal(rest))
        p = int(diagonal.argmax())
        off = np.abs(rest - np.diag(np.diagonal(rest)))
        r, s = divmod(int(off.argmax()), n - i)
        if diagonal[p] >= alpha * off[r, s]:
            if diagonal[p] == 0:
                break  # all that is left equals the shift
            pivots = [p]
        else:
            pivots = sorted((r, s))
        order = np.array(pivots + [k for k in range(n - i) if k not in pivots])
        rest = rest[np.ix_(order, order)]
        m = len(pivots)
        above += 1 if m == 2 or rest[0, 0] > 0 else 0  # a block of two has one eigenvalue of either sign
        c = rest[m:, :m]
        a[i:, i:] = rest
        a[i + m :, i + m :] = rest[m:, m:] - c @ np.linalg.solve(rest[:m, :m], c.T)
        i += m
    return above


class Spectrum:
    """Slices of the leading eigenvalues of a covariance."""

    def __init__(self, v: np.ndarray):
        self.v, self.known = v, {}
        self.top = float(np.abs(v).sum(1).max()) * (1 + 1e-9) if len(v) else 0.0
        self.zero = len(v) * _EPS * float(np.trace(v))

    def above(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = eigenvalues_above(self.v, shift)
        return self.known[shift]

    def gap(self, low: float, high: float, k: int) -> float | None:
        """The middle of the gap below the k-th largest eigenvalue between two shifts; None where there is hardly one."""
        found = None
        a, b = low, high
        while b - a > 1e-9 * self.top:
            mid = (a + b) / 2
            n = self.above(mid)
            if n == k:
                found = mid
                break
            a, b = (mid, b) if n > k else (a, mid)
        if found is None:
            return None
        under, over = (a, found), (found, b)
        for _ in range(6):  # the ends of the gap, nearly
            mid = sum(under) / 2
            under = (under[0], mid) if self.above(mid) == k else (mid, under[1])
            mid = sum(over) / 2
            over = (mid, over[1]) if self.above(mid) == k else (over[0], mid)
        return (under[1] + over[0]) / 2

    def slices(self, k: int) -> list[tuple[float, float, int]]:
        """(low, high, eigenvalues between) that hold the k largest, and all that equal the k-th; eigenvalues that are nought by rounding are left out."""
        if not len(self.v) or self.top <= 0:
            return []
        total = self.above(self.zero)
        k, cut = min(k, total), None
        while 0 < k < total and (cut := self.gap(self.zero, self.top, k)) is None:
            k += 1
        if not k:
            return []
        out, left = [], [(self.zero if cut is None else cut, self.top, k, 0)]
        while left:
            low, high, n_low, n_high = left.pop()
            n = n_low - n_high
            middle = None
            if n > PER_SLICE:
                for at in sorted(range(n_high + 1, n_low), key=lambda x: abs(2 * x - n_low - n_high)):
                    if (middle := self.gap(low, high, at)) is not None:
                        left += [(low, middle, n_low, at), (middle, high, at, n_high)]
                        break
            if middle is None and n:
                out.append((low, high, n))
        return sorted(out, reverse=True)


def rayleigh_ritz(v: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit vectors of ``v`` within the span of ``block``, by falling eigenvalue."""
    q, r = np.linalg.qr(block)
    size = np.abs(np.diagonal(r))
    q = q[:, size > 1e-14 * size.max()] if len(size) and size.max() > 0 else q
    h = q.T @ v @ q
    e, w = np.linalg.eigh((h + h.T) / 2)
    return e[::-1], q @ w[:, ::-1]


def feast(v: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues of ``v`` between ``low`` and ``high``, falling, and their unit vectors.

    If fewer or more than ``count`` come out with residuals at rounding level, or the block is full and they still do,
    it is an error: none is missed in silence.
    """
    d = len(v)
    size = min(d, 2 * count + 4)
    x, weight = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(0.5j * np.pi * (1 + x))
    middle, radius = (low + high) / 2, (high - low) / 2
    nodes = middle + radius * turn
    tolerance = 8 * d * _EPS * max(float(np.abs(v).sum(1).max()), abs(high))
    y = np.random.default_rng(seed).standard_normal((d, size))
    while True:
        for _ in range(ROUNDS):
            q = sum(w / 2 * (radius * t * np.linalg.solve(z * np.eye(d) - v, y.astype(complex))).real for z, t, w in zip(nodes, turn, weight))
            e, block = rayleigh_ritz(v, q)
            inside = (e > low) & (e < high)
            residual = np.linalg.norm(v @ block[:, inside] - block[:, inside] * e[inside], axis=0)
            if inside.sum() == count and (residual <= tolerance).all():
                return e[inside], block[:, inside]
            y = block
        if size == d:
            raise ArithmeticError(f"{int(inside.sum())} eigenvalues between {low} and {high}, {count} by inertia")
        size = min(d, 2 * size)
        y = np.hstack([block, np.random.default_rng(seed + size).standard_normal((d, size - block.shape[1]))])


def components(spark: SparkSession, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a covariance (fewer where the rest is nought) and their unit vectors as columns.

    Every slice is a task. A last Rayleigh-Ritz step over all slices makes the vectors orthogonal to each other; the
    largest entry of each is positive.
    """
    slices = Spectrum(v).slices(k)
    if not slices:
        return np.empty(0), np.empty((len(v), 0))

    def run(batches):
        for batch in batches:
            for low, high, n in zip(*(c.to_pylist() for c in batch.columns)):
                _, block = feast(v, low, high, n)
                yield pa.RecordBatch.from_arrays([pa.array([low] * n), pa.array(block.T.tolist(), pa.list_(pa.float64()))], ["low", "vector"])

    rows = spark.createDataFrame(slices, "low double, high double, n int").repartition(len(slices)).mapInArrow(run, "low double, vector array<double>")
    block = np.array([r["vector"] for r in rows.sort(F.desc("low")).collect()]).T  # about k vectors of d numbers
    e, block = rayleigh_ritz(v, block)
    e, block = e[:k], block[:, :k]
    return e, block * np.where(block[np.abs(block).argmax(0), np.arange(len(e))] < 0, -1.0, 1.0)


def scaled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a whole vector, and floor(1024 * c) + 100000 of its entries c, a row each.

    Null and empty vectors, and those with an entry that is null or not finite, have none. Vectors of several lengths
    and entries whose number is beyond 2**52 are errors.
    """
    size = np.array([-1 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    values = column.flatten()
    bad = ~np.isfinite(values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
    ends = np.cumsum(np.maximum(size, 0))
    sums = np.concatenate([[0], np.cumsum(bad)])
    good = (size > 0) & (sums[ends] == sums[ends - np.maximum(size, 0)])
    lengths = np.unique(size[good])
    if len(lengths) > 1:
        raise ValueError(f"vectors of several lengths: {lengths.tolist()}")
    if not len(lengths):
        return good, np.empty((0, 0), np.int64)
    c = values.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)[np.repeat(good, np.maximum(size, 0))]
    x = np.floor(SCALE * c)
    if np.abs(x).max() > 2.0**52:
        raise ValueError("an entry is too large for exact sums")
    return good, x.astype(np.int64).reshape(-1, int(lengths[0])) + SHIFT


def exact_gram(y: np.ndarray) -> np.ndarray:
    """Exact sums of products of columns, as whole numbers of any size."""
    most = int(np.abs(y).max()) if y.size else 0
    if most * most * len(y) < 1 << 53:  # sums of doubles are exact so far
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    return y.astype(object).T @ y.astype(object)


def summed(rows: DataFrame, cells: Callable[[np.ndarray], np.ndarray]) -> dict[tuple[int, int], int]:
    """The whole numbers that ``cells`` makes of the scaled vectors, summed exactly over all rows, by dimensions and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, d = None, 0
        for batch in batches:
            _, x = scaled(batch.column(0))
            if not len(x):
                continue
            if total is not None and x.shape[1] != d:
                raise ValueError(f"vectors of several lengths: {sorted((d, x.shape[1]))}")
            part, d = cells(x), x.shape[1]
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["d", "cell", "value"])

    got = batched(rows).mapInArrow(run, "d int, cell int, value decimal(38,0)").groupBy("d", "cell").agg(F.sum("value").alias("value")).collect()  # a row a cell
    return {(r["d"], r["cell"]): int(r["value"]) for r in got}


def moments(rows: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Rows, sums by dimension, and the covariance (divisor: rows), each entry rounded once."""
    first = summed(rows, lambda x: np.concatenate([np.array([len(x)], object), x.astype(object).sum(0)]))
    if not first:
        return 0, [], np.empty((0, 0))
    if len(lengths := {d for d, _ in first}) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(lengths)}")
    d = lengths.pop()
    n, sums = first[d, 0], [first[d, 1 + j] for j in range(d)]
    whole = np.array([s // n for s in sums], np.int64)
    upper = np.triu_indices(d)
    second = summed(rows, lambda x: exact_gram(x - whole)[upper])
    rest = [s % n for s in sums]  # what the whole part of the mean leaves, in n-ths
    v = np.empty((d, d))
    for cell, (i, j) in enumerate(zip(*(u.tolist() for u in upper))):
        v[i, j] = v[j, i] = (n * second[d, cell] - rest[i] * rest[j]) / (n * n)
    return n, sums, v


def identity_error(rows: DataFrame, project: Callable[[np.ndarray], np.ndarray], n: int, k: int) -> float:
    """The largest entry of the covariance of the projected rows less the identity, by size.

    Tasks centre on their own mean before they multiply; moments of tasks are joined by the distance of their means.
    """
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, mean, second = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            _, x = scaled(batch.column(0))
            if len(x):
                w = project(x)
                own, c = w.mean(0), len(w)
                w = w - own
                second += w.T @ w + np.outer(own - mean, own - mean) * (m * c / (m + c))
                mean, m = mean + (own - mean) * (c / (m + c)), m + c
        if m:
            cells = np.concatenate([m * mean, second[upper], m * np.outer(mean, mean)[upper]])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells)], ["cell", "value"])

    got = batched(rows).mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()  # k + k(k+1) rows
    at = {r["cell"]: r["value"] for r in got}
    values = np.array([at[i] for i in range(len(at))])
    mean, inner, between = values[:k] / n, *np.split(values[k:] / n, 2)
    return float(np.abs(inner + between - np.outer(mean, mean)[upper] - np.eye(k)[upper]).max())


def whitened_components(vectors: DataFrame, k: int = 8, column: str = "embedding") -> DataFrame:
    """Every whole vector projected on the leading components, each scaled to variance one.

    Returns vec_id, component (from 1, by falling eigenvalue), n (vectors that the fit is over: all that are left),
    deviation (the sum over dimensions of (n*x - S)**2, exact, as decimal(38,0)), whitened, explained (of the variance)
    and identity_error. Rows without a whole vector are left out (see ``scaled``); null and repeated vec_ids are rows as
    others; other columns are ignored. Components whose variance is nought are left out, so equal vectors alone, one
    vector, or an empty table give no rows. Components of equal eigenvalues are any orthogonal ones of their span.
    """
    spark, rows = vectors.sparkSession, vectors.select(column)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    n, sums, v = moments(rows)
    e, block = components(spark, v, k) if n else (np.empty(0), np.empty((0, 0)))
    k = len(e)
    if not k:
        return spark.createDataFrame([], schema)
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], object)
    share, scale = np.array([r / n for r in rest]), block / np.sqrt(e)
    project = lambda x: ((x - whole) - share) @ scale
    error = identity_error(rows, project, n, k)
    explained, squared = e / np.trace(v), int((rest * rest).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = scaled(batch.column(1))
            if not len(x):
                continue
            y = (x - whole).astype(object)
            deviation = n * n * (y * y).sum(1) - 2 * n * (y @ rest) + squared
            m = len(x)
            each = np.repeat(np.arange(m), k)
            cols = [
                batch.column(0).take(pa.array(np.flatnonzero(good)[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array([Decimal(int(t)) for t in deviation], pa.decimal128(38, 0)).take(pa.array(each)),
                pa.array(project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return batched(vectors.select("vec_id", column)).mapInArrow(run, schema)
