"""What the training-data operators share: reading, shared-folder tables, and vectorised words and hashes.

A text is handled as UTF-8 bytes. A word is a maximal run of bytes other than space and
U+0009 to U+000D, so multi-byte characters are never cut. Hashes are 64 bits: random byte
values in a polynomial modulo 2**64, then mixed; every task draws the same values.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

# Freed arrays go back to the system at once: glibc otherwise keeps ever larger blocks in worker processes.
with contextlib.suppress(OSError, AttributeError):
    ctypes.CDLL(None).mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
# So do Arrow's buffers, where their own allocator would keep them.
pa.set_memory_pool(pa.system_memory_pool())

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 2**64))
_Q = np.uint64(0xD1342543DE82EF95)
_powers: dict[str, np.ndarray] = {}

#: Bytes of text that one vectorised step takes at most, unless a single text is longer.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """While it holds, an execution's shuffle files go when it ends: what it wrote is read instead."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    at = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    with shuffles_end(df.sparkSession):
        df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    _paths[out] = at
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more; other frames are left alone."""
    for df in tables:
        if at := _paths.pop(df, None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def batched(df: DataFrame, rows: int = 1000, size: int = 4 << 20) -> DataFrame:
    """``df``, after telling its session to hand Python so many rows and bytes at a time at most: texts may be long."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df


#: What worker processes keep between tasks, by operator, and how to let go of it.
KEPT: dict[str, Callable[[], None]] = {}


def begin_task(kind: str) -> None:
    """Let go of what other operators' tasks have left in this worker process: it outlives them."""
    for k, drop in KEPT.items():
        if k != kind:
            drop()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.cumprod(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Texts:
    """Some texts of a batch as one byte array, with words and hashes on demand."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = buf, offsets.astype(np.int64)
        self.n = len(offsets) - 1
        space = SPACE[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[self.offsets] = True
        before = np.empty(len(buf), bool)
        after = np.empty(len(buf), bool)
        if len(buf):
            before[0], before[1:] = True, space[:-1]
            after[-1], after[:-1] = True, space[1:]
        self.space = space
        self.starts = np.flatnonzero(~space & (before | edge[:-1]))
        self.ends = np.flatnonzero(~space & (after | edge[1:])) + 1
        #: the first word of each text, and after the last text the number of words
        self.first = np.searchsorted(self.starts, self.offsets)
        self.words = np.diff(self.first)
        self._sums: np.ndarray | None = None

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.words)

    def count(self, mask: np.ndarray) -> np.ndarray:
        """How often a mask over the bytes holds in each text."""
        sums = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return np.diff(sums[self.offsets])

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges."""
        if self._sums is None:
            n = len(self.buf)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.buf] * _power("r", _R, n), out=self._sums[1:])
        raw = (self._sums[ends] - self._sums[starts]) * _power("inv", _R_INV, len(self.buf) + 1)[starts]
        return mix(raw + (ends - starts).astype(np.uint64))

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


def window_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive words at each position that starts such a window in the array."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, size):
        h *= _Q
        h += words[j : j + n]
    return mix(h)


def window_starts(texts: Texts, size: int) -> np.ndarray:
    """Positions among all words at which a window of ``size`` words lies within one text."""
    at = np.arange(max(0, len(texts.starts) - size + 1))
    if not len(at):
        return at
    last = np.repeat(texts.first[1:], texts.words)[: len(at)]
    return at[at + size <= last]


def steps(column: pa.Array, lower: bool = False, most: int = STEP_BYTES) -> Iterator[tuple[int, Texts]]:
    """A string column (nulls as empty) in steps of bounded bytes: the first row, and the texts from there."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        buf = data[offsets[row] : offsets[end]]
        yield row, Texts(LOWER[buf] if lower else buf, offsets[row : end + 1] - offsets[row])
        row = end


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    col = batch.column(batch.schema.get_field_index(column))
    return col.cast(pa.string()) if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)) else col


def compress(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x)


def expand(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def pack_ints(*columns: np.ndarray) -> bytes:
    """Integer columns as compressed bytes: all first bytes of a column, then all second bytes, and so on."""
    head = np.array([x for c in columns for x in (len(c), c.dtype.itemsize)], np.int64)
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(-1, c.dtype.itemsize).T).tobytes() for c in columns]
    return compress(b"".join([head.tobytes(), *planes]))


def unpack_ints(packed: bytes, columns: int) -> list[np.ndarray]:
    raw = expand(packed)
    head, at, out = np.frombuffer(raw, np.int64, 2 * columns).reshape(-1, 2), 16 * columns, []
    for n, size in head.tolist():
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"i{size}"))
        at += n * size
    return out
