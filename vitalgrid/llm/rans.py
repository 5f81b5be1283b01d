"""Token-ID output (operator 11): static range asymmetric numeral systems over one shared frequency table.

The format is a folder of three tables, so any file system that Spark reaches holds it and files commit as Spark's do:

- ``frequencies``: id, frequency. The frequencies sum to ``2**SCALE_BITS``; every id that occurs has one or more.
- ``blocks``: one row a block of at most ``BLOCK_IDS`` ids, of one part: ``part``, ``first`` (ids of the part before
  the block), ``n``, ``checkpoints``, ``payload``, ``crc32`` (of the payload), and the pieces of documents in it:
  ``docs`` (ids), ``doc_starts`` (ids of the part before the document) and ``lengths`` (ids in this block).
- ``parts``: part, start (ids of all parts before it), n. Parts are in ascending order of documents, as are blocks by
  ``(part, first)``.

A block is cut into segments of ``SEGMENT_IDS`` ids. A segment is coded by ``LANES`` interleaved coders: id k belongs
to lane k mod lanes. States are 64 bits and give off 32-bit words; all lanes of a segment share one stream of words.
A checkpoint holds where a segment's words begin and the states from which its lanes are decoded, so segments, too, are
decoded independently: a reader of a few ids reads one segment, a reader of a block decodes its segments side by side.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_dir
from .bytebpe import byte_ids
from .common import batched, begin_task, discard, materialise, texts_of
from .packing import shift_tables

SCALE_BITS = 20
SEGMENT_IDS = 1 << 16
BLOCK_IDS = 1 << 20
LANES = 256
_LOW = np.uint64(1 << 31)
_HEAD = np.dtype([("n", "<u4"), ("lanes", "<u4"), ("words", "<u4")])


def normalised(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, in proportion to the counts, one at least for each id that occurs."""
    total, whole = int(counts.sum()), 1 << bits
    some = np.flatnonzero(counts)
    if len(some) > whole:
        raise ValueError(f"more than {whole} different ids")
    out = np.zeros(len(counts), np.int64)
    if not total:
        return out
    share = counts[some].astype(np.float64) / total * whole
    out[some] = np.maximum(1, np.floor(share))
    gap = whole - int(out.sum())
    if gap > 0:  # to the ids that lost most by rounding
        best = some[np.argsort(np.floor(share) - share, kind="stable")]
        out[best[: gap % len(best)]] += 1
        out[best] += gap // len(best)
    while gap < 0:  # from the frequent ones, by their size
        over = np.flatnonzero(out > 1)
        take = np.minimum(out[over] - 1, np.maximum(1, out[over] * -gap // int(out[over].sum())))
        order = np.argsort(-out[over], kind="stable")
        take = np.where(np.cumsum(take[order]) <= -gap, take[order], 0)
        if not take.any():
            take[0] = 1
        out[over[order]] -= take
        gap += int(take.sum())
    return out


class Coder:
    """Encodes and decodes segments with one frequency table."""

    def __init__(self, frequency: np.ndarray, bits: int = SCALE_BITS):
        self.bits = np.uint64(bits)
        self.mask = np.uint64((1 << bits) - 1)
        self.frequency = frequency.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(frequency)[:-1]]).astype(np.uint64)
        self._symbol: np.ndarray | None = None
        self.limit = self.frequency << np.uint64(63 - bits)

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.frequency), dtype=np.int32), self.frequency.astype(np.int64))
        return self._symbol

    def encode(self, ids: np.ndarray, lanes: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """States (segments x lanes) and the words of each row of ``ids`` (segments x ids), all equally long."""
        rows, n = ids.shape
        x = np.full((rows, lanes), _LOW)
        got: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range((n - 1) // lanes * lanes, -1, -lanes):
            s = ids[:, at : at + lanes]
            y = x[:, : s.shape[1]]
            full = y >= self.limit[s]
            got.append((np.count_nonzero(full, axis=1), y[full].astype(np.uint32)))
            y = np.where(full, y >> np.uint64(32), y)
            f = self.frequency[s]
            q = y // f
            x[:, : s.shape[1]] = (q << self.bits) + (y - q * f) + self.start[s]
        got.reverse()
        counts = np.array([c for c, _ in got])
        words = np.concatenate([w for _, w in got])
        owner = np.repeat(np.tile(np.arange(rows), len(got)), counts.ravel())
        return x, [words[owner == r] for r in range(rows)] if rows > 1 else [words]

    def decode(self, states: np.ndarray, words: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
        """``n`` ids of each row of ``states``, whose words begin at ``begin`` among ``words``."""
        rows, lanes = states.shape
        x, at = states.copy(), begin.astype(np.int64)
        out = np.empty((rows, n), np.int32)
        for k in range(0, n, lanes):
            y = x[:, : min(lanes, n - k)]
            slot = y & self.mask
            s = self.symbol[slot]
            out[:, k : k + lanes] = s
            y = self.frequency[s] * (y >> self.bits) + slot - self.start[s]
            low = y < _LOW
            nth = np.cumsum(low, axis=1)
            where = (at[:, None] + nth - 1)[low]
            if len(where) and (where[-1] >= len(words) or where.max() >= len(words)):
                raise ValueError("a block ends within a segment")
            y[low] = (y[low] << np.uint64(32)) | words[where]
            at += nth[:, -1]
            x[:, : y.shape[1]] = y
        return out


def lanes_of(n: int) -> int:
    """Interleaved coders of a segment: fewer for short ones, as each costs eight bytes."""
    return min(LANES, 1 << max(0, (n // 64).bit_length() - 1)) if n >= 128 else 1


def encode_block(coder: Coder, ids: np.ndarray) -> tuple[bytes, bytes]:
    """Checkpoints and payload of a block."""
    heads, states, words = [], [], []
    whole = len(ids) // SEGMENT_IDS
    for part in (ids[: whole * SEGMENT_IDS].reshape(whole, SEGMENT_IDS), ids[None, whole * SEGMENT_IDS :]):
        if part.size:
            lanes = lanes_of(part.shape[1])
            x, w = coder.encode(part, lanes)
            heads += [(part.shape[1], lanes, len(y)) for y in w]
            states += list(x)
            words += w
    return np.array(heads, _HEAD).tobytes() + b"".join(s.astype("<u8").tobytes() for s in states), b"".join(w.astype("<u4").tobytes() for w in words)


def decode_block(coder: Coder, checkpoints: bytes, payload: bytes, n: int, crc32: int, low: int = 0, high: int | None = None) -> np.ndarray:
    """The ids of a block from ``low`` to ``high``: only the segments that hold them are decoded.

    A payload that does not meet its checksum is an error, as is one that ends too early.
    """
    if zlib.crc32(payload) != crc32:
        raise ValueError("the checksum of a block does not hold")
    segments = -(-n // SEGMENT_IDS)
    head = np.frombuffer(checkpoints, _HEAD, segments)
    states = np.frombuffer(checkpoints, "<u8", offset=segments * _HEAD.itemsize)
    words = np.frombuffer(payload, "<u4").astype(np.uint64)
    begin = np.concatenate([[0], np.cumsum(head["words"].astype(np.int64))])
    first = np.concatenate([[0], np.cumsum(head["lanes"].astype(np.int64))])
    high = n if high is None else min(high, n)
    if high <= low:
        return np.empty(0, np.int32)
    a, b = low // SEGMENT_IDS, -(-high // SEGMENT_IDS)
    full = np.flatnonzero(head["n"][a:b] == SEGMENT_IDS) + a
    out = []
    if len(full):
        lanes = int(head["lanes"][full[0]])
        out.append(coder.decode(states[first[a] : first[a] + len(full) * lanes].reshape(len(full), lanes), words, begin[full], SEGMENT_IDS).ravel())
    if len(full) < b - a:
        out.append(coder.decode(states[first[b - 1] : first[b]][None], words, begin[b - 1 : b], int(head["n"][b - 1])).ravel())
    return np.concatenate(out)[low - a * SEGMENT_IDS : high - a * SEGMENT_IDS]


def crc_pieces(crcs: list[int], lengths: list[int]) -> int:
    """The CRC-32 of byte strings in turn from their own."""
    out = crcs[0]
    for crc, n in zip(crcs[1:], lengths[1:]):
        t = shift_tables_of(n)
        out = int(t[0][out & 255] ^ t[1][(out >> 8) & 255] ^ t[2][(out >> 16) & 255] ^ t[3][out >> 24]) ^ crc
    return out


def shift_tables_of(n: int) -> np.ndarray:
    """``shift_tables`` of any number of bytes, from those of powers of two."""
    if n <= 4096:
        return shift_tables(n)
    out = None
    for k in range(n.bit_length()):
        if n >> k & 1:
            while len(_doubled) <= k:
                t = _doubled[-1]
                _doubled.append(_then(t, t))
            out = _doubled[k] if out is None else _then(out, _doubled[k])
    return out


def _then(t: np.ndarray, u: np.ndarray) -> np.ndarray:
    return u[0][t & 255] ^ u[1][(t >> 8) & 255] ^ u[2][(t >> 16) & 255] ^ u[3][t >> 24]


_doubled: list[np.ndarray] = [shift_tables(1)]


def ordered_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """part, doc_id, start (ids of the part before it) and ids (two bytes each) of every document, in parts by id.

    Texts are ranged by id before they are encoded: rows of one id are told apart by their text's hash, then by their
    place, so that no id is too frequent for a range.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        begin_task("bytebpe")
        machine, part, total = byte_ids(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            doc = batch.column(batch.schema.get_field_index("doc_id"))
            for row, texts in machine.of_texts(texts_of(batch)):
                ids = [np.append(x, end_id).astype("<u2").tobytes() for x in texts]
                stops = total + np.cumsum([len(x) // 2 for x in ids])
                starts, total = np.append(total, stops[:-1]), int(stops[-1])
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), doc.slice(row, len(ids)), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], ["part", "doc_id", "start", "ids"])

    order = (F.col("doc_id").asc_nulls_first(), F.col("text_hash"))
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    return materialise(batched(ranged.select("doc_id", "text")).mapInArrow(run, f"part int, doc_id {kind}, start long, ids binary"))


def id_counts(rows: DataFrame, width: int) -> np.ndarray:
    """How often each id occurs: one number for each id of the vocabulary, summed by Spark."""

    def run(batches):
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=width)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["id", "count"])

    out = np.zeros(width, np.int64)
    for r in batched(rows.select("ids")).mapInArrow(run, "id int, count long").groupBy("id").agg(F.sum("count").alias("count")).collect():
        out[r["id"]] = r["count"]
    return out


def write_ids(docs: DataFrame, at: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> None:
    """Write the ids of every whole text, ``end_id`` after each, to the folder ``at`` by ascending doc_id.

    Null texts are empty: ``end_id`` alone. Null ids come first; rows of one id are each written, in the order of their
    texts' hashes. Other columns are ignored. An empty table gives tables without rows. The vocabulary may have up to
    65,536 ids.
    """
    from tokenizers import Tokenizer

    spark, path = docs.sparkSession, public_tokenizers.path(tokenizer)
    width = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1)
    if width > 1 << 16:
        raise ValueError("ids of two bytes are written; the vocabulary has more")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = ordered_ids(docs, path, end_id)
    frequency = normalised(id_counts(rows, width))
    spark.createDataFrame([(int(i), int(frequency[i])) for i in np.flatnonzero(frequency)], "id int, frequency int").coalesce(1).write.parquet(f"{at}/frequencies")

    def run(batches):
        begin_task("rans")
        coder, part = Coder(frequency), None
        block: list[tuple[pa.Array, int, int, np.ndarray]] = []  # doc_id, its start, start of the piece, ids
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal block, held
            docs, starts, firsts, pieces = zip(*block)
            checkpoints, payload = encode_block(coder, np.concatenate(pieces))
            listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            cols = [pa.array([part], pa.int32()), pa.array([firsts[0]], pa.int64()), pa.array([held], pa.int64()), pa.array([checkpoints], pa.binary()), pa.array([payload], pa.binary()), pa.array([zlib.crc32(payload)], pa.int64())]
            cols += [listed(pa.concat_arrays(docs)), listed(pa.array(starts, pa.int64())), listed(pa.array(list(map(len, pieces)), pa.int64()))]
            block, held = [], 0
            return pa.RecordBatch.from_arrays(cols, BLOCK_COLUMNS)

        for batch in batches:
            parts, doc, starts = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            for i, x in enumerate(batch.column(3)):
                if block and parts[i] != part:
                    yield close()
                part, ids, a = parts[i], np.frombuffer(x.as_buffer(), "<u2"), 0
                while a < len(ids):
                    piece = ids[a : a + BLOCK_IDS - held]
                    block.append((doc.slice(i, 1), starts[i], starts[i] + a, piece))
                    held, a = held + len(piece), a + len(piece)
                    if held == BLOCK_IDS:
                        yield close()
        if block:
            yield close()

    schema = f"part int, first long, n long, checkpoints binary, payload binary, crc32 long, docs array<{kind}>, doc_starts array<long>, lengths array<long>"
    batched(rows).mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(f"{at}/blocks")
    discard(rows)
    sizes = spark.read.parquet(f"{at}/blocks").groupBy("part").agg(F.sum("n").alias("n"))  # a row a part: as many as tasks
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n").write.parquet(f"{at}/parts")


BLOCK_COLUMNS = ["part", "first", "n", "checkpoints", "payload", "crc32", "docs", "doc_starts", "lengths"]


def read_coder(spark: SparkSession, at: str) -> Coder:
    """The coder of the files in ``at``."""
    rows = spark.read.parquet(f"{at}/frequencies").collect()  # at most one row an id of the vocabulary
    frequency = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        frequency[r["id"]] = r["frequency"]
    return Coder(frequency)


def _pieces(spark: SparkSession, at: str, yields, schema: str) -> DataFrame:
    """A row for each piece of a document in each block: part, first (of the block), doc_id, doc_start, length and what ``yields`` makes of its ids."""
    coder, blocks = read_coder(spark, at), spark.read.parquet(f"{at}/blocks")
    kind = blocks.schema["docs"].dataType.elementType.simpleString()

    def run(batches):
        begin_task("rans")
        for batch in batches:
            for b in range(batch.num_rows):
                part, first, n, checkpoints, payload, crc = (batch.column(k)[b].as_py() for k in range(6))
                ids = decode_block(coder, checkpoints, payload, n, crc)
                docs, starts, lengths = (batch.column(k)[b].values for k in (6, 7, 8))
                size = lengths.to_numpy()
                stops = np.cumsum(size)
                k = len(size)
                yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array([first] * k, pa.int64()), docs, starts, lengths, yields(ids, stops - size, stops)], ["part", "first", "doc_id", "doc_start", "length", "got"])

    return batched(blocks.select(*BLOCK_COLUMNS)).mapInArrow(run, f"part int, first long, doc_id {kind}, doc_start long, length long, got {schema}")


def read_ids(spark: SparkSession, at: str) -> DataFrame:
    """part, first (of the block), doc_id, doc_start, length and got: the ids of every piece of a document in a block."""
    return _pieces(spark, at, lambda ids, a, b: pa.ListArray.from_arrays(pa.array(np.append(a, len(ids)), pa.int32()), pa.array(ids)), "array<int>")


def read_range(spark: SparkSession, at: str, part: int, low: int, high: int) -> np.ndarray:
    """The ids of a part from ``low`` to ``high``: of the blocks that hold them only these segments are decoded."""
    coder = read_coder(spark, at)
    blocks = spark.read.parquet(f"{at}/blocks").where((F.col("part") == part) & (F.col("first") < high) & (F.col("first") + F.col("n") > low))
    rows = blocks.select("first", "n", "checkpoints", "payload", "crc32").orderBy("first").toLocalIterator()
    return np.concatenate([np.empty(0, np.int32), *(decode_block(coder, r["checkpoints"], r["payload"], r["n"], r["crc32"], max(0, low - r["first"]), high - r["first"]) for r in rows)])


def read_digests(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files in ``at``.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is of its ids as little-endian unsigned 32-bit
    integers. Pieces of a document that lies in several blocks are put together by their own sums.
    """
    pieces = _pieces(spark, at, lambda ids, a, b: pa.array((lambda raw: [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist())])(ids.astype("<u4").tobytes()), pa.int64()), "long")
    kind = pieces.schema["doc_id"].dataType.simpleString()
    whole = pieces.groupBy("part", "doc_start").agg(F.first("doc_id").alias("doc_id"), F.sum("length").alias("n"), F.sort_array(F.collect_list(F.struct("first", "got", "length"))).alias("p"))
    starts = spark.read.parquet(f"{at}/parts").select("part", F.col("start").alias("before"))  # a row a part
    placed = whole.join(starts, "part").select("doc_id", (F.col("before") + F.col("doc_start")).alias("start"), F.col("n").alias("n_tokens"), F.col("p.got").alias("crcs"), F.col("p.length").alias("sizes"))

    def run(batches):
        for batch in batches:
            crc = [crc_pieces(c, [4 * x for x in n]) for c, n in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """Write the ids of ``docs`` to the shared folder and read their digests back from the files; see ``write_ids``."""
    at = f"{shared_dir(docs.sparkSession)}/{uuid.uuid4().hex}"
    write_ids(docs, at, tokenizer, end_id)
    return read_digests(docs.sparkSession, at)
