"""N-gram Jaccard join (operator 7): an exact set-similarity join that skips by set relations.

Equal sets are one class from the start. For the rest the prefix index of a global token
order is used: two sets of similarity t share one of their rarest (1 - t) n + 1 tokens. The order is by the
number of classes that have a token. To count it, the tokens of a batch of texts travel packed to the bucket of their first
bits, and one byte a token comes back to the batch; so nothing is broadcast, and a token that no other class has,
as most have not, never enters the index.

Index level: a list's entries are blocked by set size and position, and a block is skipped, in whole or from some
position on, as soon as sizes or positions rule the overlap out. Short lists give candidate pairs, long ones tie their members to the
first. The components of either are groups; each set travels once to its group's block, where
a set's overlaps with all others are derived from the known overlaps of the most similar set seen:
take the postings of what it lacks, add those of what it has more. Only links that join two
components leave a block, so no group gives all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, batched, begin_task, compress, discard, expand, materialise, mix, pack_ints, shuffle_width, steps, unpack_ints, window_hash
from .components import connected_components

#: Entries of a list that gives its candidates directly.
SHORT_LIST = 24
#: Index entries of a bucket of lists, and distinct tokens of a bucket that are counted together, about.
BUCKET_ENTRIES, COUNT_TOKENS = 200_000, 1 << 20
#: Sets of a block of a large group.
BLOCK_SETS = 2048
#: Tokens of a bucket of small groups, about.
BUCKET_TOKENS = 500_000
#: Tokens of a block.
BLOCK_TOKENS = 1_500_000
#: A batch's texts at most; a set's number is its batch's, times this, and its place there.
BATCH_ROWS = 1 << 11


def shingle_sets(t: Texts, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; the whole sequence if it is shorter; empty without words."""
    words = t.word_hash()
    h = window_hash(words, k)
    out = []
    for i in range(t.n):
        a, b = int(t.first[i]), int(t.first[i + 1])
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            out.append(window_hash(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def prefix_length(n: int, percent: int) -> int:
    """How many of n tokens in global order a partner of the similarity must share one of."""
    return n - -(-percent * n // 100) + 1 if n else 0


def least_overlap(a, b, percent: int):
    """Smallest overlap of sets of these sizes at the similarity."""
    return -(-percent * (a + b) // (100 + percent))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from others, with its size."""
    if not len(s):
        return 0, 0
    return int(s.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(len(s)))).astype(np.int64))


def _pack_texts(buf: np.ndarray, offsets: np.ndarray) -> bytes:
    return compress(np.concatenate([[len(offsets)], offsets]).astype(np.int64).tobytes() + buf.tobytes())


def _open_texts(packed: bytes, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of packed texts, or of those at some places of them."""
    raw = expand(packed)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    buf, offsets = np.frombuffer(raw, np.uint8, -1, 8 * (n + 1)), np.frombuffer(raw, np.int64, n, 8)
    if places is None or len(places) == n - 1:
        return buf, offsets
    return np.concatenate([buf[:0], *(buf[offsets[i] : offsets[i + 1]] for i in places.tolist())]), np.concatenate([[0], np.cumsum(np.diff(offsets)[places])])


def set_batches(docs: DataFrame, k: int) -> DataFrame:
    """Batches of texts, packed in lower case, with the ids of the rows and each set's size and 128-bit key; written once."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches):
        begin_task("jaccard")
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                for row, t in steps(part.column(1), lower=True):
                    sets = shingle_sets(t, k)
                    keys = [set_key(s) for s in sets]
                    one = pa.array([0, t.n], pa.int32())
                    columns = [part.column(0).slice(row, t.n), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in keys], pa.int64()), pa.array([y for _, y in keys], pa.int64())]
                    lists = [pa.ListArray.from_arrays(one, c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c) for c in columns]
                    yield pa.RecordBatch.from_arrays([*lists, pa.array([_pack_texts(t.buf, t.offsets)], pa.binary())], ["ids", "n", "k1", "k2", "texts"])

    rows = docs.select("doc_id", "text").mapInArrow(read, f"ids array<{kind}>, n array<long>, k1 array<long>, k2 array<long>, texts binary")
    number = F.monotonically_increasing_id()
    return materialise(rows.withColumn("batch", F.shiftleft(F.shiftright(number, 33), 20) + number.bitwiseAND((1 << 33) - 1)))


def _only(batches: DataFrame, wanted: DataFrame) -> DataFrame:
    """(batch, pos, texts) of the texts that ``wanted`` (batch, pos) names; ``pos`` is their places in the batch."""
    places = wanted.groupBy("batch").agg(F.sort_array(F.collect_list("pos")).alias("pos"))  # a batch has a bounded number

    def take(rows):
        begin_task("jaccard")
        for batch in rows:
            for i in range(batch.num_rows):
                packed = _pack_texts(*_open_texts(batch.column(2)[i].as_py(), batch.column(1)[i].values.to_numpy()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([packed], pa.binary())], ["batch", "pos", "texts"])

    return batches.join(places, "batch").select("batch", "pos", "texts").mapInArrow(take, "batch long, pos array<int>, texts binary")


def _sets(rows) -> Iterator[tuple[pa.RecordBatch, int, Texts]]:
    """Each row of batches of texts, with the texts."""
    begin_task("jaccard")
    for batch in rows:
        texts = batch.column(batch.schema.get_field_index("texts"))
        for i in range(batch.num_rows):
            yield batch, i, Texts(*_open_texts(texts[i].as_py()))


def _count_code(n: np.ndarray) -> np.ndarray:
    """A count as one byte: exact below 128, then by steps of an eighth of a doubling."""
    return np.where(n < 128, n, np.minimum(255, 72 + np.floor(8 * np.log2(np.maximum(n, 1))))).astype(np.uint8)


def token_counts_of(texts: DataFrame, k: int, tokens: int) -> DataFrame:
    """(batch, counts): for the distinct tokens of each batch, in order, how many sets of all have them, as a byte.

    A token is taken for another only if their first bits, 32 more than the buckets need, agree; the count is then too high, which costs
    work but loses nothing.
    """
    bits = int(np.clip(np.ceil(np.log2(max(tokens, 1) / COUNT_TOKENS)), 4, 24))

    def send(rows):
        for batch, i, t in _sets(rows):
            token, count = np.unique(np.concatenate(shingle_sets(t, k)), return_counts=True)
            bucket = (token >> np.uint64(64 - bits)).astype(np.int64)
            rest = ((token >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(token) else np.empty(0, np.int64)
            packed = []
            for x, y in zip(cuts.tolist(), np.append(cuts[1:], len(token)).tolist()):
                packed.append(pack_ints(np.diff(rest[x:y], prepend=0).astype(np.uint32), np.minimum(count[x:y], 255).astype(np.uint8)))
            own = np.repeat(batch.column(0)[i].as_py(), len(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(bucket[cuts].astype(np.int32)), pa.array(packed, pa.binary())], ["batch", "bucket", "tokens"])

    def add(group: pa.Table) -> pa.Table:
        parts = [unpack_ints(x, 2) for x in group.column("tokens").to_pylist()]
        token = np.concatenate([np.cumsum(x.view(np.uint32), dtype=np.uint64) for x, _ in parts])
        order = np.argsort(token, kind="stable")
        new = np.append(True, token[order][1:] != token[order][:-1])
        total = np.add.reduceat(np.concatenate([y.view(np.uint8) for _, y in parts]).astype(np.int64)[order], np.flatnonzero(new))
        code = np.empty(len(token), np.uint8)
        code[order] = _count_code(total)[np.cumsum(new) - 1]
        ends = np.cumsum([len(x) for x, _ in parts])
        return pa.table([group.column("batch"), group.column("bucket"), pa.array([compress(c.tobytes()) for c in np.split(code, ends[:-1])], pa.binary())], names=["batch", "bucket", "codes"])

    sent = texts.select("batch", "texts").mapInArrow(send, "batch long, bucket int, tokens binary")
    back = materialise(sent.groupBy("bucket").applyInArrow(add, "batch long, bucket int, codes binary"))
    return back.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "codes"))), lambda x: x["codes"]).alias("codes"))


def index_entries(texts: DataFrame, counts: DataFrame, k: int, percent: int) -> DataFrame:
    """(token, cid, n, pos) of the tokens in each set's prefix that other sets have too."""

    def entries(rows):
        for batch, i, t in _sets(rows):
            sets = shingle_sets(t, k)
            token, owner, size = np.concatenate(sets), np.repeat(np.arange(t.n), [len(s) for s in sets]), np.array([len(s) for s in sets])
            distinct, which = np.unique(token, return_inverse=True)
            code = np.frombuffer(b"".join(expand(x) for x in batch.column(1)[i].as_py()), np.uint8)[which]
            order = np.lexsort((token, code, owner))
            pos = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            prefix = np.array([prefix_length(int(n), percent) for n in size])
            go = (pos < prefix[owner]) & (code[order] > 1)
            first = (batch.column(0)[i].as_py()) * BATCH_ROWS
            cid = first + batch.column(2)[i].values.to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token[order][go].view(np.int64)), pa.array(cid[owner[go]]), pa.array(size[owner[go]].astype(np.int32)), pa.array(pos[go].astype(np.int32))], ["token", "cid", "n", "pos"])

    return texts.join(counts, "batch").select("batch", "codes", "pos", "texts").mapInArrow(entries, "token long, cid long, n int, pos int")


def list_pairs(which: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries (i, j), j no smaller a set, of lists sorted by size and position, that sizes and positions allow.

    A block is a list's entries of one size. For an entry only blocks of fitting sizes are looked at, and of a block
    only the positions up to the last at which the rest of both sets can still give the overlap; what lies behind is skipped.
    """
    none = np.empty(0, np.int64)
    if not len(which):
        return none, none
    new = np.append(True, (which[1:] != which[:-1]) | (n[1:] != n[:-1]))
    start = np.flatnonzero(new)
    stop, block = np.append(start[1:], len(n)), np.cumsum(new) - 1
    wide = int(n.max()) + 2
    key = which[start] * wide + n[start]
    high = np.searchsorted(key, which * wide + np.minimum(100 * n // percent, wide - 1), "right")
    many = high - block
    i = np.repeat(np.arange(len(n)), many)
    b = np.repeat(block - np.cumsum(many) + many, many) + np.arange(many.sum())
    size = n[start[b]]
    need = least_overlap(n[i], size, percent)
    go = n[i] - pos[i] >= need
    i, b, size, need = i[go], b[go], size[go], need[go]
    deep = int(pos.max()) + 2
    to = np.searchsorted(block * deep + pos, b * deep + np.clip(size - need, -1, deep - 1), "right")
    at = np.maximum(start[b], i + 1)  # of a block of its own size only what follows
    many = np.maximum(to - at, 0)
    return np.repeat(i, many), np.repeat(at - np.cumsum(many) + many, many) + np.arange(many.sum())


def candidates(entries: DataFrame, percent: int, buckets: int, short: int = SHORT_LIST) -> DataFrame:
    """(kind, a, b) of sets: kind 0 are candidate pairs of short lists, kind 1 ties the members of a long list to its first.

    Lists meet in buckets of their tokens.
    """

    def meet(group: pa.Table) -> pa.Table:
        token, cid, n, pos = (group.column(c).to_numpy().astype(np.int64) for c in ("token", "cid", "n", "pos"))
        order = np.lexsort((cid, pos, n, token))
        token, cid, n, pos = token[order], cid[order], n[order], pos[order]
        new = np.append(True, token[1:] != token[:-1])
        begin, which = np.flatnonzero(new), np.cumsum(new) - 1
        long = np.diff(np.append(begin, len(token)))[which] > short
        tied = long & ~new
        i, j = (np.flatnonzero(~long)[x] for x in list_pairs(which[~long], n[~long], pos[~long], percent))
        a, b = np.concatenate([cid[i], cid[begin[which[tied]]]]), np.concatenate([cid[j], cid[tied]])
        kind = np.concatenate([np.zeros(len(i), np.int64), np.ones(len(b) - len(i), np.int64)])
        found = np.unique(np.stack([kind, np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.table([pa.array(found[:, 0].astype(np.int32)), pa.array(found[:, 1]), pa.array(found[:, 2])], names=["kind", "a", "b"])

    # A token of many sets is split: each part ties its members to its first, and firsts travel on.
    many = entries.groupBy("token").count().where(F.col("count") > short)
    heavy = entries.join(many.select("token"), "token", "left_semi")
    first = heavy.groupBy("token").agg(F.min("cid").alias("a"))
    ties = heavy.join(first, "token").where("cid <> a").select(F.lit(1).alias("kind"), "a", F.col("cid").alias("b"))
    light = entries.join(many.select("token"), "token", "left_anti")
    met = light.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(meet, "kind int, a long, b long")
    return met.union(ties).distinct()


class Forest:
    """Union-find over the rows of a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def links_of_block(sets: list[np.ndarray], percent: int, known: list[int] | None = None, ask: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among sets that join components: a spanning forest of them.

    ``known`` are components that the sets are in already; ``ask`` marks the sets whose partners are
    wanted, else all. A set's overlap counts come from those of a leader that resembles it, by the
    tokens in which they differ; from nothing only if no leader does, and then it becomes one.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n < 2:
        return []
    value, local = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(local, kind="stable")
    posting, begin = np.repeat(np.arange(n), size)[order], np.concatenate([[0], np.cumsum(np.bincount(local, minlength=len(value)))])
    own = np.split(local, np.cumsum(size)[:-1])
    forest, out = Forest(n), []
    if known is not None:
        first: dict[int, int] = {}
        for i, c in enumerate(known):
            forest.union(first.setdefault(c, i), i)
    leaders: list[tuple[int, np.ndarray]] = []

    def gather(which: np.ndarray) -> np.ndarray:
        if not len(which):
            return np.zeros(n, np.int64)
        return np.bincount(np.concatenate([posting[begin[w] : begin[w + 1]] for w in which.tolist()]), minlength=n)

    for x in np.argsort(size, kind="stable").tolist():
        if ask is not None and not ask[x]:
            continue
        near = max(leaders, key=lambda y: y[1][x] / (size[y[0]] + size[x]), default=None)
        if near is not None and 2.5 * near[1][x] > size[near[0]] + size[x] - near[1][x]:
            other = own[near[0]]
            counts = near[1] - gather(np.setdiff1d(other, own[x], assume_unique=True)) + gather(np.setdiff1d(own[x], other, assume_unique=True))
        else:
            counts = gather(own[x])
            leaders.append((x, counts))
            if len(leaders) > 16:
                leaders.pop(0)
        hit = 100 * counts >= percent * (size[x] + size - counts)
        hit[x] = False
        for y in np.flatnonzero(hit).tolist():
            if forest.union(x, y):
                out.append((x, y))
    return out


def _link_groups(rows: DataFrame, keys: list[str], percent: int, buckets: int) -> DataFrame:
    """Links (a, b) found within groups of rows (cid, set, comp, ask); rows may repeat.

    Most groups have a few sets, so a task takes a bucket of groups at a time.
    """

    def link(bucket: pa.Table) -> pa.Table:
        members: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(*(bucket.column(c).to_pylist() for c in keys))):
            members.setdefault(k, []).append(i)
        cid, comp, ask, sets = (bucket.column(c) for c in ("cid", "comp", "ask", "set"))
        cid, comp, ask = cid.to_pylist(), comp.to_pylist(), ask.to_numpy()
        a, b = [], []
        for at in members.values():
            if len(at) < 2:
                continue
            got = links_of_block([np.frombuffer(sets[i].as_py(), np.uint64) for i in at], percent, [comp[i] for i in at], ask[at])
            a += [cid[at[x]] for x, _ in got]
            b += [cid[at[y]] for _, y in got]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    keyed = rows.select(*keys, "cid", "set", "comp", "ask", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket"))
    return keyed.groupBy("bucket").applyInArrow(link, "a long, b long")


def _place(groups: DataFrame, sizes: DataFrame, block_sets: int, block_tokens: int) -> DataFrame:
    """(cid, grp, blocks, block): blocks so that each holds a bounded number of sets and tokens."""
    rows = groups.join(sizes, "cid")
    width = rows.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") / block_tokens)).cast("int").alias("blocks"))
    return rows.join(width, "grp").select("cid", "grp", "blocks", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block"))


def _grouped_links(placed: DataFrame, percent: int, block_sets: int, buckets: int) -> DataFrame:
    """All links that matter within groups of sets (cid, set, grp, blocks, block): in blocks first, then across them.

    Across blocks, one delegate of each block's component stands for it first. What the largest component
    of a group then still lacks is compared with all blocks; pairs inside it need no look.
    """
    fresh = placed.withColumns({"comp": F.col("cid"), "ask": F.lit(True)})
    links = materialise(_link_groups(fresh, ["grp", "block"], percent, buckets))
    if not placed.select("blocks").where("blocks > 1").limit(1).count():
        return links
    large = placed.where("blocks > 1")

    def with_components(df: DataFrame, found: DataFrame) -> DataFrame:
        comps = connected_components(found).select(F.col("node").alias("cid"), F.col("component").alias("comp"))
        return df.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))

    inside = with_components(large, links)
    delegates = inside.groupBy("grp", "block", "comp").agg(F.min_by(F.struct("cid", "set"), "cid").alias("x")).select("grp", "comp", "x.*")
    parts = delegates.groupBy("grp").agg(F.ceil(F.count("*") / block_sets).cast("int").alias("parts"))
    deputed = delegates.join(parts, "grp").withColumns({"part": F.pmod(F.xxhash64("cid"), F.col("parts")), "ask": F.lit(True)})
    links = materialise(links.union(_link_groups(deputed, ["grp", "part"], percent, buckets)))
    inside = materialise(with_components(large, links))
    most = inside.groupBy("grp", "comp").count().groupBy("grp").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    rest = inside.join(most, "grp").where("comp <> main")
    chunks = rest.groupBy("grp").agg(F.ceil(F.count("*") / block_sets).cast("int").alias("chunks"))
    asking = rest.join(chunks, "grp").select("grp", "cid", "set", "comp", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("ask"))
    asked = inside.join(chunks, "grp").select("grp", "cid", "set", "comp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "block", F.lit(False).alias("ask"))
    return links.union(_link_groups(asking.union(asked), ["grp", "block", "chunk"], percent, 4 * buckets))


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, short: int = SHORT_LIST, block_sets: int = BLOCK_SETS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id of every row: components of the links between documents.

    A document's set are the distinct ``k``-word shingles of its text with A-Z in lower case, or its whole
    word sequence if shorter. Two documents link when 100 times the intersection is at least ``percent``
    times the union. ``component_id`` is the smallest doc_id that links lead to; ``class_id`` numbers equal
    sets. Texts without words and null texts have an empty set and link with nothing. Rows with a null id
    get a null component. Repeated rows get equal results; other columns are ignored. Shingles are told
    apart by 64-bit hashes, sets by their size and 128 bits.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    batches = set_batches(batched(docs.select("doc_id", "text")), k)
    rows = batches.select("batch", F.posexplode(F.arrays_zip("ids", "n", "k1", "k2")).alias("pos", "x")).select("batch", "pos", F.col("x.ids").alias("doc_id"), F.col("x.n").alias("n_shingles"), "x.k1", "x.k2")
    key = ["k1", "k2", "n_shingles"]
    full = rows.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy(*key).agg(F.min(F.struct("doc_id", "batch", "pos")).alias("x"))
    classes = materialise(classes.select(*key, F.col("x.doc_id").alias("least"), "x.batch", "x.pos", (F.col("x.batch") * BATCH_ROWS + F.col("x.pos")).alias("cid"), F.col("n_shingles").alias("n")))
    tokens = int(classes.agg(F.sum("n")).first()[0] or 0)
    texts = materialise(_only(batches, classes))
    entries = materialise(index_entries(texts, token_counts_of(texts, k, tokens), k, percent))
    buckets = 2 * shuffle_width(docs.sparkSession)
    found = materialise(candidates(entries, percent, buckets + entries.count() // BUCKET_ENTRIES, short))
    # Candidates of short lists have passed the filters of size and position: their components are families of near copies.
    grouped = [connected_components(found.where(F.col("kind") == x)).select(F.col("node").alias("cid"), F.xxhash64("component", F.lit(x)).alias("grp")) for x in (0, 1)]
    placed = materialise(_place(grouped[0].union(grouped[1]), classes.select("cid", "n"), block_sets, block_tokens))
    wide = ["cid", "grp", "blocks", "block"]
    # What each batch has to send: the places of its texts, and for each of them where it goes.
    goals = placed.withColumns({"batch": F.shiftright("cid", BATCH_ROWS.bit_length() - 1), "at": F.col("cid") % BATCH_ROWS})
    goals = goals.groupBy("batch").agg(*(F.collect_list(c).alias(c) for c in ("at", *wide)))  # two at most for each of a bounded number

    def whole(parts):
        begin_task("jaccard")
        for batch in parts:
            for i in range(batch.num_rows):
                places, at = np.unique(batch.column(2)[i].values.to_numpy(), return_inverse=True)
                places = np.searchsorted(batch.column(1)[i].values.to_numpy(), places)
                sets = shingle_sets(Texts(*_open_texts(batch.column(7)[i].as_py(), places)), k)
                for x in range(0, len(at), 64):
                    cut = [batch.column(j)[i].values.slice(x, 64) for j in range(3, 7)]
                    yield pa.RecordBatch.from_arrays([*cut, pa.array([sets[y].tobytes() for y in at[x : x + 64]], pa.binary())], [*wide, "set"])

    sets = texts.join(goals.select("batch", F.col("at").alias("goal"), *wide), "batch").select("batch", "pos", "goal", *wide, "texts")
    sets = materialise(sets.mapInArrow(whole, "cid long, grp long, blocks int, block int, set binary"))
    tokens = placed.join(classes.select("cid", "n"), "cid").agg(F.sum("n")).first()[0] or 0
    discard(texts, entries, found, placed)
    links = _grouped_links(sets, percent, block_sets, buckets + tokens // BUCKET_TOKENS)
    comps = materialise(connected_components(links))
    discard(sets)
    named = comps.join(classes.select(F.col("cid").alias("node"), "least"), "node")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = comps.join(least, "component").select(F.col("node").alias("cid"), "component_id")
    named = classes.select(*key, "cid", "least").join(linked, "cid", "left").select(*key, "cid", F.coalesce("component_id", "least").alias("component_id"))
    # Rows without a class are looked up by nothing; they stay apart, so that they do not meet in one task.
    plain = rows.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_id"))
    return full.join(named, key).select("doc_id", "n_shingles", F.col("component_id").cast(kind).alias("component_id"), F.col("cid").alias("class_id")).union(plain)
