"""Merkle dataset manifest (operator 12): binary hash trees over the documents of each language, and over their roots.

The trees are evaluated by time-forward processing. A node's label is its level, then its place in the level, so
children come before parents. Whoever computes a node sends its digest to the parent's label through a priority queue;
when a label's turn comes, all its messages are at the queue's head. Then a reversed sweep, by falling labels, sends each
node's proof suffix (the siblings from it up to the root) to its children. The queue is external: ``BLOCK`` neighbouring
nodes of a level and all that stands above them within ``LEVELS`` levels are a block, whose queue is a heap in one task;
messages that leave a block go through a shuffle by (group, block), one a block. So a round takes ``LEVELS`` levels, a
group of any size is as many tasks as it has blocks, and what is shuffled falls by 1024 from round to round.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batched, materialise

#: Levels of a block, and leaves of it.
LEVELS = 10
BLOCK = 1 << LEVELS
#: Sides of a step: without sibling, the sibling to the right, the sibling to the left.
ALONE, RIGHT, LEFT = 0, 1, 2


def digest(*inputs: bytes) -> bytes:
    """Lowercase hex of the SHA-256 of the inputs in turn."""
    return hashlib.sha256(b"".join(inputs)).hexdigest().encode()


def nodes_of_level(n: int, level: int) -> int:
    """Nodes of a level in a tree of ``n`` leaves; 1 from the root on."""
    return max(1, -(-n >> level))


class Block:
    """The nodes above some neighbouring nodes of a level, up to ``LEVELS`` levels or the root.

    ``digests`` are those of the nodes from ``first`` on at ``level`` in a tree of ``n`` leaves.
    """

    def __init__(self, n: int, level: int, first: int, digests: list[bytes]):
        self.children: dict[tuple[int, int], list[bytes]] = {}
        self.n, self.level, self.first, self.size = n, level, first, len(digests)
        top = level
        while top < level + LEVELS and nodes_of_level(n, top) > 1:
            top += 1
        if top == level:  # the root of a small tree, on its way up
            self.label, self.digest = (level, first), digests[0]
            return
        queue = [(level + 1, i >> 1, i, d) for i, d in enumerate(digests, first)]  # in order, so a heap
        while True:
            up, at = queue[0][:2]
            got = []
            while queue and queue[0][:2] == (up, at):
                got.append(heapq.heappop(queue)[3])
            self.children[up, at] = got
            own = digest(*got)
            if up == top:
                break
            heapq.heappush(queue, (up + 1, at >> 1, at, own))
        self.label, self.digest = (up, at), own

    def suffixes(self, sides: bytes, siblings: bytes) -> list[tuple[bytes, bytes]]:
        """For each of the given nodes its sides and siblings up to the root, when those of the block's top are given."""
        queue = [(-self.label[0], -self.label[1], sides, siblings)]
        out: list[tuple[bytes, bytes]] = [(b"", b"")] * self.size
        while queue:
            level, at, sides, siblings = heapq.heappop(queue)
            level, at = -level, -at
            if level == self.level:
                out[at - self.first] = (sides, siblings)
                continue
            got = self.children[level, at]
            if len(got) == 1:
                heapq.heappush(queue, (1 - level, -2 * at, bytes([ALONE]) + sides, siblings))
            else:
                heapq.heappush(queue, (1 - level, -2 * at, bytes([RIGHT]) + sides, got[1] + siblings))
                heapq.heappush(queue, (1 - level, -2 * at - 1, bytes([LEFT]) + sides, got[0] + siblings))
        return out


def folded(leaf: bytes, sides: bytes, siblings: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    at = 0
    for side in sides:
        if side == ALONE:
            leaf = digest(leaf)
            continue
        other = siblings[at : at + 64]
        leaf = digest(leaf, other) if side == RIGHT else digest(other, leaf)
        at += 64
    return leaf


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digests(docs: DataFrame, tampered: Column) -> DataFrame:
    """g (a key of the language that keeps its order, null first), doc_id, leaf, and forged where ``tampered`` holds and the change shows."""
    leaf = lambda n: F.sha2(F.concat(*(field(x) for x in (F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")))), 256)
    n = F.col("n_chars").cast("decimal(38,0)")
    key = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return docs.select(key.alias("g"), "doc_id", leaf(n).alias("leaf"), F.when(tampered & n.isNotNull(), leaf(n + 1)).alias("forged"))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with pos (from 0, within the group, by ``order``, nulls first) and n (rows of the group).

    Ranges are sorted and numbered for themselves; how many rows of its group come before a range is summed from one
    count for each range and group. Equal rows are told apart by their place, so that no group or key is too frequent.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    schema = rows.schema.simpleString()[7:-1] + ",range int,nth bigint"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before, part = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(batch.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            nth = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
            if last is not None and g[0] == last:
                nth[: begin[1] if len(begin) > 1 else len(g)] += before
            last, before = g[-1], int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(g), part, np.int32)), pa.array(nth)], [*batch.schema.names, "range", "nth"])

    ranged = batched(rows).repartitionByRange(*keys, F.monotonically_increasing_id()).sortWithinPartitions(*keys)
    ranged = materialise(ranged.mapInArrow(number, schema))
    counts = ranged.groupBy(group, "range").agg(F.count("*").alias("c"))
    along = Window.partitionBy(group).orderBy("range")  # a row a range
    counts = counts.select(group, "range", (F.sum("c").over(along) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy(group)).alias("n"))
    return ranged.join(counts, [group, "range"]).withColumn("pos", F.col("before") + F.col("nth")).drop("range", "nth", "before")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Tables of g, n, pos and digest: the given nodes, those ``LEVELS`` levels up and so on, at last a root a group."""

    def up(level: int):
        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by("pos")
            n, first = t.column("n")[0].as_py(), t.column("pos")[0].as_py()
            b = Block(n, level, first, [x.encode() for x in t.column("digest").to_pylist()])
            return pa.table([t.column("g")[:1], t.column("n")[:1], t.column("block")[:1], pa.array([b.digest.decode()])], names=["g", "n", "pos", "digest"])

        return run

    most = nodes.agg(F.max("n")).first()[0] or 1
    out, level = [nodes], 0
    while level == 0 or nodes_of_level(most, level) > 1:
        at = out[-1].select("g", "n", "pos", "digest", F.shiftright("pos", LEVELS).alias("block"))
        out.append(materialise(at.groupBy("g", "block").applyInArrow(up(level), "g string, n long, pos long, digest string")))
        level += LEVELS
    return out


def descend(tables: list[DataFrame], top: DataFrame, leaves) -> DataFrame:
    """The reversed sweep from ``top`` (g, pos, sides, siblings and more of each root) down to the first of ``tables``.

    ``leaves`` is (function, schema): the function makes a table from the last block's rows, the row of what came down to
    it, and the suffixes of its nodes.
    """
    more = [f for f in top.schema.fields if f.name not in ("g", "pos", "sides", "siblings")]
    schema = "g string, pos long, sides binary, siblings binary" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in more)

    def inner(t: pa.Table, above: pa.Table, got: list[tuple[bytes, bytes]]) -> pa.Table:
        k = t.num_rows
        rest = [pa.array(above.column(f.name).to_pylist()[:1] * k, above.schema.field(f.name).type) for f in more]
        return pa.table([t.column("g"), t.column("pos"), pa.array([a for a, _ in got], pa.binary()), pa.array([b for _, b in got], pa.binary()), *rest], names=["g", "pos", "sides", "siblings", *(f.name for f in more)])

    def down(level: int, make):
        def run(t: pa.Table, above: pa.Table) -> pa.Table:
            t = t.sort_by("pos")
            b = Block(t.column("n")[0].as_py(), level, t.column("pos")[0].as_py(), [x.encode() for x in t.column("digest").to_pylist()])
            return make(t, above, b.suffixes(above.column("sides")[0].as_py(), above.column("siblings")[0].as_py()))

        return run

    for k in range(len(tables) - 2, -1, -1):
        make, kind = leaves if k == 0 else (inner, schema)
        own = tables[k].withColumn("block", F.shiftright("pos", LEVELS)).groupBy("g", "block")
        top = own.cogroup(top.withColumnRenamed("pos", "block").groupBy("g", "block")).applyInArrow(down(k * LEVELS, make), kind)
    return top


def tampered_by_rule() -> Column:
    """The rows that are tampered with to show that proofs fail: where 7 divides the CRC-32 of the decimal doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0


def dataset_manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that a possibly tampered row leads to.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Leaves of a language ascend by doc_id (null ids
    first, rows of one id by their leaf); runs of two become their digest, a last run of one too, until one is left.
    The languages' subroots, null first and then by their bytes, lead to the root likewise. Where ``tampered`` holds,
    n_chars is one more when folded_root is computed; null counts stay, and so verify.

    Returns doc_id, leaf, subroot, root, proof_sha256 (of the siblings' digests in turn), folded_root and verified.
    Nulls in any column have a digest of their own, so null and empty texts differ; other columns are ignored; an
    empty table gives an empty result.
    """
    tampered = F.coalesce(tampered_by_rule() if tampered is None else tampered, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    places = materialise(numbered(leaf_digests(docs, tampered), "g", "doc_id", "leaf").withColumnRenamed("leaf", "digest"))
    lower = climb(places)
    subroots = lower[-1].select(F.lit("").alias("g"), F.col("g").alias("lang"), F.col("digest"))
    upper = climb(materialise(numbered(subroots, "g", "lang")))
    root = upper[-1].select("digest").first()
    root = root["digest"] if root else ""

    def languages(t: pa.Table, above: pa.Table, got: list[tuple[bytes, bytes]]) -> pa.Table:
        zero = pa.array([0] * t.num_rows, pa.int64())
        return pa.table([t.column("lang"), zero, pa.array([a for a, _ in got], pa.binary()), pa.array([b for _, b in got], pa.binary()), t.column("digest")], names=["g", "pos", "sides", "siblings", "subroot"])

    def documents(t: pa.Table, above: pa.Table, got: list[tuple[bytes, bytes]]) -> pa.Table:
        leaf, forged = t.column("digest").to_pylist(), t.column("forged").to_pylist()
        back = [folded((f or d).encode(), *x).decode() for d, f, x in zip(leaf, forged, got)]
        same = [above.column("subroot")[0].as_py()] * len(leaf)
        cols = [t.column("doc_id"), pa.array(leaf), pa.array(same), pa.array([root] * len(leaf)), pa.array([digest(x).decode() for _, x in got]), pa.array(back), pa.array([x == root for x in back])]
        return pa.table(cols, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    nothing = F.lit(b"")
    top = upper[-1].select("g", "pos", nothing.alias("sides"), nothing.alias("siblings"))
    tops = descend(upper, top, (languages, "g string, pos long, sides binary, siblings binary, subroot string"))
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return descend(lower, tops, (documents, schema))


_CRC = "xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ascii(x)::bigint), lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::bigint), 4294967295)"
_FIELD = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(x) for x in ("doc_id", "source", "lang", "{n}", "text")) + ")"

#: DuckDB SQL for the rows of ``dataset_manifest`` (doc_id unique).
ORACLE = f"""
with recursive leaves as (
  select doc_id, lang, row_number() over (partition by lang order by doc_id nulls first) - 1 as pos, count(*) over (partition by lang) as n, {_LEAF.format(n="n_chars")} as leaf,
    case when doc_id is not null and {_CRC} % 7 = 0 then {_LEAF.format(n="(n_chars + 1)")} else {_LEAF.format(n="n_chars")} end as seen
  from documents
), low as (
  select lang, 0 as lvl, pos, n, leaf as digest from leaves
  union all
  select lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by pos)) from low where n > 1 group by lang, lvl, pos // 2, n
), subroots as (
  select lang, digest as subroot, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from low where n = 1
), high as (
  select 0 as lvl, pos, n, subroot as digest from subroots
  union all
  select lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by pos)) from high where n > 1 group by lvl, pos // 2, n
), steps as (
  select l.doc_id, a.lvl as step, a.pos % 2 as side, b.digest as sibling
  from leaves l join low a on a.lang is not distinct from l.lang and a.n > 1 and a.pos = l.pos >> a.lvl
  left join low b on b.lang is not distinct from l.lang and b.lvl = a.lvl and b.pos = xor(a.pos, 1)
  union all
  select l.doc_id, 1000 + a.lvl, a.pos % 2, b.digest
  from leaves l join subroots s on s.lang is not distinct from l.lang join high a on a.n > 1 and a.pos = s.pos >> a.lvl
  left join high b on b.lvl = a.lvl and b.pos = xor(a.pos, 1)
), turns as (
  select *, row_number() over (partition by doc_id order by step) as k from steps
), fold as (
  select doc_id, 0 as k, seen as h from leaves
  union all
  select f.doc_id, f.k + 1, sha256(case when t.sibling is null then f.h when t.side = 1 then t.sibling || f.h else f.h || t.sibling end)
  from fold f join turns t on t.doc_id = f.doc_id and t.k = f.k + 1
), ends as (
  select doc_id, arg_max(h, k) as folded_root from fold group by doc_id
), proofs as (
  select doc_id, string_agg(sibling, '' order by step) as siblings from steps group by doc_id
)
select l.doc_id, l.leaf, s.subroot, r.digest as root, sha256(coalesce(p.siblings, '')) as proof_sha256, e.folded_root, e.folded_root = r.digest as verified
from leaves l join subroots s on s.lang is not distinct from l.lang join ends e on e.doc_id = l.doc_id left join proofs p on p.doc_id = l.doc_id cross join (select digest from high where n = 1) r
"""
