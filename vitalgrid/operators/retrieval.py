"""Exact top-k vector queries: a stated set of queries against a whole store, by squared distance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .agent import _stored

#: Bytes of query vectors that one pass over the store takes; more queries are cut into several passes.
QUERY_BYTES = 32 << 20


def query_passes(queries: DataFrame, query_id: str, vector: str, near: Callable[[np.ndarray, np.ndarray], DataFrame]) -> DataFrame:
    """The union of what ``near`` finds for the ids and vectors of each pass of queries.

    A pass is bounded by ``QUERY_BYTES``. With several, the result of each is written to the shared folder before the
    next is collected, so the driver and the plan hold one pass at a time.
    """
    q = queries.select(query_id, vector)
    size = q.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    passes = max(1, -(-(size["n"] * (size["d"] or 1) * 8) // QUERY_BYTES))
    out = None
    for i in range(passes):
        part = (q.where(F.pmod(F.xxhash64(query_id), F.lit(passes)) == i) if passes > 1 else q).toArrow()
        ids = part.column(query_id).to_numpy()
        x = np.array(part.column(vector).to_pylist(), np.float64).reshape(len(ids), -1)
        found = near(ids, x) if passes == 1 else _stored(near(ids, x))
        out = found if out is None else out.union(found)
    return out


def best_of(found: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """Of hits (qid, item, distance and by) the ``k`` nearest of each query, in each kind if ``by`` is given; ties by item."""
    w = Window.partitionBy("qid", *(["by"] if by else [])).orderBy("distance", "item")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.withColumnRenamed("by", by) if by else ranked


def top_k(queries: DataFrame, store: DataFrame, k: int, by: str | None = None, query_id: str = "qid", vector: str = "embedding", item: str = "id") -> DataFrame:
    """(qid, [by,] item, distance, rank): the k nearest items of each query, in each kind ``by`` if given; ties by item.

    Query vectors of one pass are bounded by ``QUERY_BYTES`` and go to every task of the store. A task keeps the k
    best of each of its batches, so what is shuffled does not grow with the pairs. The store's items are integers.
    """
    kind = store.schema[by].dataType.simpleString() if by else None

    def nearest(ids: np.ndarray, x: np.ndarray) -> DataFrame:
        def near(batches):
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                items = batch.column(0).to_numpy(zero_copy_only=False)
                y = np.array(batch.column(1).to_pylist(), np.float64)
                groups = np.array(batch.column(2).to_pylist(), object) if by else np.zeros(len(items), object)
                for g in dict.fromkeys(groups.tolist()):
                    at = np.flatnonzero(groups == g)
                    at = at[np.argsort(items[at], kind="stable")]
                    for a in range(0, len(ids), 256):
                        d = np.stack([np.square(y[at] - v).sum(1) for v in x[a : a + 256]])
                        best = np.argsort(d, 1, kind="stable")[:, :k]
                        rows = np.repeat(np.arange(a, a + len(d)), best.shape[1])
                        cols = [pa.array(ids[rows]), pa.array(items[at][best.ravel()]), pa.array(np.take_along_axis(d, best, 1).ravel())]
                        yield pa.RecordBatch.from_arrays(cols + ([pa.array([g] * len(rows), batch.column(2).type)] if by else []), ["qid", "item", "distance", "by"][: 3 + bool(by)])

        return store.select(item, vector, *([by] if by else [])).mapInArrow(near, "qid long, item long, distance double" + (f", by {kind}" if by else ""))

    return best_of(query_passes(queries, query_id, vector, nearest), k, by)


def graph_hits(queries: DataFrame, nodes: DataFrame, edges: DataFrame, paths: list[tuple], k: int) -> DataFrame:
    """(qid, part, kind, item, distance, rank): the k nearest nodes of each type that a chosen path (source, relation, target) ends in,
    and the k nearest edges of each chosen relation.

    ``nodes`` and ``edges`` have id, embedding and kind (a node's type, an edge's relation).
    """
    kinds = {"node": sorted({x for a, _, b in paths for x in (a, b)}), "edge": sorted({r for _, r, _ in paths})}
    part = lambda store, name: top_k(queries, store.where(F.col("kind").isin(*kinds[name])), k, by="kind").withColumn("part", F.lit(name))
    return part(nodes, "node").unionByName(part(edges, "edge")).select("qid", "part", "kind", "item", "distance", "rank")


def best_overall(hits: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` nearest hits of each query over all kinds."""
    w = Window.partitionBy("qid").orderBy("distance", "item")
    return hits.drop("rank").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def communities(store: DataFrame, k: int, vector: str = "embedding", seed: int = 1, rounds: int = 20) -> DataFrame:
    """Adds ``community`` by seeded k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = store.withColumn("_v", array_to_vector(vector))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="_v", predictionCol="community").fit(rows)
    return model.transform(rows).drop("_v")
