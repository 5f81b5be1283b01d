"""Kept vector stores: inverted lists over a trained set of cells, written by kind, added to without a rebuild.

A store is a folder: ``cells`` (the cell centres), ``settings`` (one row) and ``items`` in folders by cell. Cells are
trained by k-means on a bounded sample; every row is kept in the list of its nearest cell. A search reads only the lists
that its queries probe; how many cells a query probes is set when the store is made, as the fewest that reach the wanted
recall on a bounded sample of queries. The exact search of the same store is always there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import best_of, query_passes, top_k

#: Rows that cells are trained on, and queries that the number of probed cells is set by.
TRAIN_ROWS, TUNE_QUERIES = 20_000, 200


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def nearest_cells(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """For each row the ``n`` nearest centres, nearest first, ties by number."""
    d = np.square(x).sum(1)[:, None] - 2 * x @ centres.T + np.square(centres).sum(1)
    return np.argsort(d, 1, kind="stable")[:, :n]


def train_cells(sample: np.ndarray, cells: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Cell centres by Lloyd's rounds from distinct rows of the sample; a cell that loses all its rows stays where it is."""
    distinct = np.unique(sample, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:cells]]
    for _ in range(rounds):
        own = nearest_cells(sample, centres, 1)[:, 0]
        many = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        new = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centres)
        if np.array_equal(new, centres):
            break
        centres = new
    return centres


class VectorStore:
    """A store in the folder ``at``; see ``make`` for a new one."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at
        rows = spark.read.parquet(f"{at}/cells").orderBy("cell").collect()  # as many as cells
        self.centres = np.array([r["centre"] for r in rows], np.float64)
        self.probes = spark.read.parquet(f"{at}/settings").first()["probes"]

    @classmethod
    def make(cls, rows: DataFrame, at: str, cells: int = 64, recall: float = 0.9, k: int = 3, seed: int = 0, train_rows: int = TRAIN_ROWS, tune_queries: int = TUNE_QUERIES) -> VectorStore:
        """Train, set the number of probed cells, and write all ``rows`` (id, vector, kind and more).

        Rows without a vector are not kept; kinds may be null. The sample is the first ``train_rows`` rows by the hash of
        the id, the queries that recall is measured with the next ``tune_queries``, against the sample.
        """
        spark = rows.sparkSession
        order = F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(seed))))
        some = rows.where("vector is not null").orderBy(order, "id").limit(train_rows + tune_queries).select("vector").collect()
        drawn = np.array([r["vector"] for r in some], np.float64).reshape(len(some), -1)
        train, asked = drawn[:train_rows], drawn[train_rows:] if len(drawn) > train_rows else drawn[-tune_queries:]
        centres = train_cells(train, max(1, min(cells, len(train))), seed) if len(train) else np.zeros((1, drawn.shape[1]))
        probes = cls._fewest(train, asked, centres, recall, k)
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{at}/cells")
        spark.createDataFrame([(probes, recall, k)], "probes int, recall double, k int").coalesce(1).write.parquet(f"{at}/settings")
        store = cls(spark, at)
        store.add(rows)
        return store

    @staticmethod
    def _fewest(train: np.ndarray, asked: np.ndarray, centres: np.ndarray, recall: float, k: int) -> int:
        """The fewest cells whose lists hold at least ``recall`` of the ``k`` nearest rows, and a few more against chance."""
        if not len(train) or not len(asked):
            return 1
        own = nearest_cells(train, centres, 1)[:, 0]
        order = nearest_cells(asked, centres, len(centres))
        place = np.argsort(order, 1)  # when a query reaches each cell
        true = np.stack([np.argsort(np.square(train - q).sum(1), kind="stable")[:k] for q in asked])
        reached = np.take_along_axis(place, own[true], 1).ravel()
        return min(len(centres), int(np.quantile(reached, min(1.0, recall + (1 - recall) / 2), method="higher")) + 1)

    def add(self, rows: DataFrame) -> None:
        """Put more rows into the lists of their cells; what is there stays as it is."""
        centres = self.centres

        @F.arrow_udf("int")
        def cell(vector: pa.Array) -> pa.Array:
            x = _matrix(vector)
            return pa.array(nearest_cells(x, centres, 1)[:, 0].astype(np.int32) if len(x) else [], pa.int32())

        placed = rows.where("vector is not null").withColumn("cell", cell("vector"))
        placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("append").partitionBy("cell").parquet(f"{self.at}/items")

    def items(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/items")

    def exact(self, queries: DataFrame, k: int, by: str | None = None) -> DataFrame:
        """The k nearest of all rows (of each kind ``by``), as ``top_k``; queries have qid and vector."""
        return top_k(queries, self.items(), k, by=by, vector="vector")

    def search(self, queries: DataFrame, k: int, by: str | None = None, probes: int | None = None) -> DataFrame:
        """(qid, [by,] item, distance, rank): the k nearest among the rows of the cells that each query probes.

        Query vectors go in passes of bounded bytes; a pass reads the lists of its cells only, and a task compares a
        list's rows with the queries that probe it.
        """
        centres, probes = self.centres, min(probes or self.probes, len(self.centres))
        items = self.items()
        kind = items.schema[by].dataType.simpleString() if by else None

        def near(ids: np.ndarray, x: np.ndarray) -> DataFrame:
            cells = nearest_cells(x, centres, probes)
            asking: dict[int, np.ndarray] = {int(c): np.flatnonzero((cells == c).any(1)) for c in np.unique(cells)}

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    item, y, cell = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1)), batch.column(2).to_numpy()
                    groups = np.array(batch.column(3).to_pylist(), object) if by else np.zeros(len(item), object)
                    for c in np.unique(cell).tolist():
                        here = np.flatnonzero(cell == c)
                        for g in dict.fromkeys(groups[here].tolist()):
                            at = here[[v == g for v in groups[here]]]
                            at = at[np.argsort(item[at], kind="stable")]
                            q = asking.get(c, np.empty(0, int))
                            for a in range(0, len(q), 256):
                                some = q[a : a + 256]
                                d = np.stack([np.square(y[at] - v).sum(1) for v in x[some]])
                                best = np.argsort(d, 1, kind="stable")[:, :k]
                                rows = np.repeat(some, best.shape[1])
                                cols = [pa.array(ids[rows]), pa.array(item[at][best.ravel()]), pa.array(np.take_along_axis(d, best, 1).ravel())]
                                yield pa.RecordBatch.from_arrays(cols + ([pa.array([g] * len(rows), batch.column(3).type)] if by else []), ["qid", "item", "distance", "by"][: 3 + bool(by)])

            read = items.where(F.col("cell").isin([int(c) for c in asking])) if len(asking) < len(centres) else items
            return read.select("id", "vector", "cell", *([by] if by else [])).mapInArrow(run, "qid long, item long, distance double" + (f", by {kind}" if by else ""))

        return best_of(query_passes(queries, "qid", "vector", near), k, by)
