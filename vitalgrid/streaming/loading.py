"""Loading without a full sort, and logs that only grow: a bounded shuffle buffer, appends that replays do not repeat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the buffer of a partition.
BUFFER = 16_384


def buffered_step(held: int, new: int, buffer: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The rows that go out when ``new`` rows come to ``held`` ones, and those that stay: numbers in both together.

    While the buffer is not full, rows go in; then each new row takes the place of a random one, which goes out.
    """
    fill = min(new, max(0, buffer - held))
    slots, out = np.arange(held + fill), []
    for row, at in zip(range(held + fill, held + new), rng.integers(0, max(1, len(slots)), new - fill).tolist()):
        out.append(slots[at])
        slots[at] = row
    return np.array(out, np.int64), slots


def buffered_shuffle(rows: DataFrame, buffer: int = BUFFER, seed: int = 0, epoch: int = 0) -> DataFrame:
    """``rows`` in an order that is random within a moving buffer of each partition; on tables and on streams.

    No row moves between partitions, and a partition holds ``buffer`` rows at most besides a batch. The same seed, epoch and
    partitions give the same order; another epoch another one. Every row comes out once.
    """
    if buffer < 1:
        raise ValueError("a buffer has one row at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
        pool = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out, stay = buffered_step(pool.num_rows if pool else 0, batch.num_rows, buffer, rng)
            t = pa.Table.from_batches([batch])
            pool = pa.concat_tables([pool, t]) if pool else t
            yield from pool.take(pa.array(out)).to_batches()
            pool = pool.take(pa.array(stay)).combine_chunks()
        if pool:
            yield from pool.take(pa.array(rng.permutation(pool.num_rows))).to_batches()

    return rows.mapInArrow(run, rows.schema)


def append_batch(rows: DataFrame, path: str, batch: int | str, source: str = "main") -> None:
    """Put ``rows`` into the log ``path`` under its batch; the same batch of a source again takes the place of what it wrote."""
    rows.write.mode("overwrite").parquet(f"{path}/source={source}/batch={batch}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a log, with the source and batch that wrote them."""
    return spark.read.option("basePath", path).parquet(f"{path}/source=*/batch=*")


def append_stream(rows: DataFrame, path: str, checkpoint: str, source: str = "main") -> None:
    """Run what is new in the stream ``rows`` into the log ``path``: a batch that is replayed after a failure is not there twice."""
    writer = rows.writeStream.foreachBatch(lambda df, number: append_batch(df, path, number, source))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def reward_rows(rows: DataFrame) -> DataFrame:
    """Rows of a reward log: predicted, gold, reward and parts as text, null parts as NA."""
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in ("predicted", "gold", "reward", "parts")))
