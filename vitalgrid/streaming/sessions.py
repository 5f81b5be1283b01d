"""Incremental forms: sessions of an event stream as visits, and instruction rows from a growing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n, total): sessions by user; works on a stream and on a table."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    s = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def follow_folder(spark: SparkSession, folder: str, schema, sink: str, checkpoint: str, transform=lambda df: df) -> None:
    """Run what is new in a folder of parquet files through ``transform`` into ``sink``, once, exactly once a file."""
    rows = transform(spark.readStream.schema(schema).parquet(folder))
    rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
