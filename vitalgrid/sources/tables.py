"""Parquet tables of one data folder, with timestamps as instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``name`` from ``sf_dir``; zone-less timestamps become TIMESTAMP (the session runs in UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    casts = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df
