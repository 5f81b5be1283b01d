"""Sequence statistics: lengths, valid tokens, perplexity, packing masks, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def length_cdf(rows: DataFrame, length: str, interval: int) -> DataFrame:
    """(start, n, cumulative, share): rows by length interval and up to it."""
    h = rows.groupBy((F.floor(F.col(length) / interval) * interval).alias("start")).agg(F.count("*").alias("n"))
    upto = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row an interval
    return h.withColumn("cumulative", F.sum("n").over(upto)).withColumn("share", F.col("cumulative") / F.sum("n").over(Window.partitionBy()))


def valid_ratio(rows: DataFrame, valid: str, total: str, base_rate: float, base_size: float) -> DataFrame:
    """Share of valid tokens, and the learning rate that goes with this many valid tokens a batch."""
    s = rows.agg(F.sum(valid).alias("valid"), F.sum(total).alias("total"), F.count("*").alias("n"))
    return s.select("valid", "total", (F.col("valid") / F.col("total")).alias("ratio"), (base_rate * F.sqrt(F.col("valid") / F.col("n") / base_size)).alias("rate"))


def perplexity(tokens: DataFrame, key: str, loss: str, mask: str) -> DataFrame:
    """(key, perplexity): exp of the mean loss over unmasked tokens; null where all are masked."""
    return tokens.groupBy(key).agg(F.exp(F.sum(F.when(F.col(mask), F.col(loss))) / F.nullif(F.count_if(mask), F.lit(0))).alias("perplexity"))


def segments(rows: DataFrame, key: str, mask: str) -> DataFrame:
    """(key, segment, length): tokens of each numbered segment of a packed row; 0 is padding."""
    return rows.select(key, F.explode(mask).alias("segment")).where("segment > 0").groupBy(key, "segment").agg(F.count("*").alias("length"))


def sequence_offsets(lengths: DataFrame, key: str) -> DataFrame:
    """Adds first and end, each segment's place within its packed row."""
    w = Window.partitionBy(key).orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("length").over(w)
    return lengths.withColumn("end", end).withColumn("first", F.col("end") - F.col("length"))


def unpad_indices(rows: DataFrame, key: str, mask: str) -> DataFrame:
    """(key, index): positions that are no padding, in the row's own count."""
    return rows.select(key, F.posexplode(mask).alias("index", "segment")).where("segment > 0").select(key, "index")


def smoothed(values: Column, weight: Column) -> Column:
    """Exponential smoothing of an ordered array: each value against the one before it, from the first."""
    start = F.struct(F.element_at(values, 1).cast("double").alias("last"), F.array().cast("array<double>").alias("out"))

    def add(acc: Column, v: Column) -> Column:
        now = acc["last"] * weight + v * (1 - weight)
        return F.struct(now.alias("last"), F.concat(acc["out"], F.array(now)).alias("out"))

    return F.aggregate(values, start, add, lambda acc: acc["out"])


def rouge_l(a: Column | str, b: Column | str) -> Column:
    """F1 of the longest common word subsequence; 0 without words."""
    from .overlap import subsequence

    n = sum(F.coalesce(F.size(x), F.lit(0)) for x in (a, b))
    return F.when(n > 0, 2 * subsequence(a, b) / n).otherwise(F.lit(0.0))
