"""Visits with code arrays by role, from long code tables or from the order tables that stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

ROLES = ("conditions", "procedures", "drugs")


def map_codes(codes: DataFrame, mapping: DataFrame, level: int | None = None) -> DataFrame:
    """``codes`` (patient_id, visit_id, role, seq, code) with codes replaced by ``mapping`` (code, target), cut to ``level`` characters.

    Codes without a target stay out. The mapping joins by key; Spark broadcasts it where it is small.
    """
    out = codes.join(mapping.select("code", "target"), "code").drop("code").withColumnRenamed("target", "code")
    return out.withColumn("code", F.substring("code", 1, level)) if level else out


def visits_from_codes(visits: DataFrame, codes: DataFrame) -> DataFrame:
    """One row a visit with a sorted array of distinct codes for each role; empty where a role has none."""
    arrays = codes.where(F.col("role").isin(*ROLES)).groupBy("visit_id").agg(*(F.array_sort(F.collect_set(F.when(F.col("role") == r, F.col("code")))).alias(r) for r in ROLES))
    empty = F.array().cast("array<string>")
    return visits.join(arrays, "visit_id", "left").withColumns({r: F.coalesce(r, empty) for r in ROLES})


def order_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as visits: customers are patients, brands, types and names of the ordered parts are the three roles."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("visit_id"), F.col("o_orderdate").alias("encounter_time"), F.col("o_orderstatus").alias("discharge_status")
    )
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    per = lines.groupBy(F.col("l_orderkey").alias("visit_id")).agg(
        F.max("l_shipdate").alias("discharge_time"),
        F.array_sort(F.collect_set("p_brand")).alias("conditions"),
        F.array_sort(F.collect_set("p_type")).alias("procedures"),
        F.array_sort(F.collect_set("p_name")).alias("drugs"),
    )
    empty = F.array().cast("array<string>")
    return orders.join(per, "visit_id", "left").withColumns({r: F.coalesce(r, empty) for r in ROLES})


VISITS_SQL = """visits AS (
  SELECT o_custkey AS patient_id, o_orderkey AS visit_id, o_orderdate AS encounter_time, o_orderstatus AS discharge_status, discharge_time,
    coalesce(conditions, []) AS conditions, coalesce(procedures, []) AS procedures, coalesce(drugs, []) AS drugs
  FROM orders LEFT JOIN (
    SELECT l_orderkey, max(l_shipdate) AS discharge_time, list_sort(list(DISTINCT p_brand)) AS conditions, list_sort(list(DISTINCT p_type)) AS procedures, list_sort(list(DISTINCT p_name)) AS drugs
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""


def names_at_level(names: DataFrame, level: int, code: str = "code") -> DataFrame:
    """The name map of one level of a coding whose codes have a character more at each level: codes of ``level`` + 1 characters."""
    return names.where(F.length(code) == level + 1)


def names_without_dots(names: DataFrame, code: str = "code") -> DataFrame:
    """The name map with the dots taken out of its codes."""
    return names.withColumn(code, F.replace(code, F.lit(".")))
