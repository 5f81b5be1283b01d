"""Typed knowledge graph: reindexed nodes, edges by meta-path, reachability, random walks and induced subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .groups import ordered_position


def reindex(nodes: DataFrame) -> DataFrame:
    """Adds new_index, dense from 0 within each node type by node_id; numbered range by range, so few types of many nodes spread too."""
    return ordered_position(nodes, "node_id", "node_type").withColumnRenamed("position", "new_index").drop("total")


def metapath_catalog(triples: DataFrame) -> DataFrame:
    """(metapath_id, x_type, relation, y_type, path): the distinct types of triples, numbered by name. Few rows by nature."""
    kinds = triples.select("x_type", "relation", "y_type").distinct()
    return kinds.withColumn("metapath_id", (F.row_number().over(Window.orderBy("x_type", "relation", "y_type")) - 1).cast("int")).withColumn("path", F.concat_ws("->", "x_type", "relation", "y_type"))


def coarse_paths(triples: DataFrame) -> DataFrame:
    """(x_type, y_type, relations): sorted distinct relations between two types."""
    return triples.groupBy("x_type", "y_type").agg(F.array_sort(F.collect_set("relation")).alias("relations"))


def edges(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triples whose both ends are nodes, with meta-path ids and new indexes; stored by meta-path, never as one list."""
    n = nodes.select("node_id", "node_type", "new_index")
    x = n.select(F.col("node_id").alias("x_id"), F.col("node_type").alias("x_type"), F.col("new_index").alias("src"))
    y = n.select(F.col("node_id").alias("y_id"), F.col("node_type").alias("y_type"), F.col("new_index").alias("dst"))
    found = triples.join(x, ["x_id", "x_type"]).join(y, ["y_id", "y_type"])
    kinds = metapath_catalog(triples).select("x_type", "relation", "y_type", "metapath_id")
    return found.join(kinds, ["x_type", "relation", "y_type"])


def edge_text(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``text``: source name, relation and target name."""
    n = nodes.select("node_type", "new_index", "node_name")
    x = n.select(F.col("node_type").alias("x_type"), F.col("new_index").alias("src"), F.col("node_name").alias("_x"))
    y = n.select(F.col("node_type").alias("y_type"), F.col("new_index").alias("dst"), F.col("node_name").alias("_y"))
    return edge_rows.join(x, ["x_type", "src"]).join(y, ["y_type", "dst"]).withColumn("text", F.concat_ws(" ", "_x", "relation", "_y")).drop("_x", "_y")


def reachable(start: DataFrame, triples: DataFrame, path: list[str]) -> DataFrame:
    """(start, id): what a chain of relations leads to; ends are made distinct after each step."""
    at = start.select(F.col("id").alias("start"), "id").distinct()
    for relation in path:
        hop = triples.where(F.col("relation") == relation).select(F.col("x_id").alias("id"), F.col("y_id").alias("to"))
        at = at.join(hop, "id").select("start", F.col("to").alias("id")).distinct()
    return at


def random_walk(seeds: DataFrame, hops: DataFrame, walks: int, steps: int, seed: int) -> DataFrame:
    """(seed_id, walk, step, node): neighbours are picked by a hash of walk, step and node, so walks repeat.

    ``hops`` has src and dst. A walk ends at a node without neighbours. Neighbours are numbered once
    by a window within their node.
    """
    numbered = hops.select("src", "dst").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1)
    degree = hops.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("deg"))
    at = seeds.select(F.col("id").alias("seed_id"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"), F.lit(0).alias("step"), F.col("id").alias("node"))
    out = at
    for step in range(1, steps + 1):
        pick = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("walk").cast("string"), F.lit(str(step)), F.col("node").cast("string"))), 1, 8), 16, 10).cast("long")
        at = at.join(degree, at["node"] == degree["src"]).withColumn("nth", pick % F.col("deg")).drop("src", "deg")
        at = at.join(numbered, (at["node"] == numbered["src"]) & (at["nth"] == numbered["nth"])).select("seed_id", "walk", F.lit(step).alias("step"), F.col("dst").alias("node"))
        out = out.union(at)
    return out


def induced(edge_rows: DataFrame, kept: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges with both ends among ``kept`` (node)."""
    a, b = kept.select(F.col("node").alias(src)).distinct(), kept.select(F.col("node").alias(dst)).distinct()
    return edge_rows.join(a, src, "left_semi").join(b, dst, "left_semi")


def names_in_chunks(nodes: DataFrame, size: int = 1000) -> DataFrame:
    """(node_type, chunk, names): names of a type in the order of new_index, ``size`` in a row, so no row grows with the graph."""
    parts = nodes.groupBy("node_type", F.floor(F.col("new_index") / size).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("new_index", "node_name"))).alias("x"))
    return parts.select("node_type", "chunk", F.transform("x", lambda v: v["node_name"]).alias("names"))
