"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Each round links, for every node, all larger neighbours to the smallest one, then all smaller
    ones; both keep the components and the number of rounds grows with the logarithm of
    their size. Smallest neighbours are aggregated before the shuffle, so a hub is never gathered
    in one task. Every round is written to the shared folder. Null endpoints and loops are left
    out; an empty table gives none.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    links = materialise(links)
    while True:
        # large star: u's larger neighbours go to u's smallest neighbour (or u)
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        new = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        new = materialise(new)
        # done when every node hangs on a root that hangs on nothing
        loose = new.join(new.select(F.col("u").alias("r")).distinct(), new["v"] == F.col("r"), "left_semi").limit(1).count()
        many = loose or new.groupBy("u").count().where("count > 1").limit(1).count()
        discard(links)
        links = new
        if not many:
            break
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
