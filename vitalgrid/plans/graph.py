"""Graph and retrieval queries: tables' foreign keys as triples, embeddings as vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import retrieval as R
from ..operators.stores import VectorStore
from ..session import shared_dir
from ..sources.tables import table
from .common import query

_NODES = """nodes AS (SELECT 'region-' || r_regionkey AS node_id, 'region' AS node_type, r_name AS node_name FROM region UNION ALL SELECT 'nation-' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'customer-' || c_custkey, 'customer', c_name FROM customer
 UNION ALL SELECT 'supplier-' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'part-' || p_partkey, 'part/item', p_name FROM part),
triples AS (SELECT 'nation-' || n_nationkey AS x_id, 'nation' AS x_type, 'in_region' AS relation, 'region-' || n_regionkey AS y_id, 'region' AS y_type FROM nation UNION ALL SELECT 'customer-' || c_custkey, 'customer', 'located_in', 'nation-' || c_nationkey, 'nation' FROM customer
 UNION ALL SELECT 'supplier-' || s_suppkey, 'supplier', 'located_in', 'nation-' || s_nationkey, 'nation' FROM supplier UNION ALL SELECT DISTINCT 'supplier-' || l_suppkey, 'supplier', 'supplies', 'part-' || l_partkey, 'part/item' FROM lineitem
 UNION ALL SELECT DISTINCT 'customer-' || o_custkey, 'customer', 'ordered', 'part-' || l_partkey, 'part/item' FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
rn AS (SELECT *, row_number() OVER (PARTITION BY node_type ORDER BY node_id) - 1 AS new_index FROM nodes),
mp AS (SELECT *, CAST(row_number() OVER (ORDER BY x_type, relation, y_type) - 1 AS INT) AS metapath_id, x_type || '->' || relation || '->' || y_type AS path FROM (SELECT DISTINCT x_type, relation, y_type FROM triples)),
ed AS (SELECT t.*, a.new_index AS src, b.new_index AS dst, m.metapath_id, a.node_name AS xn, b.node_name AS yn FROM triples t JOIN rn a ON a.node_id = x_id AND a.node_type = x_type JOIN rn b ON b.node_id = y_id AND b.node_type = y_type JOIN mp m USING (x_type, relation, y_type))"""


def _id(kind, col):
    return F.concat(F.lit(kind + "-"), F.col(col).cast("string"))


def _nodes(spark, sf_dir):
    parts = [("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("part", "part/item", "p_partkey", "p_name")]
    out = None
    for name, kind, key, label in parts:
        n = table(spark, sf_dir, name).select(_id(name, key).alias("node_id"), F.lit(kind).alias("node_type"), F.col(label).alias("node_name"))
        out = n if out is None else out.union(n)
    return out


def _triples(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    row = lambda df, xk, xc, xt, rel, yk, yc, yt: df.select(_id(xk, xc).alias("x_id"), F.lit(xt).alias("x_type"), F.lit(rel).alias("relation"), _id(yk, yc).alias("y_id"), F.lit(yt).alias("y_type"))
    bought = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct()
    return (
        row(t("nation"), "nation", "n_nationkey", "nation", "in_region", "region", "n_regionkey", "region")
        .union(row(t("customer"), "customer", "c_custkey", "customer", "located_in", "nation", "c_nationkey", "nation"))
        .union(row(t("supplier"), "supplier", "s_suppkey", "supplier", "located_in", "nation", "s_nationkey", "nation"))
        .union(row(t("lineitem").select("l_suppkey", "l_partkey").distinct(), "supplier", "l_suppkey", "supplier", "supplies", "part", "l_partkey", "part/item"))
        .union(row(bought, "customer", "o_custkey", "customer", "ordered", "part", "l_partkey", "part/item"))
    )


@query(f"WITH {_NODES} SELECT node_type, node_id, new_index FROM rn")
def kg_reindex(spark, sf_dir):
    return G.reindex(_nodes(spark, sf_dir)).select("node_type", "node_id", "new_index")


@query(f"WITH {_NODES} SELECT metapath_id, path, replace(x_type || '_' || relation || '_' || y_type, '/', '_') AS name FROM mp")
def metapath_catalog(spark, sf_dir):
    from ..functions.text import safe_name

    return G.metapath_catalog(_triples(spark, sf_dir)).select("metapath_id", "path", safe_name("x_type", "relation", "y_type").alias("name"))


@query(f"WITH {_NODES} SELECT x_type, y_type, string_agg(DISTINCT relation, '|' ORDER BY relation) AS relations FROM triples GROUP BY ALL")
def coarse_metapaths(spark, sf_dir):
    return G.coarse_paths(_triples(spark, sf_dir)).select("x_type", "y_type", F.array_join("relations", "|").alias("relations"))


@query(f"WITH {_NODES} SELECT metapath_id, src, dst FROM ed")
def kg_edges(spark, sf_dir):
    return G.edges(_triples(spark, sf_dir), G.reindex(_nodes(spark, sf_dir))).select("metapath_id", "src", "dst")


@query(f"WITH {_NODES} SELECT metapath_id, src, dst, xn || ' ' || relation || ' ' || yn AS text FROM ed WHERE relation NOT IN ('ordered', 'supplies')")
def kg_edge_text(spark, sf_dir):
    """Edge texts without the two very large relations."""
    n = G.reindex(_nodes(spark, sf_dir))
    t = _triples(spark, sf_dir)
    kinds = G.metapath_catalog(t).select("x_type", "relation", "y_type", "metapath_id")
    e = G.edges(t.where(~F.col("relation").isin("ordered", "supplies")), n).drop("metapath_id").join(kinds, ["x_type", "relation", "y_type"])
    return G.edge_text(e, n).select("metapath_id", "src", "dst", "text")


@query(f"WITH {_NODES} SELECT node_type, new_index // 1000 AS chunk, count(*) AS n, md5(string_agg(node_name, '|' ORDER BY new_index)) AS names_md5 FROM rn GROUP BY ALL")
def kg_names_by_type(spark, sf_dir):
    """Names of every type in index order, 1000 in a row."""
    x = G.names_in_chunks(G.reindex(_nodes(spark, sf_dir)))
    return x.select("node_type", "chunk", F.size("names").cast("long").alias("n"), F.md5(F.array_join("names", "|")).alias("names_md5"))


@query(f"WITH {_NODES} SELECT DISTINCT a.x_id AS start, c.y_id AS id FROM triples a JOIN triples b ON b.x_id = a.y_id AND b.relation = 'in_region' JOIN (SELECT DISTINCT y_id FROM triples WHERE relation = 'in_region') c ON c.y_id = b.y_id WHERE a.relation = 'located_in'")
def metapath_reach(spark, sf_dir):
    """Regions that customers and suppliers reach through their nation."""
    t = _triples(spark, sf_dir)
    start = t.where("relation = 'located_in'").select(F.col("x_id").alias("id")).distinct()
    return G.reachable(start, t, ["located_in", "in_region"])


_HOPS = "h AS (SELECT DISTINCT src, dst FROM (SELECT x_id AS src, y_id AS dst FROM triples WHERE relation IN ('located_in', 'in_region') UNION ALL SELECT y_id, x_id FROM triples WHERE relation IN ('located_in', 'in_region'))), nb AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS nth, count(*) OVER (PARTITION BY src) AS deg FROM h)"


def _step(i: int) -> str:
    return f"w{i} AS (SELECT seed_id, walk, {i} AS step, nb.dst AS node FROM w{i - 1} w JOIN nb ON nb.src = w.node AND nb.nth = CAST('0x' || substr(md5('7-' || walk || '-{i}-' || node), 1, 8) AS BIGINT) % nb.deg)"


@query(f"WITH {_NODES}, {_HOPS}, w0 AS (SELECT x_id AS seed_id, CAST(k AS INT) AS walk, 0 AS step, x_id AS node FROM (SELECT DISTINCT x_id FROM triples WHERE x_type = 'supplier' AND relation = 'located_in'), range(0, 3) r(k)), {_step(1)}, {_step(2)}, {_step(3)} SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3")
def random_walks(spark, sf_dir):
    """Three walks of three steps from every supplier."""
    t = _triples(spark, sf_dir).where(F.col("relation").isin("located_in", "in_region"))
    hops = t.select(F.col("x_id").alias("src"), F.col("y_id").alias("dst")).union(t.select("y_id", "x_id"))
    seeds = t.where("x_type = 'supplier' and relation = 'located_in'").select(F.col("x_id").alias("id")).distinct()
    return G.random_walk(seeds, hops, 3, 3, 7)


@query(f"WITH {_NODES}, k AS (SELECT node_id AS node FROM nodes WHERE node_type IN ('nation', 'supplier')) SELECT x_id, relation, y_id FROM triples WHERE x_id IN (SELECT node FROM k) AND y_id IN (SELECT node FROM k)")
def induced_subgraph(spark, sf_dir):
    kept = _nodes(spark, sf_dir).where(F.col("node_type").isin("nation", "supplier")).select(F.col("node_id").alias("node"))
    return G.induced(_triples(spark, sf_dir), kept, "x_id", "y_id").select("x_id", "relation", "y_id")


_DIST = "list_sum(list_transform(list_zip(q.embedding, s.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))"
_HITS = f"WITH d AS (SELECT q.vec_id AS qid, s.vec_id AS item, s.label AS label, {_DIST} AS distance FROM embeddings q, embeddings s WHERE q.vec_id % 20 = 0)"


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding", "label")


@query(f"{_HITS} SELECT qid, item, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, item) AS rank FROM d) WHERE rank <= 3")
def vector_topk(spark, sf_dir):
    """The three nearest of every query, the ids divisible by 20."""
    return R.top_k(*_vectors(spark, sf_dir), 3).select("qid", "item", F.round("distance", 6).alias("distance"), "rank")


@query(f"{_HITS} SELECT qid, label, item, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY distance, item) AS rank FROM d) WHERE rank <= 2")
def vector_topk_by_type(spark, sf_dir):
    """The two nearest of each kind."""
    return R.top_k(*_vectors(spark, sf_dir), 2, by="label").select("qid", "label", "item", "rank")


@query(f"{_HITS}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY distance, item) AS r FROM d) WHERE r <= 2) SELECT qid, item, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, item) AS rank FROM t) WHERE rank <= 6")
def vector_topk_reranked(spark, sf_dir):
    """The two nearest of each kind, then the six nearest of these."""
    return R.best_overall(R.top_k(*_vectors(spark, sf_dir), 2, by="label"), 6).select("qid", "item", "rank")


_PATHS = [(0, 5, 1), (1, 6, 3)]


@query(f"""{_HITS} SELECT qid, part, kind, item, CAST(rank AS INT) AS rank FROM (SELECT qid, CASE WHEN label < 5 THEN 'node' ELSE 'edge' END AS part, label AS kind, item, row_number() OVER (PARTITION BY qid, label ORDER BY distance, item) AS rank FROM d WHERE label IN (0, 1, 3, 5, 6)) WHERE rank <= 2""")
def graph_vector_hits(spark, sf_dir):
    """Nearest nodes and edges of two chosen paths; labels below five stand for node types, the others for relations."""
    queries, store = _vectors(spark, sf_dir)
    store = store.withColumnRenamed("label", "kind")
    return R.graph_hits(queries, store.where("kind < 5"), store.where("kind >= 5"), _PATHS, 2).drop("distance")


@query(f"""WITH {_NODES}, p AS (SELECT node_type, node_id, row_number() OVER (PARTITION BY node_type ORDER BY md5(node_id || '-4'), node_id) AS r, count(*) OVER (PARTITION BY node_type) AS n FROM nodes) SELECT node_type, node_id FROM p WHERE n < 30 OR r <= 3""")
def sampled_nodes(spark, sf_dir):
    """Nodes of a type, three of them where there are 30 or more."""
    from ..operators.groups import sample_if_many

    return sample_if_many(_nodes(spark, sf_dir).select("node_type", "node_id"), "node_type", "node_id", 30, 3, 4)


def _store(spark, sf_dir):
    """A new store of all vectors: made of those with an even id, the others added."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("kind"))
    store = VectorStore.make(rows.where("id % 2 = 0"), f"{shared_dir(spark)}/{uuid.uuid4().hex}", cells=16)
    store.add(rows.where("id % 2 <> 0"))
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    return store, queries


@query()
def kept_store_search(spark, sf_dir):
    """The three nearest among the lists that a query probes, of a store that was made of half the vectors and added to."""
    store, queries = _store(spark, sf_dir)
    return store.search(queries, 3).select("qid", "item", F.round("distance", 6).alias("distance"), "rank")


@query(f"{_HITS} SELECT qid, item, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, item) AS rank FROM d) WHERE rank <= 3")
def kept_store_exact(spark, sf_dir):
    """The exact search of the same store."""
    store, queries = _store(spark, sf_dir)
    return store.exact(queries, 3).select("qid", "item", F.round("distance", 6).alias("distance"), "rank")


@query(f"{_HITS} SELECT qid, label AS kind, item, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY distance, item) AS rank FROM d) WHERE rank <= 2")
def kept_store_by_type(spark, sf_dir):
    """The two nearest of each kind in the store, all lists read."""
    store, queries = _store(spark, sf_dir)
    return store.search(queries, 2, by="kind", probes=16).select("qid", "kind", "item", "rank")


@query()
def kmeans_communities(spark, sf_dir):
    """Vectors in ten communities by seeded k-means."""
    return R.communities(table(spark, sf_dir, "embeddings"), 10).select("vec_id", "community")
