"""Queries of prompts: records by task, summaries of hits, name maps and row indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as C
from ..operators import prompts as P
from ..operators import retrieval as R
from ..operators.groups import row_indexes, split_keys
from ..sources.tables import table
from ..sources.visits import VISITS_SQL, names_at_level, order_visits
from .cohort import _FULL
from .common import query
from .graph import _HITS, _PATHS, _vectors

_Q = lambda x: x.replace("'", "''")


@query(f"""WITH {VISITS_SQL} SELECT visit_id, md5('Conditions so far: ' || array_to_string(conditions, ', ') || chr(10) || 'Procedures so far: ' || array_to_string(procedures, ', ') || chr(10) || 'Drugs so far: ' || array_to_string(drugs, ', ') || chr(10) || 'Question: ' || '{_Q(P.QUESTIONS["LOS"])}') AS prompt_md5 FROM visits WHERE {_FULL}""")
def task_prompts(spark, sf_dir):
    """The record of a visit and what its task asks."""
    v = order_visits(spark, sf_dir).where(C.nonempty("conditions", "procedures", "drugs"))
    return v.select("visit_id", F.md5(P.task_prompt("LOS", F.col("conditions"), F.col("procedures"), F.col("drugs"))).alias("prompt_md5"))


@query(f"""{_HITS}, t AS (SELECT qid, item, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, item) AS INT) AS rank, CAST(floor(distance * 10) AS INT) AS score FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, item) <= 3),
f AS (SELECT qid, 'Text found:' || chr(10) || string_agg('- chunk ' || rank || ' (score ' || score || '): ' || text, chr(10) ORDER BY rank) AS found FROM t JOIN documents ON doc_id = item GROUP BY qid)
SELECT doc_id AS qid, md5('Question: ' || source || chr(10) || chr(10) || coalesce(found, 'Nothing found.') || chr(10) || 'Summarise what bears on the question.') AS prompt_md5 FROM documents LEFT JOIN f ON qid = doc_id WHERE doc_id % 20 = 0""")
def chunk_prompts(spark, sf_dir):
    """Prompts to summarise the texts of the three nearest vectors; the source stands for the question, tenths of distance for the score."""
    d = table(spark, sf_dir, "documents")
    hits = R.top_k(*_vectors(spark, sf_dir), 3).join(d.select(F.col("doc_id").alias("item"), "text"), "item")
    hits = hits.select("qid", "rank", "text", F.floor(F.col("distance") * 10).cast("int").alias("score"))
    questions = d.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.col("source").alias("question"))
    return P.summary_prompts(questions, P.found_chunks(hits)).select("qid", F.md5("prompt").alias("prompt_md5"))


@query(f"""{_HITS}, h AS (SELECT qid, CASE WHEN label < 5 THEN 'node' ELSE 'edge' END AS part, label AS kind, item, row_number() OVER (PARTITION BY qid, label ORDER BY distance, item) AS rank FROM d WHERE label IN (0, 1, 3, 5, 6)),
k AS (SELECT qid, part, kind, '- ' || kind || chr(10) || string_agg('  - ' || item || ': v' || item, chr(10) ORDER BY rank) AS t FROM h WHERE rank <= 2 GROUP BY qid, part, kind),
f AS (SELECT qid, 'Nodes found:' || chr(10) || coalesce(string_agg(t, chr(10) ORDER BY kind) FILTER (part = 'node'), 'none') || chr(10) || 'Edges found:' || chr(10) || coalesce(string_agg(t, chr(10) ORDER BY kind) FILTER (part = 'edge'), 'none') AS found FROM k GROUP BY qid)
SELECT qid, md5(found) AS found_md5 FROM f""")
def graph_prompts(spark, sf_dir):
    """The nodes and edges of two chosen paths that are nearest to each query, as text."""
    queries, store = _vectors(spark, sf_dir)
    store = store.withColumnRenamed("label", "kind")
    hits = R.graph_hits(queries, store.where("kind < 5"), store.where("kind >= 5"), _PATHS, 2).withColumn("text", F.concat(F.lit("v"), F.col("item").cast("string")))
    return P.found_graph(hits).select("qid", F.md5("found").alias("found_md5"))


@query("SELECT p_name AS code, min(p_type) AS name FROM part WHERE length(p_name) = 9 GROUP BY p_name")
def level_names(spark, sf_dir):
    """Names of the codes of one level: as many characters as the level and one."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("code")).agg(F.min("p_type").alias("name"))
    return names_at_level(names, 8)


@query("WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), g AS (SELECT o_custkey, array_to_string(list(i ORDER BY i), ',') AS indexes, count(*) AS n FROM p GROUP BY 1) SELECT o_custkey, indexes, n, min(n) OVER () AS least FROM g")
def patient_indexes(spark, sf_dir):
    """The places of each customer's orders among all orders by key, and the smallest number that a customer has."""
    rows = row_indexes(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey")
    return rows.select("o_custkey", F.array_join(F.col("indexes").cast("array<string>"), ",").alias("indexes"), "n", "least")


@query("""WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey || '-6'), c_custkey) - 1 AS p, count(*) OVER () AS n FROM customer)
SELECT c_custkey, CASE WHEN p < (((n * 0.8::DOUBLE) // 1) * 0.5::DOUBLE) // 1 THEN 'train' WHEN p < (n * 0.8::DOUBLE) // 1 THEN 'unused' WHEN p < (n * (0.8::DOUBLE + 0.1::DOUBLE)) // 1 THEN 'val' ELSE 'test' END AS split FROM p""")
def partial_train_split(spark, sf_dir):
    """Keys by split, with half of the train keys left unused."""
    return split_keys(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", (0.8, 0.1), 6, 0.5).select("c_custkey", "split")
