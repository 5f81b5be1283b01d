"""Training rows of baselines and policies, answer chunks, and profiles of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cohort as C
from ..operators import groups as G
from ..operators import traces as R
from ..sources.files import schema_profile
from ..sources.tables import table
from ..sources.visits import VISITS_SQL, order_visits
from .cohort import _FULL, _least
from .common import joined, query
from .text import _NORM
from .traces import _T, _traces


@query(f"""{_T}, f AS (SELECT g.*, arg_max(history, step) AS history, arg_max(final, step) AS final FROM g LEFT JOIN s USING (conv_id) GROUP BY ALL)
SELECT conv_id, 'no_gold_path' AS kind, query AS input, coalesce(final, groundtruth) AS output FROM f UNION ALL SELECT conv_id, 'terminal', query || chr(10) || history, final FROM f WHERE history IS NOT NULL""")
def policy_reshape(spark, sf_dir):
    """Rows a policy is trained on: its answer without history, and after the last step."""
    final = F.coalesce(F.try_element_at("path", F.lit(-1))["final"], F.col("groundtruth"))
    return R.policy_rows(_traces(spark, sf_dir), "conv_id", final)


@query("""WITH d AS (SELECT doc_id, text AS query, lang AS groundtruth, source, toxic, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS decision FROM documents JOIN labels USING (doc_id))
SELECT doc_id, 'decision' AS kind, md5('decide:' || chr(10) || query) AS input_md5, decision AS output FROM d WHERE toxic = 1 UNION ALL SELECT doc_id, 'rag', md5('answer:' || chr(10) || query || chr(10) || source || chr(10) || lang), groundtruth FROM d JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) WHERE toxic = 1
UNION ALL SELECT doc_id, 'wrong', md5(query), groundtruth FROM d WHERE toxic IS DISTINCT FROM 1 UNION ALL SELECT doc_id, 'pure_path', md5(query), groundtruth FROM d""")
def baseline_reshape(spark, sf_dir):
    """Decision and answer rows of right answers, plain pairs of the others; the toxic label stands for a right answer, source and language for what was retrieved."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.select("doc_id", F.col("text").alias("query"), F.col("lang").alias("groundtruth"), F.col("source").alias("kg_results"), F.col("lang").alias("naive_results"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("decision"), "toxic")
    return R.gated_rows(d, "doc_id", F.col("toxic") == 1).select("doc_id", "kind", F.md5("input").alias("input_md5"), "output")


@query(f"""{_T}, p AS (SELECT conv_id, query, groundtruth, conv_id % 10 < 8 AS train FROM g)
SELECT conv_id, kind, '' AS instruction, query AS input, groundtruth AS output FROM p, (SELECT unnest(['pure_path', 'all_data', 'pure_path_test']) AS kind) WHERE train = (kind <> 'pure_path_test')""")
def plain_reshape(spark, sf_dir):
    """Query and truth as instruction rows, train rows under two kinds."""
    t = _traces(spark, sf_dir).withColumn("split", F.when(F.col("conv_id") % 10 < 8, "train").otherwise("test"))
    return R.plain_rows(t, "conv_id", "split")


@query(f"""{_T} SELECT conv_id, step, CASE WHEN len(list_filter(regexp_split_to_array(subanswer, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) > 10 THEN -0.5 ELSE 0.0 END::DOUBLE AS penalty FROM st""")
def length_penalties(spark, sf_dir):
    """A penalty for every answer of more than ten words."""
    return R.steps(_traces(spark, sf_dir), "conv_id").select("conv_id", "step", R.length_penalty(F.col("subanswer")).alias("penalty"))


@query(f"""WITH p AS (SELECT conv_id, {_NORM('arg_max(text, turn)')} AS p, CASE WHEN conv_id % 3 = 0 THEN 'yes' ELSE 'no' END AS gold FROM conversations WHERE role <> 'system' GROUP BY conv_id)
SELECT gold, count(*) AS n, round(avg(CAST((contains(p, 'yes')) = (gold = 'yes') AS INT)), 9) AS accuracy FROM p GROUP BY gold""")
def training_pair_accuracy(spark, sf_dir):
    """Share of logged pairs whose parsed prediction and truth agree; a yes counts wherever it stands."""
    c = table(spark, sf_dir, "conversations").where("role <> 'system'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("p"))
    c = c.withColumn("gold", F.when(F.col("conv_id") % 3 == 0, "yes").otherwise("no")).withColumn("f", T.parsed_answers("p", "gold", "binary"))
    return c.groupBy("gold").agg(F.count("*").alias("n"), F.round(F.avg((F.col("f.predicted") == F.col("f.gold")).cast("double")), 9).alias("accuracy"))


@query(f"""WITH {VISITS_SQL}, f AS (SELECT * FROM visits WHERE {_FULL}), {_least('f', 2)} SELECT visit_id AS id, array_to_string(conditions, '|') || array_to_string(procedures, '|') || array_to_string(drugs, '|') || ' Answer: ' || discharge_status AS text FROM s""")
def cohort_chunks(spark, sf_dir):
    """A sample's codes and its answer as a text to be retrieved, by the visit's own id."""
    s = C.build_samples(order_visits(spark, sf_dir), "stay", least=2, history=(), label=F.col("discharge_status"))
    return s.select(F.col("visit_id").alias("id"), F.concat(joined("conditions"), joined("procedures"), joined("drugs"), F.lit(" Answer: "), "label").alias("text"))


@query("SELECT doc_id AS id, text || ' Answer: ' || lang AS text, len(embedding) AS dimensions FROM documents JOIN embeddings ON vec_id = doc_id")
def answer_chunks(spark, sf_dir):
    """Texts with their answers, by id, and their vectors: what a store of a user's chunks holds."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return d.join(e, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("id"), F.concat("text", F.lit(" Answer: "), "lang").alias("text"), F.size("embedding").cast("long").alias("dimensions"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label ORDER BY n, label LIMIT 5")
def smallest_label_groups(spark, sf_dir):
    """The five labels of fewest rows."""
    return G.smallest_groups(table(spark, sf_dir, "embeddings"), "label", 5)


@query("""SELECT 'vec_id' AS "column", 'bigint' AS type, 0 AS level, NULL::INT AS least, NULL::INT AS most UNION ALL SELECT 'embedding', 'array<float>', 1, min(len(embedding))::INT, max(len(embedding))::INT FROM embeddings UNION ALL SELECT 'label', 'int', 0, NULL, NULL""")
def embedding_profile(spark, sf_dir):
    """Columns of a table with their types, nesting and array sizes."""
    return schema_profile(table(spark, sf_dir, "embeddings"))
