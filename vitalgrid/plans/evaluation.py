"""Queries of evaluation by task, communities, chat rows and drawn datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import communities as C
from ..operators import evaluate as E
from ..operators import groups as G
from ..operators import retrieval as R
from ..operators.agent import echo_llm
from ..operators.groups import ordered_position
from ..operators.traces import instruction_rows
from ..sources.registry import Tags, chat_rows
from ..sources.tables import table
from .common import ORACLES, query
from .graph import _NODES, _nodes
from .metrics import _binary, _cell_rows, _classes
from .text import _NORM, _SQ, _WORDS
from .traces import _LOC, _ONE, _traces


def _values(task: str, mode: str, found: dict[str, tuple[str, ...]]) -> str:
    """SQL of a task's metrics from the SQL of single ones: query -> its columns, those renamed as (column, metric)."""
    parts = []
    for name, columns in found.items():
        for c in columns:
            column, metric = c if isinstance(c, tuple) else (c, c)
            parts.append(f"SELECT '{task}' AS task, '{metric}' AS metric, (SELECT {column} FROM ({ORACLES[name]}))::DOUBLE AS value")
    return " UNION ALL ".join(parts)


_SAMPLES = ("jaccard_samples", "f1_samples", "precision_samples", "recall_samples")


@query(" UNION ALL ".join([
    _values("REA", "binary", {"binary_auc": ("roc_auc",), "binary_ap": ("pr_auc",), "binary_confusion": ("precision", "recall", "accuracy", "balanced_accuracy")}),
    _values("LOS", "multiclass", {"multiclass_auc_ovr": (("weighted_ovr", "roc_auc_weighted_ovr"),), "multiclass_f1": ("accuracy", ("kappa", "cohen_kappa"), "f1_weighted")}),
    _values("REC", "multilabel", {"multilabel_scores": _SAMPLES, "multilabel_average_precision": (("samples", "pr_auc_samples"),), "multilabel_auc_averages": (("samples", "roc_auc_samples"),)}),
]))
def task_evaluations(spark, sf_dir):
    """The metrics that three tasks report, each from its kind of table."""
    cells = _cell_rows(spark, sf_dir).withColumn("predicted", F.transform("score", lambda s: (s >= 0.4).cast("int")))
    rows = {"REA": _binary(spark, sf_dir), "LOS": _classes(spark, sf_dir).select("y", "scores"), "REC": cells}
    out = None
    for task, df in rows.items():
        part = E.evaluate(df, task).select(F.lit(task).alias("task"), "metric", F.round("value", 9).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def summary_evaluation(spark, sf_dir):
    """All metrics of summaries: the first line of a text as the summary of what follows it."""
    from .text import _pairs

    return E.evaluate(_pairs(spark, sf_dir).select(F.col("doc_id").alias("key"), F.col("a").alias("predicted"), F.col("c").alias("y"), F.col("b").alias("source")), "SUMMARY")


@query("""WITH p AS (SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p FROM documents WHERE text IS NOT NULL) SELECT lang AS community, p // 100 AS chunk, count(*)::INT AS n, md5(string_agg(text, ', ' ORDER BY doc_id)) AS texts_md5 FROM p GROUP BY ALL""")
def community_chunk_texts(spark, sf_dir):
    """Texts of a language in chunks of a hundred, in the order of their ids."""
    c = C.community_chunks(table(spark, sf_dir, "documents"), "lang", "doc_id", "text", 100)
    return c.select("community", "chunk", "n", F.md5(F.array_join("texts", ", ")).alias("texts_md5"))


@query()
def community_descriptions(spark, sf_dir):
    """What the stub model says of chunks of documents whose vectors are in one of ten communities."""
    d = table(spark, sf_dir, "documents").join(R.communities(table(spark, sf_dir, "embeddings"), 10).select(F.col("vec_id").alias("doc_id"), "community"), "doc_id")
    return C.described_communities(d, "community", "doc_id", "text", echo_llm, 100)


@query(f"""WITH {_NODES} SELECT row_number() OVER (ORDER BY node_id) - 1 AS id, node_id, CASE WHEN CAST('0x' || substr(md5('describe: ' || node_name), 1, 2) AS INT) % 2 = 1 THEN 'yes: ' ELSE 'no: ' END || 'describe: ' || node_name AS description FROM nodes WHERE node_type = 'nation'""")
def node_descriptions(spark, sf_dir):
    """What the stub model says of each nation, numbered by id."""
    return C.described_nodes(_nodes(spark, sf_dir), "nation", echo_llm)


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, count(*) OVER (PARTITION BY source) AS total FROM documents")
def positions_in_source(spark, sf_dir):
    """A document's place among those of its source, by id."""
    return ordered_position(table(spark, sf_dir, "documents").select("source", "doc_id"), "doc_id", "source")


_TURNS = "WITH m AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id)"


@query(f"""{_TURNS}, s AS (SELECT conv_id, CASE WHEN m[1].role = 'system' THEN m[1].text END AS system, CASE WHEN m[1].role = 'system' THEN m[2:] ELSE m END AS m FROM m),
k AS (SELECT * FROM s WHERE len(m) > 0 AND len(m) % 2 = 0 AND len(list_filter(m, lambda x, i: x.role = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) = len(m))
SELECT conv_id, system, m[-2].text AS prompt, m[-1].text AS response, array_to_string(list_transform(m[1:len(m) - 2], lambda x: x.text), '|') AS history FROM k""")
def chat_dataset(spark, sf_dir):
    """Conversations whose turns alternate, as system, history, prompt and response."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("messages"))
    rows = chat_rows(c, "messages", Tags(role="role", content="text", user="user", assistant="assistant"))
    return rows.select("conv_id", "system", "prompt", "response", F.array_join("history", "|").alias("history"))


@query(f"""WITH r AS ({ORACLES["trace_reshape"]}), q AS (SELECT *, conv_id || '-' || step || '-' || kind AS key FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5(key || '-3'), key) - 1 AS p FROM q), c AS (SELECT count(*) FILTER (kind IN ('terminal', 'no_gold_path')) // 5 AS cap FROM q)
SELECT kind, key FROM p, c WHERE kind IN ('terminal', 'no_gold_path') OR (p < cap AND kind IN ('rewrite', 'followup', 'meta_chose', 'final_answer', 'decision'))""")
def training_mixture(spark, sf_dir):
    """Instruction rows of all kinds, with caps; one kind is left out for this source and task."""
    rows = instruction_rows(_traces(spark, sf_dir), "conv_id").withColumn("key", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("step").cast("string"), "kind"))
    return G.training_mix(rows, "key", "MIV-MOR", divisor=5, seed=3).select("kind", "key")


@query("""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '-2'), doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN p < 50 THEN 'val' ELSE 'train' END AS fixed, CASE WHEN p < ceil(n * 0.15::DOUBLE) THEN 'val' ELSE 'train' END AS share FROM p""")
def validation_splits(spark, sf_dir):
    """Fifty rows, and fifteen per cent of the rows, for validation."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    a, b = (G.validation_split(d, "doc_id", x, 2).withColumnRenamed("split", n) for x, n in ((50, "fixed"), (0.15, "share")))
    return a.join(b, "doc_id")


@query(f"""WITH {_NODES}, k AS (SELECT node_type, node_id, node_name, row_number() OVER (PARTITION BY node_type ORDER BY node_id) - 1 AS p FROM nodes WHERE node_type IN ('nation', 'supplier')) SELECT node_type AS community, p // 40 AS chunk, count(*)::INT AS n, string_agg(node_name, '|' ORDER BY node_id) AS texts FROM k GROUP BY ALL""")
def subgraph_texts(spark, sf_dir):
    """Names of the nodes of an induced subgraph by type, in chunks of forty."""
    kept = _nodes(spark, sf_dir).where(F.col("node_type").isin("nation", "supplier"))
    return C.community_chunks(kept, "node_type", "node_id", "node_name", 40).withColumn("texts", F.array_join("texts", "|"))


@query(f"""WITH w AS (SELECT doc_id, len({_WORDS('text')}) AS n FROM documents) SELECT doc_id, n::INT AS n_words FROM w WHERE n >= 60 ORDER BY md5(doc_id || '-8'), doc_id LIMIT 1000""")
def token_filtered(spark, sf_dir):
    """Rows of sixty words or more, the first thousand in seeded order: the cap is the feature."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(T.words("text")).alias("n_words")).where("n_words >= 60")
    return d.orderBy(G.hashed("doc_id", F.lit(8)), "doc_id").limit(1000)


@query(f"""WITH r AS (SELECT conv_id, arg_max(text, turn) AS t, CASE WHEN conv_id % 3 = 0 THEN 'yes' ELSE 'no' END AS g FROM conversations GROUP BY 1), l AS (SELECT g, {_LOC(_ONE('t'))} AS a FROM r), x AS (SELECT (g = 'yes')::INT AS y, contains({_NORM('a')}, 'yes')::INT AS p, NOT contains({_NORM('a')}, 'yes') AND NOT contains({_NORM('a')}, 'no') AS none FROM l),
c AS (SELECT count(*) FILTER (y = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (y = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (y = 1 AND p = 0)::DOUBLE AS fn, count(*) FILTER (y = 0 AND p = 0)::DOUBLE AS tn, avg(none::INT) AS no_answer FROM x),
d AS (SELECT *, tp / nullif(tp + fn, 0) AS tpr, tn / nullif(tn + fp, 0) AS tnr, tp + fp + fn + tn AS n FROM c)
SELECT 'roc_auc' AS metric, round((tpr + tnr) / 2, 9) AS value FROM d UNION ALL SELECT 'pr_auc', round(coalesce(tp / nullif(tp + fp, 0), 0) * tpr + (tp + fn) / n * (1 - tpr), 9) FROM d UNION ALL SELECT 'precision', round(coalesce(tp / nullif(tp + fp, 0), 0), 9) FROM d UNION ALL SELECT 'recall', round(coalesce(tpr, 0), 9) FROM d
UNION ALL SELECT 'accuracy', round((tp + tn) / n, 9) FROM d UNION ALL SELECT 'balanced_accuracy', round((coalesce(tpr, 0) + coalesce(tnr, 0)) / 2, 9) FROM d UNION ALL SELECT 'no_answer', round(no_answer, 9) FROM d""")
def answer_evaluation(spark, sf_dir):
    """The last texts of conversations as answers to a yes-or-no task, from parsing to its metrics."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("predicted"))
    rows = c.withColumn("gold", F.when(F.col("conv_id") % 3 == 0, "yes").otherwise("no"))
    return E.evaluate_answers(rows, "REA").select("metric", F.round("value", 9).alias("value"))


@query(f"""SELECT conv_id, turn, {_SQ("replace(text, '⋮', '')")} AS question FROM conversations""")
def chat_questions(spark, sf_dir):
    """The question of a rendered chat; each text is rendered between the headers of user and assistant."""
    c = table(spark, sf_dir, "conversations")
    chat = F.concat(F.lit("<|start_header_id|>system<|end_header_id|>s" + T._CHAT[0] + " ⋮ "), "text", F.lit("\n" + T._CHAT[1] + " a" + T._CHAT[0]))
    return c.select("conv_id", "turn", T.chat_question(chat).alias("question"))


@query("""WITH p AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS t, (2000 + page_id % 20)::VARCHAR AS y FROM pages), w AS (SELECT *, list_filter(string_split(trim(regexp_replace(t, '[ \\t\\n\\r\\f]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM p)
SELECT page_id, concat_ws(', ', nullif(CASE WHEN len(w) > 2 THEN left(array_to_string(list_filter(w, lambda x: length(x) > 3), ' '), 30) ELSE t END, ''), y) AS journal, CASE WHEN len(w) > 1 THEN w[1] || ' ' || array_to_string(list_transform(w[2:], lambda x: left(x, 1)), '') ELSE coalesce(w[1], '') END AS author FROM w""")
def journal_names(spark, sf_dir):
    """Short forms of titles with a year, and the first word of a title with the initials of the others."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    words = T.squeeze(title)
    last = F.split_part(words, F.lit(" "), F.lit(1))
    p = table(spark, sf_dir, "pages").select("page_id", title.alias("t"), last.alias("last"), F.regexp_replace(words, "^[^ ]*", "").alias("fore"), (2000 + F.col("page_id") % 20).cast("string").alias("y"))
    return p.select("page_id", T.journal_text(F.col("t"), F.col("y")).alias("journal"), T.author_name(F.col("last"), F.col("fore")).alias("author"))


@query(f"""WITH {_NODES} SELECT string_agg('ID: ' || metapath_id || chr(10) || 'Meta_path: ' || path || chr(10), chr(10) ORDER BY metapath_id) AS text FROM mp""")
def metapath_text(spark, sf_dir):
    """The meta-paths of the graph as the text of a prompt."""
    from ..operators.graph import metapath_catalog
    from .graph import _triples

    return metapath_catalog(_triples(spark, sf_dir)).agg(T.path_list("metapath_id", "path").alias("text"))
