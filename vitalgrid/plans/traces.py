"""Trace, reward and statistics queries: conversations as traces, texts as sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import stats as S
from ..operators import traces as R
from ..session import small_batches
from ..sources.tables import table
from .common import query
from .text import _CONTENT, _NORM, _QUOTED, _RUNS, _SIGNS, _WORDS, _pairs


def _traces(spark, sf_dir):
    """User and assistant turns of a conversation as steps; the first user text is the query, the last text the truth."""
    c = table(spark, sf_dir, "conversations")
    t, half = F.col("turn").cast("int"), F.expr("int(length(text) div 2)")
    step = F.struct(
        t.alias("turn"), F.when(F.col("role") == "user", "RAG").otherwise("LLM").alias("source"), F.left("text", half).alias("subquery"), F.expr("substring(text, length(text) div 2 + 1)").alias("subanswer"),
        F.when(F.col("role") == "user", "yes").otherwise("no").alias("decision"), F.array((t % 7).cast("int"), (F.length("text") % 12).cast("int")).alias("chosen"), F.col("text").alias("history"), F.right("text", F.lit(10)).alias("final"),
    )
    g = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"), F.max_by("text", "turn").alias("last"), F.array_sort(F.collect_list(F.when(F.col("role") != "system", step))).alias("path"))
    path = F.when(F.col("conv_id") % 5 == 0, F.array().cast(f"array<{R.STEP}>")).otherwise(F.transform("path", lambda s: F.struct(*(s[c].alias(c) for c in ("source", "subquery", "subanswer", "decision", "chosen", "history", "final")))))
    return g.select("conv_id", "query", F.expr("substring(last, length(last) div 2 + 1)").alias("groundtruth"), path.alias("path"), F.when(F.col("conv_id") % 2 == 0, F.col("query")).alias("positive"), F.lit("the of and").alias("negative"))


_T = """WITH c AS (SELECT conv_id, CAST(turn AS INT) AS turn, role, text FROM conversations), g AS (SELECT conv_id, arg_min(text, turn) AS query, substr(arg_max(text, turn), length(arg_max(text, turn)) // 2 + 1) AS groundtruth FROM c GROUP BY 1),
s AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS step, count(*) OVER (PARTITION BY conv_id) AS n_steps, CASE WHEN role = 'user' THEN 'RAG' ELSE 'LLM' END AS source, left(text, length(text) // 2) AS subquery, substr(text, length(text) // 2 + 1) AS subanswer, CASE WHEN role = 'user' THEN 'yes' ELSE 'no' END AS decision,
 [turn % 7, CAST(length(text) % 12 AS INT)] AS chosen, text AS history, right(text, 10) AS final FROM c WHERE role <> 'system' AND conv_id % 5 <> 0),
st AS (SELECT s.*, query, groundtruth, coalesce(lag(history) OVER (PARTITION BY s.conv_id ORDER BY step), '') AS before, step = n_steps - 1 AS terminal FROM s JOIN g USING (conv_id))"""


@query(f"""{_T} SELECT conv_id, step, 'rewrite' AS kind, query AS input, subquery AS output FROM st WHERE step = 0 UNION ALL SELECT conv_id, step, 'decision', subquery, decision FROM st UNION ALL SELECT conv_id, step, 'meta_chose', subquery, array_to_string(chosen, ',') FROM st WHERE source = 'RAG'
UNION ALL SELECT conv_id, step, 'sub_response', before || chr(10) || subquery, subanswer FROM st UNION ALL SELECT conv_id, step, 'followup', history, 'continue' FROM st WHERE NOT terminal UNION ALL SELECT conv_id, step, 'terminal', history, final FROM st WHERE terminal
UNION ALL SELECT conv_id, step, 'final_answer', query || chr(10) || history, groundtruth FROM st WHERE terminal UNION ALL SELECT conv_id, 0, 'no_gold_path', query, groundtruth FROM g WHERE conv_id NOT IN (SELECT conv_id FROM s)""")
def trace_reshape(spark, sf_dir):
    """Instruction rows of eight kinds."""
    return R.instruction_rows(_traces(spark, sf_dir), "conv_id")


_OV = lambda a, b: f"len(list_intersect({_RUNS(a)}, {_RUNS(b)}))"
_LOC = lambda x: f"coalesce({', '.join(f"nullif(regexp_extract({x}, '{_QUOTED(p)}', 1), '')" for p in T._LOCATE)}, {x})"
_ONE = lambda x: f"regexp_replace({x}, '[ \\t\\n\\r\\f]+', ' ', 'g')"


@query(f"""{_T}, r AS (SELECT *, CASE WHEN source = 'RAG' AND length(subanswer) > 0 THEN CASE WHEN (2 * ({_OV('subanswer', 'query')} + {_OV('subanswer', 'subquery')}) + 10 * {_OV('subanswer', 'groundtruth')}) / length(subanswer) < 0.15 THEN -0.5 ELSE 0.5 END END AS r FROM st),
one AS (SELECT conv_id, step, x, count(*) AS n FROM (SELECT conv_id, step, unnest(chosen) AS x FROM st WHERE source = 'RAG') GROUP BY ALL),
ch AS (SELECT conv_id, count(DISTINCT step) AS rag, sum(CASE WHEN x < 10 THEN 1 ELSE -0.5 END - CASE WHEN n > 1 THEN 0.5 ELSE 0 END) AS value FROM one GROUP BY conv_id),
a AS (SELECT conv_id, avg(r) AS retrieval, max(n_steps) AS n, arg_max(subanswer, step) AS answer, arg_max(history, step) AS own FROM r GROUP BY conv_id),
b AS (SELECT g.*, retrieval, n, coalesce(own, '') AS own, rag, value, {_NORM(_LOC(_ONE('answer')))} AS p, {_NORM('groundtruth')} AS t FROM g LEFT JOIN a USING (conv_id) LEFT JOIN ch USING (conv_id)),
v AS (SELECT conv_id, CASE WHEN n IS NULL THEN 0 ELSE 1 - 0.5 * (greatest(n, 3) - 1) END AS length, CASE WHEN n IS NULL OR rag IS NULL THEN 0 WHEN value / rag / (10 * 0.3) < 0.1 THEN -0.5 ELSE 1 END AS path, coalesce(retrieval, 0) AS retrieval,
 CASE WHEN n IS NOT NULL AND CAST(contains(p, 'yes') AS INT) = CAST(t = 'yes' AS INT) THEN 5 ELSE 0 END AS outcome, CASE WHEN conv_id % 2 <> 0 THEN 0 WHEN {_OV('own', 'query')} > {_OV('own', "'the of and'")} THEN 0.1 ELSE -0.1 END AS rank FROM b)
SELECT conv_id, CAST(length AS DOUBLE) AS length, CAST(path AS DOUBLE) AS path, CAST(round(retrieval, 9) AS DOUBLE) AS retrieval, CAST(outcome AS DOUBLE) AS outcome, CAST(rank AS DOUBLE) AS rank, round(CAST(length AS DOUBLE) + path + retrieval + outcome + rank, 9) AS total FROM v""")
def reward_table(spark, sf_dir):
    """Length, path, retrieval, outcome and rank rewards, and their sum."""
    r = R.rewards(_traces(spark, sf_dir), "conv_id", list(range(10)))
    return r.select("conv_id", "length", "path", F.round("retrieval", 9).alias("retrieval"), "outcome", "rank", F.round("total", 9).alias("total"))


_OUTCOMES = {
    "binary": (lambda p: f"CAST(contains({_NORM(p)}, 'yes') AS INT)", f"CAST({_NORM('t')} = 'yes' AS INT)"),
    "stay": (lambda p: f"coalesce(CASE WHEN TRY_CAST(list_last(regexp_extract_all({_NORM(p)}, '[0-9]+')) AS BIGINT) < 10 THEN TRY_CAST(list_last(regexp_extract_all({_NORM(p)}, '[0-9]+')) AS BIGINT) END, 0)", f"TRY_CAST(list_last(regexp_extract_all({_NORM('t')}, '[0-9]+')) AS BIGINT)"),
    "single": (lambda p: f"coalesce(nullif(regexp_extract({p}, '(A|B|C|D)', 1), ''), nullif(trim({p}), ''), 'A')", "coalesce(nullif(regexp_extract(t, '(A|B|C|D)', 1), ''), trim(t))"),
    "summary": (lambda p: f"coalesce(nullif({_NORM(p)}, ''), 'NA')", _NORM("t")),
}


@query(f"""WITH r AS (SELECT conv_id, substr(arg_min(text, turn), length(arg_min(text, turn)) // 2 + 1) AS p, arg_max(text, turn) AS t FROM conversations GROUP BY 1), l AS (SELECT conv_id, t, {_LOC(_ONE('p'))} AS p FROM r)
SELECT conv_id, {', '.join(f"CASE WHEN {f('p')} = {t} THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS {n}" for n, (f, t) in _OUTCOMES.items())} FROM l""")
def outcome_rewards(spark, sf_dir):
    """The outcome reward of a conversation's first text against its last, as each kind of task compares them."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.max_by("text", "turn").alias("t"))
    p = F.expr("substring(first, length(first) div 2 + 1)")
    return c.select("conv_id", *(R.outcome_reward(p, F.col("t"), task).alias(task) for task in _OUTCOMES))


@query("WITH h AS (SELECT n_chars // 500 * 500 AS start, count(*) AS n FROM documents GROUP BY 1) SELECT start, n, CAST(sum(n) OVER (ORDER BY start) AS BIGINT) AS cumulative, round(sum(n) OVER (ORDER BY start) / sum(n) OVER (), 9) AS share FROM h")
def length_cdf(spark, sf_dir):
    return S.length_cdf(table(spark, sf_dir, "documents"), "n_chars", 500).withColumn("share", F.round("share", 9))


@query(f"SELECT CAST(sum(v) AS BIGINT) AS valid, CAST(sum(n) AS BIGINT) AS total, round(sum(v) / sum(n), 9) AS ratio, round(CAST(0.0003 AS DOUBLE) * sqrt(sum(v) / count(*) / CAST(131072 AS DOUBLE)), 9) AS rate FROM (SELECT len({_WORDS('text')}) AS n, len(list_filter({_WORDS('text')}, lambda w: length(w) > 3)) AS v FROM documents)")
def valid_token_ratio(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(T.words("text").alias("w")).select(F.size("w").alias("n"), F.size(F.filter("w", lambda x: F.length(x) > 3)).alias("v"))
    return S.valid_ratio(w, "v", "n", 0.0003, 131072.0).select("valid", "total", F.round("ratio", 9).alias("ratio"), F.round("rate", 9).alias("rate"))


@query("SELECT l_orderkey, round(exp(sum(l_discount) FILTER (l_linenumber > 1) / nullif(count(*) FILTER (l_linenumber > 1), 0)), 9) AS perplexity FROM lineitem GROUP BY 1")
def row_perplexity(spark, sf_dir):
    """exp of the mean loss; discounts are losses, the first line is masked."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", (F.col("l_linenumber") > 1).alias("mask"))
    return S.perplexity(t, "l_orderkey", "l_discount", "mask").withColumn("perplexity", F.round("perplexity", 9))


@query("""WITH l AS (SELECT o_custkey AS row_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS segment, o_orderkey % 5 + 1 AS length FROM orders)
SELECT row_id, segment, CAST(length AS BIGINT) AS length, CAST(sum(length) OVER w - length AS BIGINT) AS first, CAST(sum(length) OVER w AS BIGINT) AS end FROM l WINDOW w AS (PARTITION BY row_id ORDER BY segment)""".replace(" AS end FROM", ' AS "end" FROM'))
def pack_seqlens(spark, sf_dir):
    """Segment lengths and offsets from packed masks; a customer's orders are segments."""
    from pyspark.sql.window import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("row_id"), "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("segment"))
    masks = o.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("segment", (F.col("o_orderkey") % 5 + 1).alias("n")))).alias("x"))
    masks = masks.select("row_id", F.concat(F.flatten(F.transform("x", lambda v: F.array_repeat(v["segment"], v["n"].cast("int")))), F.array(F.lit(0), F.lit(0))).alias("mask"))
    return S.sequence_offsets(S.segments(masks, "row_id", "mask"), "row_id").select("row_id", F.col("segment").cast("long").alias("segment"), "length", "first", "end")


@query("""WITH RECURSIVE v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT user_id, i, value AS s FROM v WHERE i = 1 UNION ALL SELECT v.user_id, v.i, r.s * CAST(0.6 AS DOUBLE) + v.value * (1 - CAST(0.6 AS DOUBLE)) FROM r JOIN v ON v.user_id = r.user_id AND v.i = r.i + 1)
SELECT user_id, i AS position, round(s, 6) AS smoothed FROM r""")
def ema_smooth(spark, sf_dir):
    """Exponential smoothing of each user's values in time order."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("x"))
    s = e.select("user_id", F.posexplode(S.smoothed(F.transform("x", lambda v: v["value"]), F.lit(0.6))).alias("i", "s"))
    return s.select("user_id", (F.col("i") + 1).cast("long").alias("position"), F.round("s", 6).alias("smoothed"))


@query()
def rouge_l_scores(spark, sf_dir):
    """Longest common word subsequence of the first line and what follows it."""
    p = _pairs(spark, sf_dir).select("doc_id", T.words("a").alias("a"), T.words("c").alias("b"))
    return small_batches(p).select("doc_id", F.round(S.rouge_l("a", "b"), 9).alias("rouge_l"))


@query("SELECT event_type, round(sum(value * user_id) / sum(user_id), 6) AS mean FROM events GROUP BY 1")
def weighted_running_mean(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum(F.col("value") * F.col("user_id")) / F.sum("user_id"), 6).alias("mean"))


_RATIO = lambda a, d: f"(CASE WHEN len({_CONTENT(a)}) > 0 THEN len(list_filter({_CONTENT(a)}, lambda w: contains({_SIGNS(d)}, w))) / (2 * len({_CONTENT(a)})) ELSE 0 END)"


@query(f"""WITH l AS (SELECT conv_id, arg_min(text, turn) AS query, arg_max(text, turn) AS own, CASE WHEN conv_id % 3 = 0 THEN 'yes' ELSE substr(arg_max(text, turn), length(arg_max(text, turn)) // 2 + 1) END AS gold FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN gold IN ('yes', 'no') THEN CASE WHEN {_RATIO('query', 'own')} > {_RATIO('query', 'reverse(own)')} THEN 1.0 ELSE 0.0 END WHEN {_RATIO('gold', 'own')} > {_RATIO('gold', 'reverse(own)')} THEN 1.0 ELSE 0.0 END::DOUBLE AS rank FROM l""")
def answer_ranks(spark, sf_dir):
    """Whether a history matches the answer better than a negative one, here its own text backwards."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"), F.max_by("text", "turn").alias("own"))
    gold = F.when(F.col("conv_id") % 3 == 0, "yes").otherwise(F.expr("substring(own, length(own) div 2 + 1)"))
    return c.select("conv_id", R.answer_rank(gold, F.col("query"), F.col("own"), F.reverse("own")).alias("rank"))
