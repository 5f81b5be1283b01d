"""Queries for sessions and the question loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agent as A
from ..operators import paths as P
from ..operators.traces import instruction_rows
from ..sources.tables import table
from ..streaming.sessions import event_sessions
from .common import query
from .text import _NORM
from .traces import _LOC, _ONE


@query("""WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM e)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, sid""")
def event_session_visits(spark, sf_dir):
    """Events of a user with gaps under 30 minutes as one visit."""
    s = event_sessions(table(spark, sf_dir, "events"))
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", F.round("total", 6).alias("total"))


def _asked(spark, sf_dir):
    """User turns as questions, and what adds the first text of their conversation to rows as context."""
    c = table(spark, sf_dir, "conversations")
    questions = c.where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.col("text").alias("question"), F.when(F.col("conv_id") % 3 == 0, "yes").otherwise("no").alias("groundtruth"))
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("context")).select(F.col("conv_id").cast("string").alias("_c"), "context")
    return questions, lambda rows: rows.join(first, F.split_part("qid", F.lit("-"), F.lit(1)) == F.col("_c"), "left").drop("_c")


@query()
def agent_trace_stub(spark, sf_dir):
    """The question loop with the stub model over all user turns; context is the conversation's first text."""
    questions, retrieve = _asked(spark, sf_dir)
    return A.answer_questions(questions.drop("groundtruth"), retrieve)


@query()
def sampled_paths(spark, sf_dir):
    """Golden and negative paths of all user turns with the stub model: sources, decisions and the last history of each."""
    p = P.sample_paths(*_asked(spark, sf_dir), "binary")
    return p.select("qid", "kind", "n", F.array_join(F.transform("path", lambda s: s["source"]), ">").alias("sources"), F.md5(F.element_at("path", -1)["history"]).alias("history_md5"))


@query()
def generated_instructions(spark, sf_dir):
    """Instruction rows of the golden paths of all user turns, sampled with the stub model."""
    questions, retrieve = _asked(spark, sf_dir)
    traces = P.traces_from_paths(questions, P.sample_paths(questions, retrieve, "binary"))
    return instruction_rows(traces, "qid").select("qid", "step", "kind", F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5"))


@query()
def predicted_paths(spark, sf_dir):
    """The answering loop with the stub model over all user turns: answer, the golden path's sources, and negative paths."""
    p = P.predict_paths(*_asked(spark, sf_dir), A.checking_llm)
    sources = lambda path: F.array_join(F.transform(path, lambda s: s["source"]), ">")
    return p.select("qid", "answer", sources("golden").alias("golden"), F.array_join(F.transform("negatives", sources), "|").alias("negatives"))


_RIGHT = {
    "binary": f"contains({_NORM('a')}, {_NORM('g')})",
    "stay": f"coalesce(TRY_CAST(list_last(regexp_extract_all({_NORM('a')}, '[0-9]+')) AS BIGINT) = TRY_CAST(regexp_extract_all({_NORM('g')}, '[0-9]+')[1] AS BIGINT), false)",
    "single": "coalesce(nullif(regexp_extract(a, '(A|B|C|D)', 1), ''), trim(a)) = coalesce(nullif(regexp_extract(g, '(A|B|C|D)', 1), ''), trim(g))",
    "summary": f"coalesce(len(list_intersect(list_distinct(string_split({_NORM('a')}, '')), list_distinct(string_split({_NORM('g')}, '')))) / nullif(len(list_distinct(string_split({_NORM('g')}, ''))), 0), 0) >= 0.2",
}


@query(f"""WITH r AS (SELECT conv_id, arg_min(text, turn) AS p, substr(arg_max(text, turn), length(arg_max(text, turn)) - 9) AS g FROM conversations GROUP BY 1), l AS (SELECT conv_id, g, {_LOC(_ONE('p'))} AS a FROM r)
SELECT conv_id, {', '.join(f'{x} AS {n}' for n, x in _RIGHT.items())} FROM l""")
def right_answers(spark, sf_dir):
    """Whether a conversation's first text answers to the end of its last, as each kind of task checks it."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("p"), F.max_by("text", "turn").alias("last"))
    g = F.expr("substring(last, greatest(length(last) - 9, 1))")
    return c.select("conv_id", *(P.is_right("p", g, task).alias(task) for task in _RIGHT))


@query("SELECT conv_id, turn, CASE WHEN contains(lower(text), 'yes') THEN 'RAG' ELSE 'LLM' END AS source FROM conversations")
def decide_action(spark, sf_dir):
    """Retrieval or not, by a reply."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", A.decision(F.col("text")).alias("source"))


@query("SELECT doc_id, array_to_string((list_filter(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: TRY_CAST(x AS BIGINT)), lambda x: x < 10))[1:3], ',') AS chosen FROM documents")
def select_metapaths(spark, sf_dir):
    """The first numbers below ten in a reply."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(A.chosen_paths(F.col("text"), 10, 0.3).cast("array<string>"), ",").alias("chosen"))
