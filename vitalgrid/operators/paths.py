"""Reasoning paths over all questions at once: sampling of right and wrong paths, and the answering loop.

A question has a queue of sub-queries, each with the path that led to it; the queue is first in, first out, so all items
of one depth come before those of the next. A level of the loop therefore takes one depth of all open questions: a row an
item, with its place in the question's queue. What a question takes from its queue is bounded by ``most`` items.
Levels are written to the shared folder, so a model is never asked twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .agent import LlmFn, _stored, ask, decision, echo_llm, subqueries
from .traces import STEP as TRACE_STEP

STEP = "struct<source:string,subquery:string,subanswer:string,decision:string,context:string,rewrite:string,history:string,final_check:string,follow:string,chosen:array<int>>"

#: How prompts are built from their parts.
PROMPTS: dict[str, Callable[..., Column]] = {
    "rewrite": lambda question: F.concat(F.lit("rewrite: "), question),
    "decide": lambda subquery, history: F.concat_ws(" ", F.lit("decide:"), history, subquery),
    "answer": lambda subquery, history, context: F.concat_ws(" ", F.lit("answer:"), context, history, subquery),
    "check": lambda question, history: F.concat_ws(" ", F.lit("check:"), history, question),
    "follow": lambda subquery, history: F.concat_ws(" ", F.lit("follow:"), history, subquery),
}


def is_right(answer: Column | str, gold: Column | str, task: str, least: float = 0.2) -> Column:
    """Whether an answer is right as ``task`` has it; the answer is located in its text first.

    ``binary``: the normalised answer contains the gold one; ``stay``: its last number is the gold one's first (false
    without numbers); ``single``: the same choice; ``summary``: at least ``least`` of the gold answer's distinct
    characters, both normalised. Null answers and gold ones are empty.
    """
    located = T.locate_answer(F.coalesce(F.col(answer) if isinstance(answer, str) else answer, F.lit("")))
    gold = F.coalesce(F.col(gold) if isinstance(gold, str) else gold, F.lit(""))
    a, g = T.normalize_answer(located), T.normalize_answer(gold)
    if task == "binary":
        return F.contains(a, g)
    if task == "stay":
        return F.coalesce(F.try_element_at(T.numbers(a), F.lit(-1)) == F.try_element_at(T.numbers(g), F.lit(1)), F.lit(False))
    if task == "single":
        return T.multiple_choice(located) == T.multiple_choice(gold)
    if task == "summary":
        return T.character_overlap(a, g) >= least
    raise ValueError(f"no such task: {task}")


def seeds(questions: DataFrame, llm: LlmFn, most: int, prompts: dict = PROMPTS) -> DataFrame:
    """The first ``most`` sub-queries of each question, with the rewrite they are from: a row each, n from 0."""
    asked = questions.withColumn("_made", subqueries(F.col("question"), ask(prompts["rewrite"](F.col("question")), llm)))
    rewrite = F.array_join(F.transform("_made", lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q, F.lit("\n"))), "\n")
    rows = asked.withColumn("rewrite", rewrite).select(*questions.columns, "rewrite", F.posexplode(F.slice("_made", 1, most)).alias("n", "_q"))
    return rows.withColumn("subquery", F.concat(F.lit("Base query: "), "question", F.lit(" \n\nSub query: "), "_q", F.lit("\n"))).drop("_q")


def told(history: Column, path: Column, subquery: Column, answer: Column) -> Column:
    """The history with one more numbered answer."""
    return F.concat(history, F.lit("\n"), F.size(path).cast("string"), F.lit(". "), subquery, F.lit("\nAnswer"), answer)


def _no_choices() -> Column:
    return F.array().cast("array<int>")


def _retrieved(retrieve: Callable[[DataFrame], DataFrame], rows: DataFrame, where: Column) -> DataFrame:
    """``rows`` with context and chosen: what ``retrieve`` adds where asked for, else and for nulls an empty text and no choices."""
    known = retrieve(rows)
    chosen = F.coalesce(F.col("chosen").cast("array<int>"), _no_choices()) if "chosen" in known.columns else _no_choices()
    return known.withColumns({"context": F.when(where, F.coalesce("context", F.lit(""))).otherwise(F.lit("")), "chosen": F.when(where, chosen).otherwise(_no_choices())})


def _step(source: str | Column, subanswer: Column, choice: str | Column, context: Column, history: Column, check: Column, follow: Column, chosen: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    fields = (lit(source), F.col("subquery"), subanswer, lit(choice), context, F.col("rewrite"), history, check, follow, chosen)
    return F.struct(*fields).cast(STEP)


_OPEN = ("qid", "question", "groundtruth", "rewrite", "width", "n", "subquery", "history", "path")


def sample_paths(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], task: str, llm: LlmFn = echo_llm, most: int = 6, prompts: dict = PROMPTS) -> DataFrame:
    """(qid, kind, n, path): golden and negative paths of every question, n in the order in which they are found.

    ``questions`` has qid, question and groundtruth; ``retrieve`` adds ``context``, and ``chosen`` paths if it has them, to rows with a ``subquery``. Two
    sub-queries of a question are the seeds. Every item taken from the queue is answered by the model alone and with
    retrieval; each answer is checked against the truth. The first item with a right one ends the question: its path with
    that answer is golden (the model's own, if both are right) and the other one negative. Else both are negative,
    retrieval first, and each puts a follow-up into the queue, the model's own first. The history with retrieval goes on
    from the one without. After ``most`` items a question ends without a golden path; one without seeds has no rows.
    """
    empty = F.array().cast(f"array<{STEP}>")
    made = seeds(questions.select("qid", "question", "groundtruth"), llm, 2, prompts)
    width = F.count("*").over(Window.partitionBy("qid"))  # one seed or two
    open_ = made.withColumns({"history": F.lit(""), "path": empty, "n": F.col("n").cast("long"), "width": width}).select(*_OPEN)
    out, level = None, 0
    while (1 << level) - 1 < most:
        # before this depth a question has taken (2**level - 1) items for each of its seeds
        open_ = open_.withColumn("turn", F.col("n") + F.col("width") * ((1 << level) - 1))
        rows = open_.where(F.col("turn") < most)
        known = _retrieved(retrieve, rows, F.lit(True))
        sub, past = F.col("subquery"), F.col("history")
        known = known.withColumn("own", ask(prompts["answer"](sub, past, F.lit("")), llm)).withColumn("rag", ask(prompts["answer"](sub, past, F.col("context")), llm))
        known = known.withColumn("h_own", told(past, F.col("path"), sub, F.col("own"))).withColumn("h_rag", told(F.col("h_own"), F.col("path"), sub, F.col("rag")))
        for x in ("own", "rag"):
            known = known.withColumn(f"c_{x}", ask(prompts["check"](F.col("question"), F.col(f"h_{x}")), llm)).withColumn(f"f_{x}", ask(prompts["follow"](sub, F.col(f"h_{x}")), llm))
        known = known.withColumns({f"ok_{x}": F.coalesce(is_right(f"c_{x}", "groundtruth", task), F.lit(False)) for x in ("own", "rag")})
        won = F.min(F.when(F.col("ok_own") | F.col("ok_rag"), F.col("n"))).over(Window.partitionBy("qid"))  # a queue's rows are few
        level_rows = _stored(known.withColumn("won", won).where("won is null or n <= won"))
        ended = F.col("ok_own") | F.col("ok_rag")
        follow = lambda x: F.when(ended, F.lit("")).otherwise(F.col(f"f_{x}"))
        own = _step("LLM", F.col("own"), "no", F.lit(""), F.col("h_own"), F.col("c_own"), follow("own"), _no_choices())
        rag = _step("RAG", F.col("rag"), "yes", F.col("context"), F.col("h_rag"), F.col("c_rag"), follow("rag"), F.col("chosen"))
        first, second = F.when(F.col("ok_own"), own).otherwise(rag), F.when(F.col("ok_own"), rag).otherwise(own)
        kind = lambda name, place, step: F.struct(F.lit(name).alias("kind"), (2 * F.col("turn") + place).alias("place"), F.concat("path", F.array(step)).alias("path"))
        found = F.when(ended, F.array(kind("golden", 0, first), kind("negative", 1, second))).otherwise(F.array(kind("negative", 0, rag), kind("negative", 1, own)))
        part = level_rows.select("qid", F.explode(found).alias("r")).select("qid", "r.*")
        out = part if out is None else out.unionByName(part)
        level += 1
        if (1 << level) - 1 < most:
            nexts = F.array(F.struct((2 * F.col("n")).alias("n"), F.col("f_own").alias("subquery"), F.col("h_own").alias("history"), F.concat("path", F.array(own)).alias("path")), F.struct((2 * F.col("n") + 1).alias("n"), F.col("f_rag").alias("subquery"), F.col("h_rag").alias("history"), F.concat("path", F.array(rag)).alias("path")))
            same = ("qid", "question", "groundtruth", "rewrite", "width")
            open_ = level_rows.where("won is null").select(*same, F.explode(nexts).alias("x")).select(*same, "x.*").select(*_OPEN)
    n = F.row_number().over(Window.partitionBy("qid", "kind").orderBy("place")) - 1
    return out.withColumn("n", n).select("qid", "kind", "n", "path")


def incomplete(reply: Column) -> Column:
    """Whether a check asks to go on."""
    return F.contains(F.lower(reply), F.lit("incomplete"))


def predict_paths(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], llm: LlmFn = echo_llm, most: int = 6, prompts: dict = PROMPTS, seed: int = 0) -> DataFrame:
    """(qid, answer, golden, negatives): the final answer of every question, its path, and hard negative paths.

    A question that its first check finds complete is answered by that check, without paths. Else the queue has one
    sub-query and the question itself; every item is answered by the model alone or with retrieval, as the model decides,
    and checked. The first complete check is the answer, its path golden; the negative one has, for half of the
    questions and items (by hash), the other source and no answer, else the same step. Other items are negative as they
    are, once each, and put a follow-up into the queue. After ``most`` items (or with an empty queue) the path before the last item is
    golden and a last check of its history the answer.
    """
    empty = F.array().cast(f"array<{STEP}>")
    base = questions.select("qid", "question").withColumn("checked", ask(prompts["check"](F.col("question"), F.lit("")), llm))
    base = _stored(base)
    done = base.where(~incomplete(F.col("checked"))).select("qid", F.col("checked").alias("answer"), empty.alias("golden"), F.array().cast(f"array<array<{STEP}>>").alias("negatives"))
    todo = base.where(incomplete(F.col("checked"))).select("qid", "question")
    made = seeds(todo, llm, 1, prompts)
    itself = todo.join(made.select("qid", "rewrite"), "qid", "left").select("qid", "question", F.coalesce("rewrite", F.lit("")).alias("rewrite"), F.col("question").alias("subquery"), F.when(F.col("rewrite").isNull(), 0).otherwise(1).cast("long").alias("n"))
    width = F.count("*").over(Window.partitionBy("qid"))  # one item or two
    open_ = _stored(made.select("qid", "question", "rewrite", "subquery", F.col("n").cast("long").alias("n")).unionByName(itself).withColumns({"history": F.lit(""), "path": empty, "width": width}))
    narrow = open_.where("width = 1").limit(1).count()  # a blank question has no sub-query
    levels, level = None, 0
    while level * (1 if narrow else 2) < most:
        rows = open_.withColumn("turn", F.col("n") + F.col("width") * level).where(F.col("turn") < most)
        sub, past = F.col("subquery"), F.col("history")
        routed = rows.withColumn("source", decision(ask(prompts["decide"](sub, past), llm)))
        rag = F.col("source") == "RAG"
        known = _retrieved(retrieve, routed, rag)
        known = known.withColumn("own", ask(prompts["answer"](sub, past, F.col("context")), llm)).withColumn("told", told(past, F.col("path"), sub, F.col("own")))
        known = known.withColumn("check", ask(prompts["check"](F.col("question"), F.col("told")), llm)).withColumn("follow", ask(prompts["follow"](sub, F.col("told")), llm))
        ok = ~incomplete(F.col("check"))
        won = F.min(F.when(ok, F.col("n"))).over(Window.partitionBy("qid"))  # a queue's rows are few
        known = _stored(known.withColumns({"ok": ok, "won": won}).where("won is null or n <= won"))
        levels = known if levels is None else levels.unionByName(known)
        step = _step(F.col("source"), F.col("own"), F.when(rag, "yes").otherwise("no"), F.col("context"), F.col("told"), F.col("check"), F.when(F.col("ok"), F.lit("")).otherwise(F.col("follow")), F.col("chosen"))
        open_ = known.where("won is null").select("qid", "question", "rewrite", "width", "n", F.col("follow").alias("subquery"), F.col("told").alias("history"), F.concat("path", F.array(step)).alias("path"))
        level += 1
    rag = F.col("source") == "RAG"
    step = _step(F.col("source"), F.col("own"), F.when(rag, "yes").otherwise("no"), F.col("context"), F.col("told"), F.col("check"), F.when(F.col("ok"), F.lit("")).otherwise(F.col("follow")), F.col("chosen"))
    other = _step(F.when(rag, "LLM").otherwise("RAG"), F.lit(""), F.when(rag, "yes").otherwise("no"), F.lit(""), told(F.col("told"), F.col("path"), F.col("subquery"), F.lit("")), F.lit(""), F.lit(""), _no_choices())
    swapped = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("qid").cast("string"), F.col("turn").cast("string"), F.lit(str(seed)))), 1, 2), 16, 10).cast("int") < 128
    negative = F.concat("path", F.array(F.when(F.col("ok") & swapped, other).otherwise(step)))
    per = levels.select("qid", "question", "turn", "ok", "check", "told", "path", F.concat("path", F.array(step)).alias("whole"), negative.alias("negative"))
    ends = per.groupBy("qid").agg(F.max_by(F.struct("question", "ok", "check", "told", "path", "whole"), "turn").alias("e"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "negative"))), lambda x: x["negative"]).alias("negatives"))
    last = ends.select("qid", "e.*", "negatives").withColumn("again", ask(prompts["check"](F.col("question"), F.col("told")), llm))
    return done.unionByName(last.select("qid", F.when(F.col("ok"), F.col("check")).otherwise(F.col("again")).alias("answer"), F.when(F.col("ok"), F.col("whole")).otherwise(F.col("path")).alias("golden"), "negatives"))


def traces_from_paths(questions: DataFrame, paths: DataFrame) -> DataFrame:
    """(qid, query, groundtruth, path, positive, negative): sampled paths as traces, of which instruction rows and rewards are made.

    ``path`` is a question's first golden path, empty without one; ``positive`` is its last history (null without one),
    ``negative`` that of the first negative path.
    """
    last = lambda p: F.try_element_at(p, F.lit(-1))["history"]
    first = paths.where("n = 0").groupBy("qid").agg(*(F.any_value(F.when(F.col("kind") == k, F.struct("path")), True).alias(k) for k in ("golden", "negative")))
    step = F.transform("golden.path", lambda s: F.struct(s["source"].alias("source"), s["subquery"].alias("subquery"), s["subanswer"].alias("subanswer"), s["decision"].alias("decision"), s["chosen"].alias("chosen"), s["history"].alias("history"), s["final_check"].alias("final")))
    rows = questions.select("qid", F.col("question").alias("query"), "groundtruth").join(first, "qid", "left")
    return rows.select("qid", "query", "groundtruth", F.coalesce(step, F.array().cast(f"array<{TRACE_STEP}>")).alias("path"), last(F.col("golden.path")).alias("positive"), last(F.col("negative.path")).alias("negative"))
