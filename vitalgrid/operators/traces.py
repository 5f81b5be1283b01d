"""Reasoning traces: steps to instruction rows, and rewards over steps.

A trace is a row with ``query``, ``groundtruth`` and ``path``, an array of step structs (source, subquery,
subanswer, decision, chosen, history, final).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STEP = "struct<source:string,subquery:string,subanswer:string,decision:string,chosen:array<int>,history:string,final:string>"


def steps(traces: DataFrame, key: str) -> DataFrame:
    """One row a step: its place, whether it is the last, and the history of the step before."""
    rows = traces.select(key, "query", "groundtruth", F.size("path").alias("n_steps"), F.posexplode("path").alias("step", "s"))
    before = F.lag("s.history", 1, "").over(Window.partitionBy(key).orderBy("step"))
    return rows.select(key, "query", "groundtruth", "n_steps", "step", "s.*", before.alias("before"), (F.col("step") == F.col("n_steps") - 1).alias("terminal"))


#: kind -> (rows it is made from, input, output)
KINDS = {
    "rewrite": (lambda: F.col("step") == 0, lambda: F.col("query"), lambda: F.col("subquery")),
    "decision": (lambda: F.lit(True), lambda: F.col("subquery"), lambda: F.col("decision")),
    "meta_chose": (lambda: (F.col("source") == "RAG") & (F.size("chosen") > 0), lambda: F.col("subquery"), lambda: F.array_join(F.col("chosen").cast("array<string>"), ",")),
    "sub_response": (lambda: F.lit(True), lambda: F.concat_ws("\n", "before", "subquery"), lambda: F.col("subanswer")),
    "followup": (lambda: ~F.col("terminal"), lambda: F.col("history"), lambda: F.lit("continue")),
    "terminal": (lambda: F.col("terminal"), lambda: F.col("history"), lambda: F.col("final")),
    "final_answer": (lambda: F.col("terminal"), lambda: F.concat_ws("\n", "query", "history"), lambda: F.col("groundtruth")),
}


def instruction_rows(traces: DataFrame, key: str) -> DataFrame:
    """(key, step, kind, input, output): rows of every kind, and no_gold_path for traces without steps."""
    s = steps(traces, key)
    kinds = F.array(*(F.when(cond(), F.struct(F.lit(k).alias("kind"), a().alias("input"), b().alias("output"))) for k, (cond, a, b) in KINDS.items()))
    rows = s.select(key, "step", F.explode(F.array_compact(kinds)).alias("r")).select(key, "step", "r.*")
    empty = traces.where("size(path) = 0").select(key, F.lit(0).alias("step"), F.lit("no_gold_path").alias("kind"), F.col("query").alias("input"), F.col("groundtruth").alias("output"))
    return rows.unionByName(empty)


def policy_rows(traces: DataFrame, key: str, final: Column) -> DataFrame:
    """(key, kind, input, output): what a policy is trained on, retrieved knowledge left out.

    Every trace gives a row without history, one with steps also its terminal row; both end in ``final``, the policy's own answer.
    """
    last = F.try_element_at("path", F.lit(-1))["history"]
    row = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("input"), final.alias("output"))
    rows = F.array(row("no_gold_path", F.col("query")), F.when(F.size("path") > 0, row("terminal", F.concat_ws("\n", "query", last))))
    return traces.select(key, F.explode(F.array_compact(rows)).alias("r")).select(key, "r.*")


#: What a baseline's right answers give beside their outcome pair: kind -> (input, output)
GATED = {
    "decision": (lambda: F.concat_ws("\n", F.lit("decide:"), "query"), lambda: F.col("decision")),
    "rag": (lambda: F.concat_ws("\n", F.lit("answer:"), "query", "kg_results", "naive_results"), lambda: F.col("groundtruth")),
}


def gated_rows(rows: DataFrame, key: str, right: Column, kinds: dict = GATED) -> DataFrame:
    """(key, kind, input, output): rows of ``kinds`` where ``right``, else a row ``wrong`` of query and truth; and ``pure_path`` for every row.

    A null ``right`` counts as false.
    """
    ok, pair = F.coalesce(right, F.lit(False)), (F.col("query"), F.col("groundtruth"))
    made = lambda when, kind, x: F.when(when, F.struct(F.lit(kind).alias("kind"), x[0].alias("input"), x[1].alias("output")))
    all_ = [made(ok, k, (a(), b())) for k, (a, b) in kinds.items()] + [made(~ok, "wrong", pair), made(F.lit(True), "pure_path", pair)]
    return rows.select(key, F.explode(F.array_compact(F.array(*all_))).alias("r")).select(key, "r.*")


def plain_rows(rows: DataFrame, key: str, split: str) -> DataFrame:
    """(key, kind, instruction, input, output): query and truth as they are; train rows as pure_path and all_data, others as pure_path_test."""
    kinds = F.when(F.col(split) == "train", F.array(F.lit("pure_path"), F.lit("all_data"))).otherwise(F.array(F.lit("pure_path_test")))
    return rows.select(key, F.explode(kinds).alias("kind"), F.lit("").alias("instruction"), F.col("query").alias("input"), F.col("groundtruth").alias("output"))


def length_penalty(answer: Column, most: int = 10) -> Column:
    """-0.5 for an answer of more than ``most`` words, else 0; a null one has none."""
    return F.when(F.size(F.filter(F.split(F.coalesce(answer, F.lit("")), "\\s+"), lambda w: w != "")) > most, -0.5).otherwise(0.0)


def length_reward(n_steps: Column) -> Column:
    """0 for up to three steps, half less for each more."""
    return 1 - 0.5 * (F.greatest(n_steps, F.lit(3)) - 1)


def path_reward(chosen: Column, legal: Column, share: float = 0.3) -> Column:
    """1 or -0.5 by the mean over retrieval steps (an array of their choices) of right ones less half of wrong and of repeated ones.

    Each step counts its distinct choices. The mean is taken over the expected number; -0.5 below a tenth of it. 0 without retrieval steps.
    """
    repeated = lambda c: F.size(F.filter(F.array_distinct(c), lambda x: F.size(F.filter(c, lambda y: y == x)) > 1))
    step = lambda c: F.size(F.array_intersect(c, legal)) - 0.5 * F.size(F.array_except(c, legal)) - 0.5 * repeated(c)
    total = F.aggregate(F.transform(chosen, step), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(chosen) == 0, 0.0).when(total / F.size(chosen) / (F.size(legal) * share) < 0.1, -0.5).otherwise(1.0)


def retrieval_reward(answer: Column, question: Column, subquery: Column, gold: Column) -> Column:
    """0.5 or -0.5 by distinct words shared with question, sub-query and gold, per character of the answer; null for an empty one."""
    from ..functions.text import token_overlap as shared

    score = (2 * (shared(answer, question) + shared(answer, subquery)) + 10 * shared(answer, gold)) / F.length(answer)
    return F.when(F.length(answer) > 0, F.when(score < 0.15, -0.5).otherwise(0.5))


def outcome_reward(predicted: Column, gold: Column, task: str = "binary") -> Column:
    """5 if the located answer means the same as the gold one in its task."""
    from ..functions.text import locate_answer, parsed_answers

    forms = parsed_answers(locate_answer(predicted), gold, task)
    return F.when(forms["predicted"] == forms["gold"], 5.0).otherwise(0.0)


def answer_rank(gold: Column, query: Column, own: Column, negative: Column) -> Column:
    """1 if the own history matches the gold answer (of a yes or no: the query) better than the negative history, else 0."""
    from ..functions.text import match_ratio

    asked = F.when(gold.isin("yes", "no"), query).otherwise(gold)
    return F.when(match_ratio(asked, own) > match_ratio(asked, negative), 1.0).otherwise(0.0)


def rank_reward(own: Column, positive: Column, negative: Column) -> Column:
    """0.1 if the own last history shares more words with the positive trace's than with the negative one's, else -0.1; 0 without a positive trace.

    A null own or negative history has no words.
    """
    from ..functions.text import token_overlap as shared

    own, negative = F.coalesce(own, F.lit("")), F.coalesce(negative, F.lit(""))
    return F.when(positive.isNull(), 0.0).when(shared(own, positive) > shared(own, negative), 0.1).otherwise(-0.1)


def rewards(traces: DataFrame, key: str, legal: list[int], task: str = "binary") -> DataFrame:
    """(key, length, path, retrieval, outcome, rank, total): all rewards of a trace, in one pass over its steps.

    ``positive`` and ``negative`` are the last histories of the other two traces. The outcome compares the last
    sub-answer with the truth as ``task`` has it (see ``parsed_answers``); a trace without steps has no outcome.
    """
    s = steps(traces, key)
    rag = F.col("source") == "RAG"
    per = s.withColumn("r", F.when(rag, retrieval_reward(F.col("subanswer"), F.col("query"), F.col("subquery"), F.col("groundtruth"))))
    sums = per.groupBy(key).agg(
        F.avg("r").alias("retrieval"), F.collect_list(F.when(rag, F.col("chosen"))).alias("chosen"), F.max("n_steps").alias("n_steps"), F.max_by("subanswer", "step").alias("answer"), F.max_by("history", "step").alias("own")
    )
    rows = traces.select(key, "groundtruth", "positive", "negative").join(sums, key, "left")
    none = F.col("n_steps").isNull()
    choice = F.coalesce("chosen", F.array().cast("array<array<int>>"))
    out = rows.select(
        key, F.when(none, 0.0).otherwise(length_reward(F.col("n_steps"))).alias("length"), F.when(none, 0.0).otherwise(path_reward(choice, F.array(*map(F.lit, legal)))).alias("path"),
        F.coalesce("retrieval", F.lit(0.0)).alias("retrieval"), F.when(none, 0.0).otherwise(outcome_reward(F.col("answer"), F.col("groundtruth"), task)).alias("outcome"),
        rank_reward(F.col("own"), F.col("positive"), F.col("negative")).alias("rank"),
    )
    return out.withColumn("total", F.col("length") + F.col("path") + F.col("retrieval") + F.col("outcome") + F.col("rank"))
