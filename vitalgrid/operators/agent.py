"""A bounded retrieve-and-check loop over all questions at once, level by level.

The language model is a function from a series of prompts to a series of replies that runs in
batches on the executors; a deterministic one serves for tests.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import shared_dir

LlmFn = Callable[[pd.Series], pd.Series]


def echo_llm(prompts: pd.Series) -> pd.Series:
    """A stub: yes or no by the hash of the prompt, then the prompt's own last words."""
    bit = lambda p: int(hashlib.md5(p.encode()).hexdigest()[:2], 16) % 2
    return prompts.map(lambda p: f"{'yes' if bit(p) else 'no'}: {' '.join(p.split()[-5:])}")


def checking_llm(prompts: pd.Series) -> pd.Series:
    """The same stub, whose checks are complete or not by the hash of the prompt."""
    bit = lambda p: int(hashlib.md5(p.encode()).hexdigest()[2:4], 16) % 4
    return prompts.map(lambda p: f"{'Complete' if bit(p) == 0 else 'Incomplete'}: {' '.join(p.split()[-3:])}" if p.startswith("check:") else echo_llm(pd.Series([p])).iloc[0])


def ask(prompt: Column, llm: LlmFn) -> Column:
    @F.pandas_udf("string")
    def call(p: pd.Series) -> pd.Series:
        return llm(p.fillna(""))

    return call(prompt)


def decision(reply: Column) -> Column:
    """RAG if the reply has yes anywhere, else LLM."""
    return F.when(F.lower(reply).contains("yes"), "RAG").otherwise("LLM")


def chosen_paths(reply: Column, known: int, share: float) -> Column:
    """The first bround(known * share) numbers of the reply below ``known``."""
    return F.slice(F.filter(T.numbers(reply), lambda x: x < known), 1, F.greatest(F.lit(1), F.bround(F.lit(known * share), 0).cast("int")))


def subqueries(question: Column, reply: Column, most: int = 3) -> Column:
    """Cleaned items of a numbered reply; if these are fewer than three, then those made from the question itself; ``most`` at most."""
    made = T.clean_subqueries(T.numbered_items(reply))
    return F.slice(F.when(F.size(made) < 3, F.concat(made, T.fallback_subqueries(question))).otherwise(made), 1, most)


def _stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, so a level is never computed twice."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def answer_questions(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], llm: LlmFn = echo_llm, depth: int = 3) -> DataFrame:
    """(qid, depth, source, subquery, subanswer, done): one step a level for every open question.

    ``questions`` has qid and question. ``retrieve`` adds ``context`` to rows with a ``subquery``. A question closes
    when its check says yes, or at the last level. Levels are written to the shared folder.
    """
    open_ = questions.select("qid", "question", F.col("question").alias("subquery"), F.lit("").alias("history"))
    out = None
    for level in range(depth):
        routed = open_.withColumn("source", decision(ask(F.concat(F.lit("decide: "), "subquery"), llm)))
        known = retrieve(routed.where("source = 'RAG'")).unionByName(routed.where("source <> 'RAG'").withColumn("context", F.lit("")))
        told = known.withColumn("subanswer", ask(F.concat_ws(" ", F.lit("answer:"), "context", "history", "subquery"), llm))
        checked = told.withColumn("done", T.yes_no(ask(F.concat_ws(" ", F.lit("check:"), "question", "subanswer"), llm)) == 1)
        checked = _stored(checked.withColumn("done", F.coalesce("done", F.lit(False)) | F.lit(level == depth - 1)))
        rows = checked.select("qid", F.lit(level).alias("depth"), "source", "subquery", "subanswer", "done")
        out = rows if out is None else out.unionByName(rows)
        follow = F.concat(F.lit("follow up: "), F.col("subanswer"))
        open_ = checked.where("not done").select("qid", "question", follow.alias("subquery"), F.concat_ws(" ", "history", "subanswer").alias("history"))
    return out
