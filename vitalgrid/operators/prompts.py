"""Prompts as columns: templates by family and task, and summaries of what was retrieved for a question."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each task asks, in our own words.
QUESTIONS = {
    "REA": "Will this patient be admitted again within two weeks of this encounter? Answer yes or no.",
    "MOR": "Will this patient die within a day of this encounter? Answer yes or no.",
    "IHM": "Will this patient die during the next stay? Answer yes or no.",
    "LOS": "For how many days will this patient stay? Answer with a class from 0days to 9days.",
    "PHE": "Which groups of conditions will the next visit have? Answer with their names, parted by commas.",
    "DIAG": "Which codes will the next visit have? Answer with the codes, parted by commas.",
    "REC": "Which drugs should this visit prescribe? Answer with their names, parted by commas.",
    "SINGLE": "Which of the choices is right? Answer with its letter.",
    "SUMMARY": "Summarise the record for the patient in plain words.",
}
#: Families of prompts around a question, in our own words; names in braces are filled in.
FAMILIES = {
    "record": "Conditions so far: {conditions}\nProcedures so far: {procedures}\nDrugs so far: {drugs}\nQuestion: {question}",
    "rewrite": "Split the question into three to five smaller questions, numbered from 1.\nQuestion: {question}",
    "decide": "Can the question be answered without looking anything up? Answer no if it can, yes if not.\nKnown: {history}\nQuestion: {subquery}",
    "paths": "Choose the numbers of the paths that help with the question, parted by commas.\nPaths:\n{paths}\nQuestion: {subquery}",
    "answer": "Answer the question in one sentence.\nLooked up: {context}\nKnown: {history}\nQuestion: {subquery}",
    "check": "If what is known answers the question, give the answer; if not, say incomplete.\nKnown: {history}\nQuestion: {question}",
    "follow": "Ask the one question whose answer is still missing.\nKnown: {history}\nQuestion: {subquery}",
    "summary": "Question: {question}\n\n{found}\nSummarise what bears on the question.",
}


def fill(template: str, **parts: Column | str) -> Column:
    """A template with its names in braces replaced by columns; nulls are empty. A name without a column is an error."""
    pieces = re.split(r"\{(\w+)\}", template)
    if missing := set(pieces[1::2]) - parts.keys():
        raise ValueError(f"no column for {sorted(missing)}")
    column = lambda x: F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit(""))
    return F.concat(*(column(parts[p]) if i % 2 else F.lit(p) for i, p in enumerate(pieces)))


def task_prompt(task: str, conditions: Column, procedures: Column, drugs: Column) -> Column:
    """The record of a sample (arrays of codes) and what its task asks."""
    listed = lambda c: F.array_join(c, ", ")
    return fill(FAMILIES["record"], conditions=listed(conditions), procedures=listed(procedures), drugs=listed(drugs), question=F.lit(QUESTIONS[task]))


def found_chunks(hits: DataFrame, key: str = "qid") -> DataFrame:
    """(key, found): the texts that were found for each question (rank, text, score), best first; a question has few."""
    rows = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "score", "text"))).alias("h"))
    line = lambda x: F.concat(F.lit("- chunk "), x["rank"].cast("string"), F.lit(" (score "), x["score"].cast("string"), F.lit("): "), x["text"])
    return rows.select(key, F.concat(F.lit("Text found:\n"), F.array_join(F.transform("h", line), "\n")).alias("found"))


def found_graph(hits: DataFrame, key: str = "qid") -> DataFrame:
    """(key, found): the nodes and edges that were found for each question (part node or edge, kind, rank, item, text), by kind and rank; a question has few."""
    rows = hits.groupBy(key, "part", "kind").agg(F.array_sort(F.collect_list(F.struct("rank", "item", "text"))).alias("h"))
    line = lambda x: F.concat(F.lit("  - "), x["item"].cast("string"), F.lit(": "), x["text"])
    kinds = rows.select(key, "part", "kind", F.concat(F.lit("- "), F.col("kind").cast("string"), F.lit("\n"), F.array_join(F.transform("h", line), "\n")).alias("t"))
    parts = kinds.groupBy(key).agg(*(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("kind", "t")))).alias(p) for p in ("node", "edge")))
    block = lambda p, name: F.concat(F.lit(name + ":\n"), F.when(F.size(p) > 0, F.array_join(F.transform(p, lambda x: x["t"]), "\n")).otherwise(F.lit("none")))
    return parts.select(key, F.concat(block("node", "Nodes found"), F.lit("\n"), block("edge", "Edges found")).alias("found"))


def summary_prompts(questions: DataFrame, found: DataFrame, key: str = "qid", question: str = "question") -> DataFrame:
    """(key, prompt): what to ask a model to summarise for each question; one without hits says so."""
    rows = questions.join(found, key, "left")
    return rows.select(key, fill(FAMILIES["summary"], question=question, found=F.coalesce("found", F.lit("Nothing found."))).alias("prompt"))
