"""Communities of texts and what a language model says of them: bounded chunks by cluster, descriptions with retries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .agent import LlmFn
from .groups import ordered_position

#: Texts of a chunk at most.
CHUNK = 1000


def community_chunks(rows: DataFrame, community: str, key: str, text: str, size: int = CHUNK) -> DataFrame:
    """(community, chunk, n, texts): the texts of each community in the order of ``key``, cut into chunks of ``size``.

    A community of any size is cut by positions, so no task has more of it than a chunk. Null texts are left out; a
    null community is one as others.
    """
    placed = ordered_position(rows.where(F.col(text).isNotNull()).select(community, key, text), key, community)
    chunks = placed.groupBy(community, F.floor(F.col("position") / size).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("position", text))).alias("t"))
    return chunks.select(F.col(community).alias("community"), "chunk", F.size("t").alias("n"), F.transform("t", lambda x: x[text]).alias("texts"))


def described(rows: DataFrame, prompt: Column, llm: LlmFn, tries: int = 3) -> DataFrame:
    """Adds ``description``, the model's reply; rows whose prompt fails ``tries`` times are left out, as are null replies.

    A batch is asked at once; only if that fails each prompt is asked for itself.
    """

    @F.pandas_udf("string")
    def tell(prompts: pd.Series) -> pd.Series:
        def alone(p: str) -> str | None:
            for _ in range(tries):
                try:
                    return llm(pd.Series([p])).iloc[0]
                except Exception:  # noqa: BLE001  any failure of the caller's function counts as a try
                    continue
            return None

        try:
            return llm(prompts)
        except Exception:  # noqa: BLE001
            return prompts.map(alone)

    return rows.withColumn("description", tell(prompt)).where("description is not null")


def described_communities(rows: DataFrame, community: str, key: str, text: str, llm: LlmFn, size: int = CHUNK, tries: int = 3, prompt: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, community, chunk, n, description): what the model says of each chunk of a community; id counts them by community and chunk."""
    ask = prompt or (lambda texts: F.concat(F.lit("describe: "), texts))
    told = described(community_chunks(rows, community, key, text, size), ask(F.array_join("texts", ", ")), llm, tries)
    order = told.select(F.struct("community", "chunk").alias("_k"), "community", "chunk", "n", "description")
    return ordered_position(order, "_k").select(F.col("position").alias("id"), "community", "chunk", "n", "description")


def described_nodes(nodes: DataFrame, kind: str, llm: LlmFn, tries: int = 3, prompt: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, node_id, description) of the nodes of one type, ids by node_id; nodes whose prompt fails are left out."""
    ask = prompt or (lambda name: F.concat(F.lit("describe: "), name))
    told = described(nodes.where(F.col("node_type") == kind).select("node_id", "node_name"), ask(F.col("node_name")), llm, tries)
    return ordered_position(told, "node_id").select(F.col("position").alias("id"), "node_id", "description")
