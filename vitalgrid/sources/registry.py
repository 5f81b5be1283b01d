"""A registry of training datasets: where each is, what of it is read, and how its columns map to roles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.groups import hashed_position

#: Roles of a row's columns.
ROLES = ("prompt", "query", "response", "history", "system", "tools", "chosen", "rejected", "kto_tag", "images", "videos", "audios")
_LISTS = ("history", "images", "videos", "audios")


@dataclass(frozen=True)
class Tags:
    """How the messages of a chat row name their fields and their roles."""

    role: str = "from"
    content: str = "value"
    user: str = "human"
    assistant: str = "gpt"
    observation: str = "observation"
    function: str = "function_call"
    system: str = "system"


@dataclass(frozen=True)
class Dataset:
    """Files at ``path``[/``subset``][/``folder``] (of ``split``: those whose names begin with it).

    ``ranking`` datasets have a chosen and a rejected response; ``formatting`` chat has its rows in a column of messages,
    named by ``columns["messages"]``. ``num_samples`` rows are drawn, in hashed order, rows again where there are fewer.
    """

    path: str
    format: str = "json"
    columns: dict[str, str] = field(default_factory=lambda: {"prompt": "instruction", "query": "input", "response": "output"})
    options: dict[str, str] = field(default_factory=dict)
    subset: str | None = None
    folder: str | None = None
    split: str | None = None
    ranking: bool = False
    formatting: str = "rows"
    tags: Tags = Tags()
    num_samples: int | None = None


def chat_messages(messages: Column, tags: Tags) -> Column:
    """Messages with role (user, assistant, observation, function or system; null for an unknown one) and content."""
    role = lambda m: F.coalesce(*(F.when(m[tags.role] == getattr(tags, r), r) for r in ("user", "assistant", "observation", "function", "system")))
    return F.transform(messages, lambda m: F.struct(role(m).alias("role"), m[tags.content].alias("content")))


def chat_rows(rows: DataFrame, column: str, tags: Tags = Tags()) -> DataFrame:
    """Adds system, prompt, response and history (texts before the last two, in turn) from a column of messages.

    A first system message is taken apart. Then user or observation and assistant or function must take turns, with an
    answer at the end; rows that are otherwise, and rows without messages, go.
    """
    m = rows.withColumn("_m", chat_messages(F.col(column), tags))
    lead = F.try_element_at("_m", F.lit(1))
    apart = F.coalesce(lead["role"] == "system", F.lit(False))
    m = m.withColumn("system", F.when(apart, lead["content"])).withColumn("_m", F.when(apart, F.slice("_m", 2, F.greatest(F.size("_m") - 1, F.lit(0)))).otherwise(F.col("_m")))
    turn = F.transform("_m", lambda x, i: F.when(i % 2 == 0, x["role"].isin("user", "observation")).otherwise(x["role"].isin("assistant", "function")))
    m = m.where((F.size("_m") > 0) & (F.size("_m") % 2 == 0) & F.forall(turn, lambda ok: F.coalesce(ok, F.lit(False))))
    text = F.transform("_m", lambda x: x["content"])
    return m.withColumns({"prompt": F.element_at(text, -2), "response": F.element_at(text, -1), "history": F.slice(text, 1, F.size(text) - 2)}).drop("_m")


class Registry:
    """Named datasets; loading gives a column for each role, nulls where a dataset has none."""

    def __init__(self, **datasets: Dataset):
        self.datasets = datasets

    def load(self, spark: SparkSession, name: str, most: int | None = None) -> DataFrame:
        """The rows of a dataset by role; of ``most`` the first ones by file and place."""
        if name not in self.datasets:
            raise ValueError(f"no such dataset: {name}")
        d = self.datasets[name]
        if d.ranking and not {"chosen", "rejected"} <= d.columns.keys():
            raise ValueError("a ranking dataset names its chosen and its rejected response")
        reader = spark.read.format(d.format).options(**d.options)
        if d.split:
            reader = reader.option("pathGlobFilter", f"{d.split}*")
        rows = reader.load("/".join(x for x in (d.path, d.subset, d.folder) if x))
        if most is not None:
            first = ("_metadata.file_path", "_metadata.file_block_start", "_place")
            rows = rows.select("*", "_metadata").withColumn("_place", F.monotonically_increasing_id()).orderBy(*first).limit(most).drop("_metadata", "_place")
        if d.num_samples is not None:
            rows = self._drawn(rows, d.num_samples)
        if d.formatting == "chat":
            rows = chat_rows(rows, d.columns.get("messages", "conversations"), d.tags)
            columns = {**d.columns, "prompt": "prompt", "response": "response", "history": "history", "system": "system"}
        elif d.formatting == "rows":
            columns = d.columns
        else:
            raise ValueError(f"no such formatting: {d.formatting}")
        none = lambda r: F.lit(None).cast("array<string>" if r in _LISTS else "string")
        out = rows.select(*(F.col(columns[r]).alias(r) if columns.get(r) in rows.columns else none(r).alias(r) for r in ROLES))
        return out.where("chosen is not null and rejected is not null") if d.ranking else out

    @staticmethod
    def _drawn(rows: DataFrame, n: int) -> DataFrame:
        keyed = rows.withColumn("_key", F.md5(F.to_json(F.struct("*"))))
        placed = hashed_position(keyed, "_key", 0)
        times = (F.floor(F.lit(n) / F.col("total")) + F.when(F.col("position") < F.lit(n) % F.col("total"), 1).otherwise(0)).cast("int")
        return placed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times))).drop("_key", "position", "total", "_copy")

    def mix(self, spark: SparkSession, *names: str) -> DataFrame:
        """All rows of several datasets with their name."""
        out = None
        for n in names:
            part = self.load(spark, n).withColumn("dataset", F.lit(n))
            out = part if out is None else out.unionByName(part)
        return out
