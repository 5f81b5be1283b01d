"""Questions matched to documents by content words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import MATCH_PUNCTUATION, content_words

#: Questions that one pass over the documents looks for.
BLOCK = 200


def entity_matches(documents: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """(key, matched): in how many documents (``d``) any content word of a question (``text``) is a substring.

    Questions are a stated set and go in blocks of bounded size, one pass over the documents each; a document
    gives the keys of the block's questions that it matches, counted before the shuffle. Null documents match nothing.
    """
    asked = questions.select(key, F.array_distinct(content_words(F.coalesce("text", F.lit("")))).alias("words"))
    spark, kind = asked.sparkSession, asked.schema
    low, counts, block = F.translate(F.lower("d"), MATCH_PUNCTUATION, ""), [], []

    def counted(rows: list) -> DataFrame:
        tests = [F.when(reduce(lambda a, b: a | b, (F.contains("_low", F.lit(w)) for w in r["words"])), F.lit(i)) for i, r in enumerate(rows) if r["words"]]
        hit = documents.select(low.alias("_low")).select(F.explode(F.array_compact(F.array(*tests)).cast("array<int>")).alias("_i")).groupBy("_i").count()
        names = spark.createDataFrame([(i, r[key]) for i, r in enumerate(rows)], f"_i int, {key} {kind[key].dataType.simpleString()}")
        return names.join(hit, "_i", "left").select(key, F.coalesce("count", F.lit(0)).alias("matched"))

    for row in asked.toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            counts, block = [*counts, counted(block)], []
    if block or not counts:
        counts.append(counted(block))
    return reduce(DataFrame.union, counts)
