"""A training-corpus pipeline: toxicity filter, near-duplicate removal, substring dedup, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm.common import materialise, table
from vitalgrid.llm.dedup import without_repeats
from vitalgrid.llm.jaccard import jaccard_components
from vitalgrid.llm.mixing import take_copies
from vitalgrid.llm.packing import pack_documents
from vitalgrid.llm.toxicity import toxicity_scores


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is scored as toxic go; the score is learned from the labelled rows of ``docs``.

    Null and empty texts are scored as texts without words, null ids as any other; repeated rows go or stay together.
    """
    scores = toxicity_scores(docs, table(spark, sf_dir, "labels"), keep=docs.columns)
    return scores.where("predicted = 0").select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 the one with the smallest id stays; null ids stay."""
    leads = jaccard_components(docs, k=5, percent=80).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(leads, "doc_id", "left_semi").union(docs.where("doc_id is null"))
    return kept.dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 13 words that a document with a smaller id has are cut; what is left becomes the text.

    A document of which nothing is left goes; null and empty texts and null ids stay as they are.
    """
    cut = without_repeats(docs).where("n_words = 0 or n_removed < n_words")
    changed = cut.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat by rates that raise small languages; no document goes, null and empty texts and null ids included.

    Repeated rows get one rate each.
    """
    return take_copies(docs, table(spark, sf_dir, "labels"), domain="lang", power=0.7)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens; null and empty texts are an end token alone, repeated rows are packed each."""
    return pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("jaccard_join", one_of_near_copies), ("substring_dedup", cut_repeats), ("mixing", mix_languages), ("packing", pack)]
#: SQL states neither the learned stages nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus; each stage is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
