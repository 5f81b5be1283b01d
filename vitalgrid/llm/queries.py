"""The registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, licenses, manifest


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page as lines; null, empty and textless pages give an empty text, repeated rows a row each."""
    from .htmltext import extract_pages

    return extract_pages(common.table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document because a window of 13 words starts in one of smaller id; null texts have no words, null ids neither lose nor claim windows."""
    from .dedup import without_repeats

    return without_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


def op3_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, one posterior a domain, and the rate of every document."""
    from .mixing import mixing_rates

    rows, report = mixing_rates(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    posteriors = [F.col("posteriors")[i].alias(f"p_{d}") for i, d in enumerate(report["domains"])]
    return rows.select("doc_id", "n_tokens", *posteriors, "rate")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 4096 ids; null and empty texts are the end id alone, repeated rows are packed each."""
    from .packing import pack_documents

    return pack_documents(common.table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text; null and empty texts have none."""
    from .tokens import token_counts

    return token_counts(common.table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness; ids are numbers, null ones come first, null texts are empty."""
    from .fingerprint import document_fingerprints

    return document_fingerprints(common.table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document; null texts and those without words link with nothing, null ids have no component."""
    from .jaccard import jaccard_components

    return jaccard_components(common.table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction for every text; null and empty ones are scored as texts without words."""
    from .toxicity import toxicity_scores

    return toxicity_scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every text; null and empty ones have zeros and fail the base check."""
    from .quality import quality_rules

    return quality_rules(common.table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in every text; null and empty ones have none."""
    return licenses.license_scan(common.table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids, read back from files of entropy-coded blocks; null texts have the end id alone."""
    from .rans import token_file_digests

    return token_file_digests(common.table(spark, sf_dir, "documents"))


def op12_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and tamper check of every document; nulls have a digest of their own."""
    from .manifest import dataset_manifest

    return dataset_manifest(common.table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of every whole vector; a deviation beyond a long is an error."""
    from .whitening import whitened_components

    return whitened_components(common.table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {f.__name__: f for f in (op1_html_text, op2_substring_dedup, op3_mixing_rates, op4_packing, op5_token_counts, op6_fingerprints, op7_jaccard_join, op8_toxicity, op9_quality_rules, op10_license_scan, op11_token_files, op12_dataset_manifest, op13_whitening)}

ORACLES: dict[str, str] = {"op10_license_scan": licenses.ORACLE, "op12_dataset_manifest": manifest.ORACLE}
