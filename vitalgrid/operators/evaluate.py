"""Evaluation by task: which kind of metric a task has, its own list, and one way to run any of them.

Every kind takes a table of a stated shape and gives (metric, value); metrics are computed together where they share a
pass. More kinds are added to ``MODES``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import curves
from . import metrics as M
from . import overlap as O
from .agent import _stored


#: kind of metric -> its metrics
NAMES: dict[str, tuple[str, ...]] = {
    "binary": ("roc_auc", "pr_auc", "precision", "recall", "accuracy", "balanced_accuracy", "f1", "jaccard", "kappa"),
    "multiclass": ("roc_auc_weighted_ovr", "roc_auc_macro_ovr", "accuracy", "cohen_kappa", "f1_weighted", "f1_macro", "f1_micro", "balanced_accuracy", "jaccard_micro", "jaccard_macro", "jaccard_weighted", "rmse", "mae"),
    "multilabel": (*(f"{m}_{a}" for m in ("jaccard", "f1", "precision", "recall", "pr_auc", "roc_auc") for a in ("samples", "micro", "macro", "weighted")), "accuracy", "hamming_loss"),
    "regression": ("mse", "rmse", "mae", "r2"),
    "qa": ("accuracy", "em", "f1_score"),
    "words": ("f1_score", "precision", "recall"),
    "summary": ("rouge_L", "rouge1", "rouge2", "bleu", "sari", "fkgl", "cli"),
}


_SAMPLES = ("jaccard_samples", "f1_samples", "pr_auc_samples", "roc_auc_samples", "precision_samples", "recall_samples")


def long(row: DataFrame, *names: str) -> DataFrame:
    """The columns of a one-row table as rows (metric, value)."""
    pairs = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))
    return row.select(F.explode(pairs).alias("m")).select("m.*")


def _binary(rows: DataFrame) -> DataFrame:
    """Rows of y (0 or 1), score and predicted (0 or 1)."""
    one = M.binary_metrics(rows).join(M.roc_auc(rows)).join(M.average_precision(rows))  # one row each
    return long(one, *NAMES["binary"])


def _multiclass(rows: DataFrame) -> DataFrame:
    """Rows of y (a class from 0 on) and scores (a score a class); predicted is the first class of the highest score."""
    best = rows.withColumn("predicted", (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))
    cells = rows.select("y", F.posexplode("scores").alias("k", "s")).withColumn("t", (F.col("y") == F.col("k")).cast("int"))
    auc = M.roc_auc(cells, "t", "s", ("k",)).join(cells.groupBy("k").agg(F.sum("t").alias("n")), "k").where("roc_auc is not null")
    auc = auc.agg(F.avg("roc_auc").alias("roc_auc_macro_ovr"), (F.sum(F.col("roc_auc") * F.col("n")) / F.sum("n")).alias("roc_auc_weighted_ovr"))
    one = M.multiclass_metrics(best).withColumnRenamed("kappa", "cohen_kappa").join(auc).join(M.regression_metrics(best).select("rmse", "mae"))  # one row each
    return long(one, *NAMES["multiclass"])


def _multilabel(rows: DataFrame) -> DataFrame:
    """Cells of row, label, y (0 or 1), score and predicted (0 or 1); or rows with arrays of label, y, score and predicted, all cells of each."""
    if dict(rows.dtypes)["score"].startswith("array"):
        rows = rows.select("row", F.inline(F.arrays_zip("label", "y", "score", "predicted")))
    prefixed = lambda df, name: df.select(*(F.col(c).alias(f"{name}_{c}") for c in df.columns))
    one = M.multilabel_metrics(rows, "row").join(prefixed(M.average_precisions(rows, "row"), "pr_auc")).join(prefixed(M.roc_aucs(rows, "row"), "roc_auc"))  # one row each
    return long(one, *NAMES["multilabel"])


def _multilabel_by_row(rows: DataFrame) -> DataFrame:
    """The metrics of ``_multilabel`` that are means over rows: nothing is counted by label or over all cells."""
    return long(curves.row_averages(curves.gathered(rows, "row", predicted="predicted")), *_SAMPLES)


def _regression(rows: DataFrame) -> DataFrame:
    """Rows of y and predicted."""
    return long(M.regression_metrics(rows), *NAMES["regression"])


def _qa(rows: DataFrame) -> DataFrame:
    """Rows of predicted and y, parsed answers; F1 is over rows where both are a capital from A to D, weighted by class."""
    same = rows.agg(F.avg((F.col("predicted") == F.col("y")).cast("double")).alias("em")).withColumn("accuracy", F.col("em"))
    choices = rows.where(F.col("predicted").isin(*"ABCD") & F.col("y").isin(*"ABCD"))
    return long(same.join(M.multiclass_metrics(choices).agg(F.max("f1_weighted").alias("f1_score"))), *NAMES["qa"])


def _words(rows: DataFrame) -> DataFrame:
    """Rows of key, predicted and y, texts: mean F1, precision and recall of their words."""
    s = T.answer_scores(rows, "key", "predicted", "y")
    return long(s.agg(F.avg("f1").alias("f1_score"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall")), *NAMES["words"])


def _summary(rows: DataFrame) -> DataFrame:
    """Rows of key, predicted, y and source, texts. BLEU is of the corpus, SARI and the rest are means over rows; SARI times 100."""
    text = F.coalesce("predicted", F.lit(""))
    means = rows.agg(F.avg(T.reading_grade(text)).alias("fkgl"), F.avg(T.coleman_liau(text)).alias("cli"))
    return long(O.summary_scores(rows, "predicted", "y", "source").join(means), *NAMES["summary"])  # one row each


#: kind of metric -> function of a table
MODES: dict[str, Callable[[DataFrame], DataFrame]] = {"binary": _binary, "multiclass": _multiclass, "multilabel": _multilabel, "regression": _regression, "qa": _qa, "words": _words, "summary": _summary}
#: kind of metric -> metrics for which less than all of the kind is computed, and the function that gives those
PARTS: dict[str, tuple[tuple[str, ...], Callable[[DataFrame], DataFrame]]] = {"multilabel": (_SAMPLES, _multilabel_by_row)}
_RATES = ("roc_auc", "pr_auc", "precision", "recall", "accuracy", "balanced_accuracy")
#: task -> kind of metric and the metrics it reports; regression and words are asked for by kind.
TASKS: dict[str, tuple[str, tuple[str, ...]]] = {
    "MOR": ("binary", _RATES), "REA": ("binary", _RATES), "IHM": ("binary", _RATES),
    "LOS": ("multiclass", ("roc_auc_weighted_ovr", "accuracy", "cohen_kappa", "f1_weighted")),
    "DIAG": ("multilabel", _SAMPLES), "REC": ("multilabel", _SAMPLES), "PHE": ("multilabel", _SAMPLES),
    "SINGLE": ("qa", ("accuracy", "em", "f1_score")),
    "SUMMARY": ("summary", ("rouge_L", "rouge1", "rouge2", "bleu", "fkgl", "cli", "sari")),
}


def evaluate(rows: DataFrame, task: str | None = None, mode: str | None = None, metrics: tuple[str, ...] | None = None) -> DataFrame:
    """(metric, value): the metrics of a task, or of a kind ``mode``; only those named in ``metrics``, if given.

    An unknown task, kind or metric is an error, as is a task whose answers have several parts (MULTI).
    """
    if (task is None) == (mode is None):
        raise ValueError("either a task or a kind of metric")
    own: tuple[str, ...] | None = None
    if task is not None:
        if task not in TASKS:
            raise ValueError(f"no such task: {task}")
        mode, own = TASKS[task]
    if mode not in MODES:
        raise ValueError(f"no such kind of metric: {mode}")
    wanted = metrics or own
    if not wanted:
        return MODES[mode](rows)
    if missing := set(wanted) - set(NAMES[mode]):
        raise ValueError(f"no such metrics of {mode}: {sorted(missing)}")
    part, function = PARTS.get(mode, ((), None))
    out = function(rows) if set(wanted) <= set(part) else MODES[mode](rows)
    return out.where(F.col("metric").isin(*wanted))


def unmatched(predictions: DataFrame, truths: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only predictions or only truths have, so that a join by key loses nothing unseen; null keys match nothing."""
    only = lambda a, b, side: a.select(key).join(b.select(key).distinct(), key, "left_anti").select(key, F.lit(side).alias("side"))
    return only(predictions, truths, "prediction").unionByName(only(truths, predictions, "truth"))


#: task -> how its answers are parsed
PARSED = {"MOR": "binary", "REA": "binary", "IHM": "binary", "LOS": "stay", "SINGLE": "single", "SUMMARY": "summary"}


def parsed_predictions(rows: DataFrame, task: str, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """``rows`` with p, y (the compared forms of what was generated and of the truth, as text) and no_answer."""
    if task not in PARSED:
        raise ValueError(f"answers of {task} are not parsed")
    return rows.withColumn("_f", T.parsed_answers(T.locate_answer(predicted), gold, PARSED[task])).withColumns({"p": F.col("_f.predicted"), "y": F.col("_f.gold"), "no_answer": F.col("_f.no_answer")}).drop("_f")


def evaluate_answers(rows: DataFrame, task: str, key: str = "key", predicted: str = "predicted", gold: str = "gold", source: str = "source") -> DataFrame:
    """(metric, value): generated texts against truths, from parsing to the metrics of the task, and the share of rows without an answer.

    A yes or no is its own score, a class of stay the one score of its class. Summaries need ``source``, their input.
    What was parsed is written to the shared folder: each metric reads it, none parses again.
    """
    held = [key, source] if PARSED[task] == "summary" else []
    rows = _stored(parsed_predictions(rows, task, predicted, gold).select(*held, "p", "y", "no_answer"))
    if PARSED[task] == "binary":
        shaped = rows.select(F.col("y").cast("int").alias("y"), F.col("p").cast("double").alias("score"), F.col("p").cast("int").alias("predicted"))
    elif PARSED[task] == "stay":
        one = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("p").cast("int"), 1.0).otherwise(0.0))
        shaped = rows.select(F.col("y").cast("int").alias("y"), one.alias("scores"))
    elif PARSED[task] == "single":
        shaped = rows.select(F.col("p").alias("predicted"), "y")
    else:
        shaped = rows.select(F.col(key).alias("key"), F.col("p").alias("predicted"), "y", F.col(source).alias("source"))
    silent = rows.agg(F.avg(F.col("no_answer").cast("double")).alias("value")).select(F.lit("no_answer").alias("metric"), "value")
    return evaluate(shaped, task).unionByName(silent)
