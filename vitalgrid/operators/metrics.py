"""Metrics as aggregations over prediction rows; ties, absent classes and empty denominators are defined.

Ranks and cumulative counts are taken over distinct scores, which are grouped first, so a window
never orders prediction rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import curves


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b as a double, ``empty`` where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(empty))


def _by_score(rows: DataFrame, y: str, score: str, group: list[str]) -> DataFrame:
    return rows.groupBy(*group, F.col(score).alias("_s")).agg(F.sum(y).cast("double").alias("_pos"), F.sum(1 - F.col(y)).cast("double").alias("_neg"))


#: Scores fall into so many parts of the range from 0 to 1, those outside into its ends.
SCORE_PARTS = 4096


def sums_below(rows: DataFrame, score: str, sums: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds, for each of ``sums``, below_<c>: its sum over rows of lower score (within ``by``), and total_<c>.

    Scores within ``by`` are distinct, as after a grouping. Sums run in two levels: within a part of the scores' range,
    and over the sums of the parts (``SCORE_PARTS`` at most), so no task has all scores. Parts are even for scores
    from 0 to 1; others are right too, but those below 0 or above 1 share a part. NaN is above all, null below.
    """
    s = F.col(score)
    part = F.when(s.isNull(), -1).when(F.isnan(s.cast("double")), SCORE_PARTS + 1).otherwise(F.floor(F.least(F.greatest(s.cast("double"), F.lit(0.0)), F.lit(1.0)) * SCORE_PARTS))
    parted = rows.withColumn("_part", part.cast("int"))
    inner = Window.partitionBy(*by, "_part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(F.lit(0), *by).orderBy("_part")  # a row a part
    names = [f"_by{i}" for i in range(len(by))]
    parts = parted.groupBy(*by, "_part").agg(*(F.sum(c).alias(f"_p_{c}") for c in sums))
    parts = parts.select(
        *(F.col(c).alias(n) for c, n in zip(by, names)), F.col("_part").alias("_at"),
        *(x for c in sums for x in ((F.sum(f"_p_{c}").over(along) - F.col(f"_p_{c}")).alias(f"_b_{c}"), F.sum(f"_p_{c}").over(Window.partitionBy(F.lit(0), *by)).alias(f"total_{c}"))),
    )
    same = F.col("_part") == F.col("_at")
    for c, n in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    out = parted.withColumns({f"_i_{c}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in sums}).join(parts, same)
    return out.withColumns({f"below_{c}": F.col(f"_i_{c}") + F.col(f"_b_{c}") for c in sums}).drop("_part", "_at", *names, *(f"_{k}_{c}" for k in "ib" for c in sums))


def _few_below(rows: DataFrame, score: str, sums: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """As ``sums_below``, for groups of few scores: one window a group."""
    before = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({f"below_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums} | {f"total_{c}": F.sum(c).over(Window.partitionBy(*by)) for c in sums})


def roc_auc(rows: DataFrame, y: str = "y", score: str = "score", by: tuple[str, ...] = (), small_groups: bool = False) -> DataFrame:
    """Chance that a positive outranks a negative, ties half; null without both classes. ``small_groups``: no group is large."""
    return _ranked(_by_score(rows, y, score, list(by)), by, small_groups).select(*by, "roc_auc")


def average_precision(rows: DataFrame, y: str = "y", score: str = "score", by: tuple[str, ...] = (), small_groups: bool = False) -> DataFrame:
    """Sum of precision at each distinct score times the recall gained there; null without positives. ``small_groups``: no group is large."""
    return _ranked(_by_score(rows, y, score, list(by)), by, small_groups).select(*by, "pr_auc")


def _ranked(g: DataFrame, by: tuple[str, ...] = (), small_groups: bool = False) -> DataFrame:
    """(by, roc_auc, pr_auc, n_true) of counts _pos and _neg of distinct scores _s; what a caller leaves out is not computed."""
    g = (_few_below if small_groups else sums_below)(g, "_s", ("_pos", "_neg"), tuple(by))
    upto = {c: F.col(f"total_{c}") - F.col(f"below_{c}") for c in ("_pos", "_neg")}  # at this score and above
    g = g.withColumns({"_w": F.col("_pos") * (F.col("below__neg") + F.col("_neg") / 2), "_p": upto["_pos"] / (upto["_pos"] + upto["_neg"])})
    auc, ap = ratio(F.sum("_w"), F.sum("_pos") * F.sum("_neg"), None), ratio(F.sum(F.col("_pos") * F.col("_p")), F.sum("_pos"), None)
    return g.groupBy(*by).agg(auc.alias("roc_auc"), ap.alias("pr_auc"), F.sum("_pos").alias("n_true"))


def _averages(counts: DataFrame, rows: DataFrame, metric: str) -> DataFrame:
    """A metric of ``_ranked`` over all cells (micro), over labels plain and weighted by their true cells, and over rows, from ``curves.counted``."""
    g = lambda *by: counts.groupBy(*by, F.col("score").alias("_s")).agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    labels = _ranked(g("label"), ("label",)).where(F.col(metric).isNotNull() & F.col("label").isNotNull())
    spread = labels.agg(F.avg(metric).alias("macro"), (F.sum(F.col(metric) * F.col("n_true")) / F.sum("n_true")).alias("weighted"))
    return _ranked(g()).select(F.col(metric).alias("micro")).join(spread).join(rows.select(F.col(f"{metric}_samples").alias("samples")))  # one row each


def roc_aucs(rows: DataFrame, key: str, label: str = "label", y: str = "y", score: str = "score") -> DataFrame:
    """AUC over all cells, over labels plain and weighted by their true cells, and over rows; labels and rows without both classes are left out.

    Rows are cells, or have all cells of a key in arrays.
    """
    return _averages(*curves.counted(curves.gathered(rows, key, label, y, score)), "roc_auc")


def binary_metrics(rows: DataFrame, y: str = "y", predicted: str = "predicted", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and the usual ratios of 0/1 predictions; ratios without a denominator are 0."""
    t, p = F.col(y) == 1, F.col(predicted) == 1
    c = rows.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    expected = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    accuracy = ratio(tp + tn, n)
    return c.select(
        *by, "tp", "fp", "fn", "tn", accuracy.alias("accuracy"),
        ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fp + fn).alias("jaccard"),
        F.when(expected == 1, 0.0).otherwise((accuracy - expected) / (1 - expected)).alias("kappa"),
    )


def calibration_error(rows: DataFrame, y: str = "y", score: str = "score", bins: int = 20) -> DataFrame:
    """Expected calibration error over equal-width bins: mean |accuracy - confidence| weighted by rows."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    g = rows.groupBy(b.alias("_b")).agg(F.count("*").alias("_n"), F.avg(F.col(y).cast("double")).alias("_y"), F.avg(score).alias("_c"))
    return g.agg((F.sum(F.col("_n") * F.abs(F.col("_y") - F.col("_c"))) / F.sum("_n")).alias("ece"))


def equal_size_bins(rows: DataFrame, key: str, score: str, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds _b: the number of a row's bin of equal size by score (within ``by``); rows of one score are ordered by key.

    Positions come from counts of distinct scores and a number within a score, so rows are not sorted as a whole.
    """
    s = sums_below(rows.groupBy(*by, score).agg(F.count("*").alias("_n")), score, ("_n",), by).drop("_n")
    r = rows.join(s, [*by, score]).withColumn("_r", F.col("below__n") + F.row_number().over(Window.partitionBy(*by, score).orderBy(key)) - 1)
    return r.withColumn("_b", F.floor(F.col("_r") * bins / F.col("total__n"))).drop("_r", "below__n", "total__n")


def _gaps(binned: DataFrame, y: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    g = binned.groupBy(*by, "_b").agg(F.count("*").alias("_n"), F.avg(F.col(y).cast("double")).alias("_y"), F.avg(score).alias("_c"))
    return g.groupBy(*by).agg((F.sum(F.col("_n") * F.abs(F.col("_y") - F.col("_c"))) / F.sum("_n")).alias("ece"))


def adaptive_calibration_error(rows: DataFrame, key: str, y: str = "y", score: str = "score", bins: int = 20) -> DataFrame:
    """The same over bins of equal size by score; rows of one score are ordered by key."""
    return _gaps(equal_size_bins(rows, key, score, bins), y, score)


def classwise_calibration_error(rows: DataFrame, key: str, y: str = "y", scores: str = "scores", bins: int = 20, threshold: float | None = None, adaptive: bool = False) -> DataFrame:
    """(ece, classes): calibration error of each class's probability against its truth, averaged over classes.

    ``scores`` is an array with a probability for each class from 0 on. Probabilities below ``threshold`` (default: the
    smaller of 0.01 and one over the number of classes) are left out, and so are classes without any. Bins are of equal
    width, or, with ``adaptive``, of equal size within a class.
    """
    cells = rows.select(key, F.col(y).alias("_t"), F.size(scores).alias("_k"), F.posexplode(scores).alias("class", "conf")).withColumn("hit", (F.col("_t") == F.col("class")).cast("int"))
    least = F.least(F.lit(0.01), 1 / F.col("_k")) if threshold is None else F.lit(threshold)
    cells = cells.where(F.col("conf") >= least).select(key, "class", "conf", "hit")
    binned = equal_size_bins(cells, key, "conf", bins, ("class",)) if adaptive else cells.withColumn("_b", F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)))
    return _gaps(binned, "hit", "conf", ("class",)).agg(F.avg("ece").alias("ece"), F.count("*").alias("classes"))


def confusion(rows: DataFrame, y: str = "y", predicted: str = "predicted", by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by, F.col(y).alias("y"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(conf: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, n_true and n_pred of every class that is true or predicted somewhere."""
    cells = conf.select(*by, F.explode(F.array(F.struct(F.col("y").alias("c"), F.lit(1).alias("t")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("t")))).alias("x"), "n", (F.col("y") == F.col("predicted")).alias("hit"))
    t = F.col("x.t") == 1
    return cells.groupBy(*by, F.col("x.c").alias("class")).agg(F.sum(F.when(t & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(t, F.col("n")).otherwise(0)).alias("n_true"), F.sum(F.when(~t, F.col("n")).otherwise(0)).alias("n_pred"))


def multiclass_metrics(rows: DataFrame, y: str = "y", predicted: str = "predicted", by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, balanced accuracy, F1 and Jaccard in their averages, and kappa."""
    c = per_class(confusion(rows, y, predicted, by), by)
    tp, t, p = F.col("tp"), F.col("n_true"), F.col("n_pred")
    f1, jac = ratio(2 * tp, t + p), ratio(tp, t + p - tp)
    n, hits = F.sum(t), F.sum(tp)
    expected = F.sum(t.cast("double") * p) / (n.cast("double") * n)
    acc = ratio(hits, n)
    return c.groupBy(*by).agg(
        n.alias("n"), acc.alias("accuracy"), F.avg(F.when(t > 0, tp / t)).alias("balanced_accuracy"),
        acc.alias("f1_micro"), F.avg(f1).alias("f1_macro"), (F.sum(f1 * t) / n).alias("f1_weighted"),
        ratio(hits, 2 * n - hits).alias("jaccard_micro"), F.avg(jac).alias("jaccard_macro"), (F.sum(jac * t) / n).alias("jaccard_weighted"),
        F.when(expected == 1, 0.0).otherwise((acc - expected) / (1 - expected)).alias("kappa"),
    )


def rank_metrics(ranks: DataFrame, rank: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """Hits at 1, 5 and 10, mean rank and mean reciprocal rank of the true item."""
    r = F.col(rank)
    return ranks.groupBy(*by).agg(*(F.avg((r <= k).cast("double")).alias(f"hits_{k}") for k in (1, 5, 10)), F.avg(r.cast("double")).alias("mean_rank"), F.avg(1 / r).alias("mrr"))


def multilabel_metrics(rows: DataFrame, key: str, label: str = "label", y: str = "y", predicted: str = "predicted") -> DataFrame:
    """F1, precision, recall and Jaccard over (row, label) cells: micro, macro, weighted and by row.

    Ratios without a denominator are 0, but 1 for F1 and Jaccard by row.
    """
    t, p = F.col(y) == 1, F.col(predicted) == 1
    cells = [F.count_if(t & p).alias("tp"), F.count_if(p).alias("np"), F.count_if(t).alias("nt")]
    tp, n_p, n_t = F.col("tp"), F.col("np"), F.col("nt")

    def four(e: float) -> dict[str, Column]:
        return {"f1": ratio(2 * tp, n_p + n_t, e), "precision": ratio(tp, n_p), "recall": ratio(tp, n_t), "jaccard": ratio(tp, n_p + n_t - tp, e)}

    # one pass over the cells: counts by label, by row and over all
    sets = rows.groupingSets([[F.col(label)], [F.col(key)], []], F.col(label), F.col(key)).agg(F.grouping_id().alias("_g"), *cells, F.count("*").alias("n"), F.count_if(t == p).alias("same"))
    where = lambda g, c: F.when(F.col("_g") == g, c)
    by_label, by_row, all_ = 1, 2, 3
    out = []
    for n, c in four(0.0).items():
        out += [F.max(where(all_, c)).alias(f"{n}_micro"), F.avg(where(by_label, c)).alias(f"{n}_macro"), (F.sum(where(by_label, c * n_t)) / F.sum(where(by_label, n_t))).alias(f"{n}_weighted")]
    out += [F.avg(where(by_row, c)).alias(f"{n}_samples") for n, c in four(1.0).items()]
    whole = lambda c: F.max(where(all_, c))
    return sets.agg(*out, whole(F.col("same") / F.col("n")).alias("accuracy"), whole(1 - F.col("same") / F.col("n")).alias("hamming_loss"), whole(tp).alias("tp"), whole(n_p - tp).alias("fp"))


def topk_precision(rows: DataFrame, key: str, k: int, label: str = "label", y: str = "y", score: str = "score") -> DataFrame:
    """Share of true labels among the k best of each row, out of the most that could be there; rows without true labels are left out."""
    w = Window.partitionBy(key).orderBy(F.desc(score), label)
    top = rows.withColumn("_r", F.row_number().over(w)).groupBy(key).agg(F.sum(F.when(F.col("_r") <= k, F.col(y)).otherwise(0)).alias("hit"), F.sum(y).alias("n_true"))
    return top.where("n_true > 0").agg(F.avg(F.col("hit") / F.least("n_true", F.lit(k))).alias("topk_precision"), F.count("*").alias("n"))


def topk_hits(rows: DataFrame, key: str, k: int, by: tuple[str, ...] = (), label: str = "label", y: str = "y", score: str = "score") -> DataFrame:
    """Share of all true labels that are among the k best of their row, over all or by a column of the cells."""
    w = Window.partitionBy(key).orderBy(F.desc(score), label)
    ranked = rows.withColumn("_r", F.row_number().over(w)).where(F.col(y) == 1)
    return ranked.groupBy(*by).agg(F.avg((F.col("_r") <= k).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def average_precisions(rows: DataFrame, key: str, label: str = "label", y: str = "y", score: str = "score") -> DataFrame:
    """Average precision over all cells, over labels plain and weighted by their true cells, and over rows; what has no true cell is left out. Rows as in ``roc_aucs``."""
    return _averages(*curves.counted(curves.gathered(rows, key, label, y, score)), "pr_auc")


def regression_metrics(rows: DataFrame, y: str = "y", predicted: str = "predicted", by: tuple[str, ...] = ()) -> DataFrame:
    d = F.col(y).cast("double") - F.col(predicted)
    return rows.groupBy(*by).agg(F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), (1 - F.sum(d * d) / (F.var_pop(F.col(y).cast("double")) * F.count("*"))).alias("r2"))


def prediction_sets_by_class(rows: DataFrame, contents: str = "members", y: str = "y") -> DataFrame:
    """(class, n, miscoverage, error): rows of each true class, share of their sets without it, and of their one-label sets that are another label (null without such sets)."""
    one, miss = F.size(contents) == 1, ~F.array_contains(contents, F.col(y))
    return rows.groupBy(F.col(y).alias("class")).agg(F.count("*").alias("n"), F.avg(miss.cast("double")).alias("miscoverage"), F.avg(F.when(one, miss.cast("double"))).alias("error"))


def prediction_sets(rows: DataFrame, contents: str = "members", y: str = "y") -> DataFrame:
    """Share of rows whose set is not one label, mean set size, share of sets without the truth, and error of single labels; the last two also as means over true classes."""
    one, miss = F.size(contents) == 1, ~F.array_contains(contents, F.col(y))
    all_ = rows.agg(F.avg((~one).cast("double")).alias("rejection_rate"), F.avg(F.size(contents)).alias("set_size"), F.avg(miss.cast("double")).alias("miscoverage"), F.avg(F.when(one, miss.cast("double"))).alias("error"))
    return all_.join(prediction_sets_by_class(rows, contents, y).agg(F.avg("miscoverage").alias("miscoverage_mean"), F.avg("error").alias("error_mean")))  # one row each


def pair_rate(rows: DataFrame, pairs: DataFrame, key: str, item: str) -> DataFrame:
    """Share of each row's item pairs that are in ``pairs`` (a < b), over all rows; the items of a row are few."""
    a = rows.select(key, F.col(item).alias("a")).distinct()
    both = a.join(a.select(key, F.col("a").alias("b")), key).where("a < b")
    hit = both.join(pairs.select("a", "b", F.lit(1).alias("bad")), ["a", "b"], "left")
    return hit.agg((F.count("bad") / F.count("*")).alias("pair_rate"), F.count("*").alias("n_pairs"))
