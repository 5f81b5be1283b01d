"""Metric queries: labels against document lengths, embeddings against their neighbours, orders against brands."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import metrics as M
from ..sources.tables import table
from .common import query


def _binary(spark, sf_dir):
    """Toxic as truth; the score is the length in thousands of characters, capped, and so has ties."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.least(F.floor(F.col("n_chars") / 100), F.lit(100)) / 100).alias("score"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", "lang", F.col("toxic").alias("y"), "score", (F.col("score") >= 0.2).cast("int").alias("predicted"))


_B = "WITH b AS (SELECT doc_id, lang, toxic AS y, least(n_chars // 100, 100) / 100 AS score, CAST(least(n_chars // 100, 100) / 100 >= 0.2 AS INT) AS predicted FROM labels JOIN documents USING (doc_id))"


@query(f"{_B} SELECT round(avg(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END), 9) AS roc_auc FROM b p, b q WHERE p.y = 1 AND q.y = 0")
def binary_auc(spark, sf_dir):
    return M.roc_auc(_binary(spark, sf_dir)).select(F.round("roc_auc", 9).alias("roc_auc"))


@query(f"""{_B}, s AS (SELECT DISTINCT score FROM b), c AS (SELECT s.score, (SELECT count(*) FROM b WHERE b.score = s.score AND y = 1) AS here, (SELECT count(*) FROM b WHERE b.score >= s.score AND y = 1) AS tp, (SELECT count(*) FROM b WHERE b.score >= s.score) AS n FROM s)
SELECT round(sum(here * tp / n) / (SELECT sum(y) FROM b), 9) AS pr_auc FROM c""")
def binary_ap(spark, sf_dir):
    return M.average_precision(_binary(spark, sf_dir)).select(F.round("pr_auc", 9).alias("pr_auc"))


_CELLS = "count(*) FILTER (y = 1 AND predicted = 1) AS tp, count(*) FILTER (y = 0 AND predicted = 1) AS fp, count(*) FILTER (y = 1 AND predicted = 0) AS fn, count(*) FILTER (y = 0 AND predicted = 0) AS tn"
_SEVEN = """tp, fp, fn, tn, round((tp + tn) / n, 9) AS accuracy, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 9) AS balanced_accuracy,
 round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 9) AS jaccard,
 round(CASE WHEN e = 1 THEN 0 ELSE ((tp + tn) / n - e) / (1 - e) END, 9) AS kappa"""


def _rounded(df, *keep):
    return df.select(*keep, *(F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes if c not in keep))


@query(f"{_B}, c AS (SELECT {_CELLS} FROM b), e AS (SELECT *, tp + fp + fn + tn AS n, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn)) AS e FROM c) SELECT {_SEVEN} FROM e")
def binary_confusion(spark, sf_dir):
    return _rounded(M.binary_metrics(_binary(spark, sf_dir)))


@query(f"{_B}, c AS (SELECT lang, {_CELLS} FROM b GROUP BY lang), e AS (SELECT *, tp + fp + fn + tn AS n, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn)) AS e FROM c) SELECT lang, {_SEVEN} FROM e")
def binary_grouped(spark, sf_dir):
    """The same for each group."""
    return _rounded(M.binary_metrics(_binary(spark, sf_dir), by=("lang",)), "lang")


@query(f"{_B}, g AS (SELECT p.lang, avg(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END) AS v FROM b p JOIN b q ON p.lang = q.lang WHERE p.y = 1 AND q.y = 0 GROUP BY p.lang) SELECT lang, round(v, 9) AS roc_auc FROM (SELECT DISTINCT lang FROM b) LEFT JOIN g USING (lang)")
def grouped_auc(spark, sf_dir):
    return M.roc_auc(_binary(spark, sf_dir), by=("lang",)).select("lang", F.round("roc_auc", 9).alias("roc_auc"))


@query(f"{_B}, g AS (SELECT least(CAST(floor(score * 20) AS INT), 19) AS k, count(*) AS n, avg(y) AS t, avg(score) AS s FROM b GROUP BY 1) SELECT round(sum(n * abs(t - s)) / sum(n), 9) AS ece FROM g")
def ece20(spark, sf_dir):
    return M.calibration_error(_binary(spark, sf_dir)).select(F.round("ece", 9).alias("ece"))


@query(f"{_B}, r AS (SELECT *, (row_number() OVER (ORDER BY score, doc_id) - 1) * 20 // count(*) OVER () AS k FROM b), g AS (SELECT k, count(*) AS n, avg(y) AS t, avg(score) AS s FROM r GROUP BY 1) SELECT round(sum(n * abs(t - s)) / sum(n), 9) AS ece FROM g")
def ece20_adaptive(spark, sf_dir):
    return M.adaptive_calibration_error(_binary(spark, sf_dir), "doc_id").select(F.round("ece", 9).alias("ece"))


def _classes(spark, sf_dir):
    """Labels of vectors, predicted by the position of the largest of the first ten coordinates."""
    e = table(spark, sf_dir, "embeddings")
    first = F.slice("embedding", 1, 10)
    return e.select("vec_id", F.col("label").alias("y"), (F.array_position(first, F.array_max(first)) - 1).cast("int").alias("predicted"), first.alias("scores"))


_E = "WITH e AS (SELECT vec_id, label AS y, CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS INT) AS predicted, embedding[1:10] AS scores FROM embeddings)"


@query(f"{_E} SELECT y, predicted, count(*) AS n FROM e GROUP BY ALL")
def multiclass_confusion(spark, sf_dir):
    return M.confusion(_classes(spark, sf_dir))


@query(f"""{_E}, k AS (SELECT DISTINCT y AS c FROM e UNION SELECT DISTINCT predicted FROM e), s AS (SELECT c, (SELECT count(*) FROM e WHERE y = c AND predicted = c) AS tp, (SELECT count(*) FROM e WHERE y = c) AS t, (SELECT count(*) FROM e WHERE predicted = c) AS p FROM k),
f AS (SELECT *, coalesce(2 * tp / nullif(t + p, 0), 0) AS f1, coalesce(tp / nullif(t + p - tp, 0), 0) AS j FROM s), a AS (SELECT sum(t) AS n, sum(tp) AS h, sum(t * p) / (sum(t) * sum(t)) AS x FROM s)
SELECT CAST((SELECT n FROM a) AS BIGINT) AS n, round((SELECT h / n FROM a), 9) AS accuracy, round(avg(CASE WHEN t > 0 THEN tp / t END), 9) AS balanced_accuracy, round((SELECT h / n FROM a), 9) AS f1_micro, round(avg(f1), 9) AS f1_macro, round(sum(f1 * t) / sum(t), 9) AS f1_weighted,
 round((SELECT h / (2 * n - h) FROM a), 9) AS jaccard_micro, round(avg(j), 9) AS jaccard_macro, round(sum(j * t) / sum(t), 9) AS jaccard_weighted, round((SELECT (h / n - x) / (1 - x) FROM a), 9) AS kappa FROM f""")
def multiclass_f1(spark, sf_dir):
    return _rounded(M.multiclass_metrics(_classes(spark, sf_dir)))


def _ranks(spark, sf_dir):
    e = _classes(spark, sf_dir).where("y < 10")
    own = F.element_at("scores", F.col("y") + 1)
    return e.withColumn("rank", F.size(F.filter("scores", lambda s: s > own)) + 1)


@query(f"""{_E}, r AS (SELECT len(list_filter(scores, lambda s: s > scores[y + 1])) + 1 AS rank FROM e WHERE y < 10)
SELECT round(avg(CAST(rank <= 1 AS INT)), 9) AS hits_1, round(avg(CAST(rank <= 5 AS INT)), 9) AS hits_5, round(avg(CAST(rank <= 10 AS INT)), 9) AS hits_10, round(avg(rank), 9) AS mean_rank, round(avg(1.0 / rank), 9) AS mrr FROM r""")
def hits_mrr(spark, sf_dir):
    """Ranks of the true class among the ten that have a score; vectors of other labels have no rank and are left out."""
    return _rounded(M.rank_metrics(_ranks(spark, sf_dir)))


@query(f"""{_E}, m AS (SELECT y, list_filter(range(0, 10), lambda i: scores[i + 1] > 0.1) AS members FROM e)
SELECT round(avg(CAST(len(members) <> 1 AS INT)), 9) AS rejection_rate, round(avg(len(members)), 9) AS set_size, round(avg(CAST(NOT list_contains(members, y) AS INT)), 9) AS miscoverage, round(avg(CASE WHEN len(members) = 1 THEN CAST(NOT list_contains(members, y) AS INT) END), 9) AS error,
 (SELECT round(avg(v), 9) FROM (SELECT avg(CAST(NOT list_contains(members, y) AS INT)) AS v FROM m GROUP BY y)) AS miscoverage_mean, (SELECT round(avg(v), 9) FROM (SELECT avg(CAST(NOT list_contains(members, y) AS INT)) AS v FROM m WHERE len(members) = 1 GROUP BY y)) AS error_mean FROM m""")
def prediction_set_metrics(spark, sf_dir):
    members = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda i: F.get("scores", i) > F.lit(0.1))
    return _rounded(M.prediction_sets(_classes(spark, sf_dir).select("y", members.alias("members"))))


@query(f"""{_E}, m AS (SELECT y, list_filter(range(0, 10), lambda i: scores[i + 1] > 0.1) AS members FROM e)
SELECT y AS class, count(*) AS n, round(avg(CAST(NOT list_contains(members, y) AS INT)), 9) AS miscoverage, round(avg(CASE WHEN len(members) = 1 THEN CAST(NOT list_contains(members, y) AS INT) END), 9) AS error FROM m GROUP BY y""")
def prediction_sets_by_class(spark, sf_dir):
    members = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda i: F.get("scores", i) > F.lit(0.1))
    return _rounded(M.prediction_sets_by_class(_classes(spark, sf_dir).select("y", members.alias("members"))), "class", "n")


def _shares(spark, sf_dir):
    """The first ten coordinates of a vector as probabilities: squares over their sum."""
    e = _classes(spark, sf_dir)
    squares = F.transform("scores", lambda s: s.cast("double") * s.cast("double"))
    return e.withColumn("q", squares).select("vec_id", "y", F.transform("q", lambda x: F.round(x / F.aggregate("q", F.lit(0.0), lambda a, b: a + b), 6)).alias("scores"))


_Q = f"{_E}, q AS (SELECT vec_id, y, list_transform(scores, lambda s: s::DOUBLE * s::DOUBLE) AS q FROM e), c AS (SELECT vec_id, i AS k, CAST(y = i AS INT) AS hit, round(q[i + 1] / list_sum(q), 6) AS p FROM q, range(0, 10) r(i)), t AS (SELECT * FROM c WHERE p >= 0.01)"


@query(f"{_Q}, g AS (SELECT k, least(CAST(floor(p * 20) AS INT), 19) AS b, count(*) AS n, avg(hit) AS t, avg(p) AS s FROM t GROUP BY ALL), l AS (SELECT k, sum(n * abs(t - s)) / sum(n) AS v FROM g GROUP BY k) SELECT round(avg(v), 9) AS ece, count(*) AS classes FROM l")
def classwise_ece20(spark, sf_dir):
    """Calibration error class by class, bins of equal width."""
    return M.classwise_calibration_error(_shares(spark, sf_dir), "vec_id").select(F.round("ece", 9).alias("ece"), "classes")


@query(f"{_Q}, r AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY p, vec_id) - 1) * 20 // count(*) OVER (PARTITION BY k) AS b FROM t), g AS (SELECT k, b, count(*) AS n, avg(hit) AS t, avg(p) AS s FROM r GROUP BY ALL), l AS (SELECT k, sum(n * abs(t - s)) / sum(n) AS v FROM g GROUP BY k) SELECT round(avg(v), 9) AS ece, count(*) AS classes FROM l")
def classwise_ece20_adaptive(spark, sf_dir):
    """The same with bins of equal size."""
    return M.classwise_calibration_error(_shares(spark, sf_dir), "vec_id", adaptive=True).select(F.round("ece", 9).alias("ece"), "classes")


_AUC1 = "(SELECT c.k, avg(CASE WHEN p.s > q.s THEN 1.0 WHEN p.s = q.s THEN 0.5 ELSE 0.0 END) AS v FROM c JOIN o p ON p.k = c.k AND p.y = c.k JOIN o q ON q.k = c.k AND q.y <> c.k GROUP BY c.k)"


@query(f"""{_E}, o AS (SELECT vec_id, y, i AS k, scores[i + 1] AS s FROM e, range(0, 10) r(i)), c AS (SELECT y AS k, count(*) AS n FROM e WHERE y < 10 GROUP BY y), v AS {_AUC1}
SELECT round(avg(v), 9) AS macro_ovr, round(sum(v * n) / sum(n), 9) AS weighted_ovr FROM v JOIN c USING (k)""")
def multiclass_auc_ovr(spark, sf_dir):
    """One-vs-rest AUC of the ten classes that have a score, plain and weighted by class size; vectors of other labels count as rest only."""
    cells = _classes(spark, sf_dir).select("y", F.posexplode("scores").alias("k", "s")).withColumn("t", (F.col("y") == F.col("k")).cast("int"))
    auc = M.roc_auc(cells, "t", "s", ("k",)).join(cells.groupBy("k").agg(F.sum("t").alias("n")), "k").where("roc_auc is not null")
    return auc.agg(F.round(F.avg("roc_auc"), 9).alias("macro_ovr"), F.round(F.sum(F.col("roc_auc") * F.col("n")) / F.sum("n"), 9).alias("weighted_ovr"))


@query(f"""{_E}, s AS (SELECT least(y, 9) AS t, predicted AS p FROM e) SELECT round(avg((t - p) * (t - p)), 9) AS mse, round(sqrt(avg((t - p) * (t - p))), 9) AS rmse, round(avg(abs(t - p)), 9) AS mae, round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)), 9) AS r2 FROM s""")
def regression_scores(spark, sf_dir):
    e = _classes(spark, sf_dir).withColumn("y", F.least("y", F.lit(9)))
    return _rounded(M.regression_metrics(e))


def _cell_rows(spark, sf_dir):
    """Orders with all their cells, a brand each, in arrays: true if the order has the brand; scores from a hash.

    Lines are dealt out by order once; an order's cells are made where its brands are.
    """
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    true = lines.select(F.col("l_orderkey").alias("row"), F.col("p_brand").alias("label")).repartition("row").groupBy("row").agg(F.collect_set("label").alias("_true"))
    brands = [F.lit(r[0]).cast("string") for r in table(spark, sf_dir, "part").select("p_brand").distinct().collect()]  # at most 25 by the table's definition
    y = F.transform(F.array(*brands), lambda c: F.coalesce(F.col("row").isNotNull() & F.array_contains("_true", c), F.lit(False)).cast("int"))
    score = lambda c: F.conv(F.substring(F.md5(F.concat_ws("-", F.col("row").cast("string"), c)), 1, 4), 16, 10).cast("int") / 65536
    return true.select("row", F.array(*brands).cast("array<string>").alias("label"), y.cast("array<int>").alias("y"), F.array(*map(score, brands)).cast("array<double>").alias("score"))


def _cells(spark, sf_dir):
    """The same, a cell a row."""
    cells = _cell_rows(spark, sf_dir).select("row", F.inline(F.arrays_zip("label", "y", "score")))
    return cells.withColumn("predicted", (F.col("score") >= 0.4).cast("int"))


_C = """WITH t AS (SELECT DISTINCT l_orderkey AS row, p_brand AS label FROM lineitem JOIN part ON l_partkey = p_partkey), l AS (SELECT DISTINCT p_brand AS label FROM part), o AS (SELECT DISTINCT row FROM t),
c AS (SELECT o.row, l.label, CAST(t.row IS NOT NULL AS INT) AS y, CAST('0x' || substr(md5(o.row || '-' || l.label), 1, 4) AS INT) / 65536 AS score FROM o CROSS JOIN l LEFT JOIN t ON t.row = o.row AND t.label = l.label),
p AS (SELECT *, CAST(score >= 0.4 AS INT) AS predicted FROM c)"""


def _four(x: str, e: int) -> str:
    return f"coalesce(2 * tp / nullif(np + nt, 0), {e}) AS f1, coalesce(tp / nullif(np, 0), 0) AS pr, coalesce(tp / nullif(nt, 0), 0) AS re, coalesce(tp / nullif(np + nt - tp, 0), {e}) AS ja FROM (SELECT {x} sum(y * predicted) AS tp, sum(predicted) AS np, sum(y) AS nt FROM p"


_ALL4 = ("f1", "precision", "recall", "jaccard")


@query(f"""{_C}, mi AS (SELECT {_four('', 0)})), ma AS (SELECT nt, {_four('label,', 0)} GROUP BY label)), sa AS (SELECT {_four('row,', 1)} GROUP BY row))
SELECT {', '.join(f"round((SELECT {s} FROM mi), 9) AS {n}_micro, round((SELECT avg({s}) FROM ma), 9) AS {n}_macro, round((SELECT sum({s} * nt) / sum(nt) FROM ma), 9) AS {n}_weighted, round((SELECT avg({s}) FROM sa), 9) AS {n}_samples" for s, n in zip(("f1", "pr", "re", "ja"), _ALL4))},
 round(avg(CAST(y = predicted AS INT)), 9) AS accuracy, round(avg(CAST(y <> predicted AS INT)), 9) AS hamming_loss, count(*) FILTER (y = 1 AND predicted = 1) AS tp, count(*) FILTER (y = 0 AND predicted = 1) AS fp FROM p""")
def multilabel_scores(spark, sf_dir):
    """Micro, macro, weighted and by-row averages of four ratios."""
    return _rounded(M.multilabel_metrics(_cells(spark, sf_dir), "row"))


@query(f"""{_C}, r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, label) AS r FROM p), g AS (SELECT row, sum(CASE WHEN r <= 5 THEN y ELSE 0 END) AS h, sum(y) AS t FROM r GROUP BY row) SELECT round(avg(h / least(t, 5)), 9) AS topk_precision, count(*) AS n FROM g WHERE t > 0""")
def topk_precision5(spark, sf_dir):
    return _rounded(M.topk_precision(_cells(spark, sf_dir), "row", 5))


@query(f"""{_C}, r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, label) AS r FROM p) SELECT right(label, 1) AS kind, round(avg(CAST(r <= 5 AS INT)), 9) AS accuracy, count(*) AS n FROM r WHERE y = 1 GROUP BY 1""")
def topk_hits5(spark, sf_dir):
    """True brands among the five best of their order, by the last digit of the brand."""
    cells = _cells(spark, sf_dir).withColumn("kind", F.right("label", F.lit(1)))
    return _rounded(M.topk_hits(cells, "row", 5, ("kind",)), "kind")


_AP = lambda g: f"SELECT {g} AS g, sum(pos * tp / n) / sum(pos) AS v, sum(pos) AS n FROM (SELECT {g}, pos, sum(pos) OVER w AS tp, sum(all_) OVER w AS n FROM (SELECT {g}, score, sum(y) AS pos, count(*) AS all_ FROM (SELECT *, 0 AS one FROM p) GROUP BY ALL) WINDOW w AS (PARTITION BY {g} ORDER BY score DESC)) GROUP BY {g} HAVING sum(pos) > 0"


@query(f"""{_C}, l1 AS ({_AP('label')}), r1 AS ({_AP('row')}), o1 AS ({_AP('one')})
SELECT round((SELECT v FROM o1), 9) AS micro, round((SELECT avg(v) FROM l1), 9) AS macro, round((SELECT sum(v * n) / sum(n) FROM l1), 9) AS weighted, round((SELECT avg(v) FROM r1), 9) AS samples""")
def multilabel_average_precision(spark, sf_dir):
    return _rounded(M.average_precisions(_cell_rows(spark, sf_dir), "row"))


@query(f"{_C} SELECT round(sum(predicted) / count(DISTINCT row), 9) AS mean_predicted, count(DISTINCT row) AS n FROM p")
def predicted_set_size(spark, sf_dir):
    """Predicted labels a row, on average."""
    per = _cells(spark, sf_dir).groupBy("row").agg(F.sum("predicted").alias("k"))
    return per.agg(F.round(F.avg("k"), 9).alias("mean_predicted"), F.count("*").alias("n"))


@query(f"""{_C}, s AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY score), w AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score) - neg AS below FROM s) SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS roc_auc FROM w""")
def multilabel_auc_micro(spark, sf_dir):
    return M.roc_auc(_cells(spark, sf_dir)).select(F.round("roc_auc", 9).alias("roc_auc"))


_RA = lambda g: f"SELECT {g} AS g, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS v, sum(pos) AS n FROM (SELECT *, sum(neg) OVER (PARTITION BY {g} ORDER BY score) - neg AS below FROM (SELECT {g}, score, sum(y) AS pos, sum(1 - y) AS neg FROM (SELECT *, 0 AS one FROM p) GROUP BY ALL)) GROUP BY {g} HAVING sum(pos) > 0 AND sum(neg) > 0"


@query(f"""{_C}, l1 AS ({_RA('label')}), r1 AS ({_RA('row')}), o1 AS ({_RA('one')})
SELECT round((SELECT v FROM o1), 9) AS micro, round((SELECT avg(v) FROM l1), 9) AS macro, round((SELECT sum(v * n) / sum(n) FROM l1), 9) AS weighted, round((SELECT avg(v) FROM r1), 9) AS samples""")
def multilabel_auc_averages(spark, sf_dir):
    """AUC over all cells, by label plain and weighted, and by order."""
    return _rounded(M.roc_aucs(_cell_rows(spark, sf_dir), "row"))


@query(f"""{_C}, s AS (SELECT label, score, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY label, score), w AS (SELECT label, pos, neg, sum(neg) OVER (PARTITION BY label ORDER BY score) - neg AS below FROM s), a AS (SELECT label, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS v FROM w GROUP BY label) SELECT label, round(v, 9) AS roc_auc FROM a""")
def multilabel_auc_by_label(spark, sf_dir):
    return M.roc_auc(_cells(spark, sf_dir), by=("label",)).select("label", F.round("roc_auc", 9).alias("roc_auc"))


@query(f"""{_C}, d AS (SELECT DISTINCT a.label AS a, b.label AS b FROM l a JOIN l b ON a.label < b.label WHERE substr(md5(a.label || b.label), 1, 1) < '4'), k AS (SELECT x.label AS a, z.label AS b FROM p x JOIN p z ON x.row = z.row AND x.label < z.label WHERE x.predicted = 1 AND z.predicted = 1)
SELECT round(count(d.a) / count(*), 9) AS pair_rate, count(*) AS n_pairs FROM k LEFT JOIN d USING (a, b)""")
def interaction_rate(spark, sf_dir):
    """Share of predicted brand pairs that an adjacency table forbids."""
    cells = _cells(spark, sf_dir).where("predicted = 1")
    labels = table(spark, sf_dir, "part").select(F.col("p_brand").alias("a")).distinct()
    pairs = labels.join(F.broadcast(labels.select(F.col("a").alias("b"))), F.col("a") < F.col("b")).where(F.substring(F.md5(F.concat("a", "b")), 1, 1) < "4")  # at most 25 brands
    return _rounded(M.pair_rate(cells, pairs, "row", "label"))


@query("""SELECT lang, round(avg(CASE WHEN (n_chars // 100) % 2 = toxic THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), ())""")
def category_accuracy(spark, sf_dir):
    """Accuracy by category and over all, in one pass."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    hit = (F.floor(F.col("n_chars") / 100) % 2 == F.col("toxic")).cast("double")
    return d.withColumn("hit", hit).rollup("lang").agg(F.round(F.avg("hit"), 9).alias("accuracy"), F.count("*").alias("n"))


@query("""SELECT round(avg(CAST(a.n_chars > b.n_chars AS INT)), 9) AS accuracy, count(*) AS n FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0""")
def preference_accuracy(spark, sf_dir):
    """How often the chosen of a pair scores higher; even ids are chosen over the next."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.floor(F.col("doc_id") / 2).alias("pair"))
    pairs = d.groupBy("pair").agg(F.max(F.when(F.col("doc_id") % 2 == 0, F.col("n_chars"))).alias("a"), F.max(F.when(F.col("doc_id") % 2 == 1, F.col("n_chars"))).alias("b")).where("a is not null and b is not null")
    return pairs.agg(F.round(F.avg((F.col("a") > F.col("b")).cast("double")), 9).alias("accuracy"), F.count("*").alias("n"))
