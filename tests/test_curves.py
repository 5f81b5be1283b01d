"""Metrics of cells: their disk, odd scores and labels, and rows as arrays."""

import collections
import os
import pathlib

import numpy as np
import pytest

LINES = "/root/testdata/sf0.1"


def written(spark, run) -> int:
    """Bytes that ``run`` leaves in the folder of Spark's shuffles."""
    at = spark.conf.get("spark.local.dir")
    sizes = lambda: {f"{d}/{f}": os.lstat(f"{d}/{f}").st_size for d, _, names in os.walk(at) for f in names if f.startswith("shuffle_")}
    before = sizes()
    run()
    return sum(n for f, n in sizes().items() if f not in before)


@pytest.mark.parametrize("name", ["multilabel_average_precision", "multilabel_auc_averages", "task_evaluations"])
def test_cells_are_not_shuffled(spark, name):
    from vitalgrid.plans.registry import QUERIES

    read = sum(pathlib.Path(f"{LINES}/{t}.parquet").stat().st_size for t in ("lineitem", "part"))
    assert written(spark, lambda: QUERIES[name](spark, LINES).collect()) < 20 * read


def _ap(cells):
    pos = sum(y for y, _ in cells)
    return sum(sum(1 for y, s in cells if y and s >= t) * sum(1 for y, s in cells if y and s == t) / sum(1 for _, s in cells if s >= t) for t in {s for _, s in cells}) / pos if pos else None


def _auc(cells):
    p, n = ([s for y, s in cells if y == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n)) if p and n else None


def _want(rows, f):
    """micro, macro, weighted and samples of (key, label, y, score) by plain definitions; null scores are lowest, NaN highest."""
    groups = [collections.defaultdict(list) for _ in range(3)]
    for key, label, y, s in rows:
        if y is not None:
            at = (-1, 0) if s is None else (1, 0) if s != s else (0, s)
            for g, k in zip(groups, (0, label, key)):
                g[k].append((y, at))
    by = [(f(c), sum(y for y, _ in c)) for k, c in groups[1].items() if k is not None]
    by = [(v, n) for v, n in by if v is not None]
    keys = [v for v in map(f, groups[2].values()) if v is not None]
    return [f(groups[0][0]), sum(v for v, _ in by) / len(by), sum(v * n for v, n in by) / sum(n for _, n in by), sum(keys) / len(keys)]


@pytest.mark.parametrize("held", [1 << 21, 50])
def test_cells_of_odd_scores(spark, monkeypatch, held):
    from pyspark.sql import functions as F
    from vitalgrid.operators import curves
    from vitalgrid.operators.metrics import average_precisions, roc_aucs

    monkeypatch.setattr(curves.counted, "__defaults__", (held,))
    rng = np.random.default_rng(3)
    odd = [None, float("nan"), float("inf"), -float("inf"), -0.0, 0.0, 1.0, -3.5, 7.25, 1e-300]
    rows = [(int(k) if k else None, ["a", "b", "ü", None, ""][rng.integers(5)], [0, 0, 1, None][rng.integers(4)], odd[rng.integers(10)] if rng.random() < 0.5 else round(float(rng.normal()), 1)) for k in rng.integers(0, 40, 400)]
    df = spark.createDataFrame(rows, "k int, label string, y int, score double").repartition(3)
    arrays = df.groupBy("k").agg(*(F.collect_list(F.struct(c)).alias(c) for c in ("label", "y", "score"))).select("k", F.col("label.label").alias("label"), F.col("y.y").alias("y"), F.col("score.score").alias("score"))
    for f, plain in ((average_precisions, _ap), (roc_aucs, _auc)):
        for shape in (df, arrays):
            assert f(shape, "k").select("micro", "macro", "weighted", "samples").first() == pytest.approx(_want(rows, plain))
    empty = average_precisions(df.limit(0), "k").first()
    assert list(empty) == [None] * 4


def test_cells_evaluated_by_row(spark):
    from pyspark.sql import functions as F
    from vitalgrid.operators.evaluate import evaluate

    rng = np.random.default_rng(4)
    rows = [(int(k), "abcd"[i % 4], [0, 0, 1, None][rng.integers(4)], float(rng.integers(4)), [0, 1, None][rng.integers(3)]) for i, k in enumerate(rng.integers(0, 30, 200))]
    rows += [(90, "a", 0, 0.5, 0), (91, "a", 1, 0.5, 1)]
    df = spark.createDataFrame(rows, "row int, label string, y int, score double, predicted int")
    names = ("label", "y", "score", "predicted")
    arrays = df.groupBy("row").agg(F.collect_list(F.struct(*names)).alias("c")).select("row", *(F.col(f"c.{n}").alias(n) for n in names))
    values = lambda d: {r["metric"]: r["value"] for r in d.collect()}
    whole = values(evaluate(df, mode="multilabel"))
    assert values(evaluate(arrays, mode="multilabel")) == pytest.approx(whole)
    got = values(evaluate(arrays, "REC"))
    assert len(got) == 6 and got == pytest.approx({m: whole[m] for m in got})
    assert values(evaluate(df, "REC")) == pytest.approx(got)
