"""Scores of summaries from one pass over texts, against the column expressions and plain definitions."""

import numpy as np
import pytest


def test_stem_is_the_column(spark):
    from vitalgrid.functions import stems as S

    rng = np.random.default_rng(5)
    ends = [x for rules in (S.PLURALS, S.MENDED, S.DOUBLE, S.SINGLE, S.LAST) for x, _, _ in rules] + ["ied", "eed", "ed", "ing", "y", "logi", "e", "ll", "ies", "alli", "ss"]
    starts = ["".join(rng.choice(list("aeiouybcdlnrstwxz09"), rng.integers(0, 7))) for _ in range(60)]
    words = [*S.IRREGULAR, *(a + b + c for a in starts for b in ends for c in ("", "s", "ed"))]
    got = spark.createDataFrame([(words,)], "w array<string>").select(S.stemmed("w")).first()[0]
    assert [S.stem(w) for w in words] == got


def test_common_place_of_one(spark):
    from vitalgrid.operators.overlap import common_places, summary_hits

    rng = np.random.default_rng(6)
    for _ in range(300):
        c = rng.integers(0, 6, rng.integers(1, 8))
        r = rng.permutation(np.unique(c))[: rng.integers(1, 5)]
        places = common_places(r, c)
        if len(places) == 1 < len(r):
            assert places == [max((i for i in range(len(r)) if r[i] == c[-1]), default=0)]
        assert summary_hits([r, r], [c]) <= min(len(c), 2 * len(r))


def test_summary_of_texts_in_one_pass(spark, sf):
    """The values, and texts that go to Python once: words were made by column expressions, for each score anew."""
    from pyspark.sql import functions as F
    from vitalgrid.functions import text as T
    from vitalgrid.functions.stems import summary_words
    from vitalgrid.operators import overlap as O
    from vitalgrid.operators.evaluate import evaluate
    from vitalgrid.plans.text import _pairs

    odd = [(-1, None, None, None), (-2, "", "", ""), (-3, "A b.\r\nC\x0bd! e\tf\xa0g", "İstanbul KELVIN. a b\n\nc", "x?  y.\fz A"), (-4, "same words. here", "same words. here", "same words. here")]
    p = _pairs(spark, sf).select("doc_id", "a", "c", F.col("b").alias("s")).union(spark.createDataFrame(odd, "k long, a string, c string, s string"))
    df = evaluate(p.select(F.col("doc_id").alias("key"), F.col("a").alias("predicted"), F.col("c").alias("y"), F.col("s").alias("source")), "SUMMARY")
    got = {r["metric"]: r["value"] for r in df.collect()}
    w = p.select("doc_id", *(T.words(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("a", "c", "s")))
    assert got["bleu"] == pytest.approx(O.corpus_bleu(w, "a", "c").first()["bleu"])
    assert got["sari"] == pytest.approx(w.agg(F.avg(100 * O.sari("s", "a", "c"))).first()[0])
    stems = p.select("doc_id", *(summary_words(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("a", "c")))
    want = O.rouge_runs(stems, "doc_id", "a", "c").agg(F.avg("rouge1"), F.avg("rouge2")).first()
    assert (got["rouge1"], got["rouge2"]) == pytest.approx(tuple(want))
    from vitalgrid.plans.registry import QUERIES

    assert QUERIES["summary_evaluation"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
