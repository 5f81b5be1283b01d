"""Stems, overlaps, calibration, paths and stores against plain definitions and hand-made cases."""

import hashlib
import uuid
from collections import Counter, deque

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F


def one(spark, column, **values):
    """The value of a column over one row of strings."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_numbered_items(spark):
    from vitalgrid.functions.text import numbered_items

    items = lambda s: one(spark, numbered_items("t"), t=s)
    assert items("1 first question\n2 second question") == ["first question", "second question"]
    assert items("2. Why 3 cats run?") == ["Why", "cats run?"]
    assert items("1.a\n\n 12 x1 y") == ["a", "12 x1 y"]
    assert items("3\nfoo 7") == ["foo 7"] and items("1. 2. 9\t3\xa0b") == ["b"] and items("") == []


def test_last_paragraph_answer(spark):
    from vitalgrid.functions.text import last_paragraph_answer

    text = "x. The answer is: no\n\nAnswer: Yes, the\nsecond line."
    assert one(spark, last_paragraph_answer("t"), t=text) == "yes second line"
    assert one(spark, last_paragraph_answer("t", gold=True), t=text) == "yes, the\nsecond line."
    assert one(spark, last_paragraph_answer("t"), t="Answer: a The answer is: B b\n\n\nC") == "c"


def test_rank_rewards(spark):
    from vitalgrid.operators.traces import rank_reward

    rank = lambda a, b, c: one(spark, rank_reward(F.col("a"), F.col("b"), F.col("c")), a=a, b=b, c=c)
    assert [rank("u v", "u v w", "x"), rank("u", "x", "u"), rank(None, "x", None), rank("u", None, "u")] == [0.1, -0.1, -0.1, 0.0]


#: Published examples of the stemmer, word and stem.
STEMS = """caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster motoring motor conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file
happy happi relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ analogousli analog vietnamization vietnam predication predic operator oper
feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ
angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat cease ceas controll control dying die news news innings inning died die flies fli cried cri the the aged age""".split()


def test_stems(spark):
    from vitalgrid.functions.stems import sentences, stemmed

    got = spark.createDataFrame([(STEMS[::2],)], "w array<string>").select(stemmed("w")).first()[0]
    assert [x for x in zip(STEMS[::2], got, STEMS[1::2]) if x[1] != x[2]] == []
    assert one(spark, sentences("t"), t="One here. Two!\nThree  x?\n \n4") == ["One here.", "Two!", "Three  x?", "4"]


def plain_places(r, c):
    t = [[0] * (len(c) + 1) for _ in range(len(r) + 1)]
    for i in range(1, len(r) + 1):
        for j in range(1, len(c) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if r[i - 1] == c[j - 1] else max(t[i - 1][j], t[i][j - 1])
    i, j, out = len(r), len(c), []
    while i and j:
        if r[i - 1] == c[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out[::-1], t[len(r)][len(c)]


def plain_hits(gold, given):
    left, hits = [Counter(w for s in x for w in s) for x in (gold, given)], 0
    for r in gold:
        for i in sorted({i for c in given for i in plain_places(r, c)[0]}):
            if left[0][r[i]] > 0 and left[1][r[i]] > 0:
                hits += 1
                left[0][r[i]] -= 1
                left[1][r[i]] -= 1
    return hits


def test_subsequences():
    from vitalgrid.operators.overlap import common_length, common_places, common_runs, summary_hits

    rng = np.random.default_rng(0)
    for t in range(200):
        draw = lambda n: rng.integers(0, 1 + t % 9, rng.integers(0, n))
        r, c = draw(40), draw(40)
        places, length = plain_places(r.tolist(), c.tolist())
        assert common_places(r, c) == places and common_length(r, c) == length == len(places)
        gold, given = [draw(9) for _ in range(rng.integers(0, 6))], [draw(9) for _ in range(rng.integers(0, 6))]
        assert summary_hits(gold, given) == plain_hits([x.tolist() for x in gold], [x.tolist() for x in given])
    lists = [[[str(x) for x in rng.integers(0, 4, rng.integers(0, 12))] for _ in range(30)] + [None, []] for _ in range(2)]
    for n in (1, 2, 3, 4):
        grams = lambda w: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        want = [sum((grams(a or []) & grams(b or [])).values()) for a, b in zip(*lists)]
        assert common_runs(*(pa.array(x, pa.list_(pa.string())) for x in lists), n).tolist() == want


def test_rouge_lsum(spark, sf):
    """Two hundred pairs of the given texts against plain loops over stemmed sentences."""
    from vitalgrid.functions.stems import sentences, summary_words
    from vitalgrid.operators.overlap import rouge
    from vitalgrid.plans.text import _pairs

    p = _pairs(spark, sf).limit(200).cache()
    got = {r["doc_id"]: r for r in rouge(p, "doc_id", "a", "c").collect()}
    words = p.select("doc_id", *(F.transform(sentences(c), summary_words).alias(n) for n, c in (("x", "a"), ("y", "c")))).collect()
    assert len(got) == 200
    for r in words:
        size = sum(map(len, r["x"])) + sum(map(len, r["y"]))
        hits = plain_hits(r["y"], r["x"])
        assert got[r["doc_id"]]["rougeLsum"] == pytest.approx(2 * hits / size if size else 0.0, abs=1e-12)
    empty = spark.createDataFrame([(1, "", "a b"), (2, None, None), (3, "...", "a")], "k int, a string, c string")
    assert all(tuple(r)[1:] == (0.0, 0.0, 0.0) for r in rouge(empty, "k", "a", "c").collect())
    assert rouge(empty.limit(0), "k", "a", "c").collect() == []


def test_corpus_bleu(spark):
    from vitalgrid.operators.overlap import corpus_bleu

    rows = [(1, "the cat sat on the mat".split(), "the cat sat on the mat".split()), (1, ["a"], ["a", "b"]), (2, ["x"], ["y"]), (3, [], ["y"]), (3, None, None), (4, "a b c d".split(), "a b d c e".split())]
    got = {r["g"]: r for r in corpus_bleu(spark.createDataFrame(rows, "g int, a array<string>, c array<string>"), "a", "c", ("g",)).collect()}
    assert got[1]["bleu"] == pytest.approx(100 * np.exp(1 - 8 / 7)) and got[1]["n"] == 2
    assert got[2]["bleu"] == 0 and got[3]["bleu"] == 0
    assert got[4]["bleu"] == pytest.approx(100 * np.exp(1 - 5 / 4) * (1 * (1 / 3) * (1 / (2 * 2)) * (1 / (4 * 1))) ** 0.25)


def test_answer_scores(spark):
    from vitalgrid.functions.text import answer_scores

    rows = [(1, "a b b", "b b c d"), (2, "yes", "no way"), (3, "yes", "yes"), (4, "", "x"), (5, "p q", "r")]
    got = {r["k"]: tuple(r)[1:] for r in answer_scores(spark.createDataFrame(rows, "k int, p string, g string"), "k", "p", "g").collect()}
    assert got == {1: (pytest.approx(4 / 7), pytest.approx(2 / 3), 0.5), 2: (0, 0, 0), 3: (1, 1, 1), 4: (0, 0, 0), 5: (0, 0, 0)}


def test_sums_below_of_odd_scores(spark):
    from vitalgrid.operators.metrics import average_precision, roc_auc, sums_below

    rng = np.random.default_rng(1)
    rows = [(int(i % 2), float(s)) for i, s in enumerate(np.concatenate([rng.normal(0.5, 2, 300).round(2), [0.0, 1.0, -5.0, 7.0]]))]
    df = spark.createDataFrame(rows, "y int, score double")
    y, s = (np.array(x) for x in zip(*rows))
    pos, neg = s[y == 1], s[y == 0]
    assert roc_auc(df).first()[0] == pytest.approx(((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg)))
    assert roc_auc(df, small_groups=True).first()[0] == pytest.approx(roc_auc(df).first()[0])
    want = sum((pos == v).sum() * (pos >= v).sum() / (s >= v).sum() for v in np.unique(s)) / len(pos)
    assert average_precision(df).first()[0] == pytest.approx(want)
    g = spark.createDataFrame([(None, 0.5, 2), (None, float("nan"), 3), ("a", 0.1, 1), ("a", None, 4)], "g string, s double, n long")
    got = {(r["g"], r["n"]): (r["below_n"], r["total_n"]) for r in sums_below(g, "s", ("n",), ("g",)).collect()}
    assert got == {(None, 2): (0, 5), (None, 3): (2, 5), ("a", 1): (4, 5), ("a", 4): (0, 5)}
    assert roc_auc(df.limit(0)).first()[0] is None


def plain_sample(llm, question, context, gold, right, seeds, rewrite, most):
    """The queue of one question, item by item."""
    queue, golden, negative, taken = deque((s, [], "") for s in seeds), [], [], 0
    chosen = {"own": [], "rag": [1, 5]}
    while queue and taken < most:
        sub, path, history = queue.popleft()
        own, rag = llm(f"answer:  {history} {sub}"), llm(f"answer: {context} {history} {sub}")
        h_own = history + f"\n{len(path)}. {sub}\nAnswer{own}"
        h_rag = h_own + f"\n{len(path)}. {sub}\nAnswer{rag}"
        steps, ok, follow = {}, {}, {}
        for name, source, choice, answer, h in (("own", "LLM", "no", own, h_own), ("rag", "RAG", "yes", rag, h_rag)):
            check = llm(f"check: {h} {question}")
            ok[name], follow[name] = right(check, gold), llm(f"follow: {h} {sub}")
            steps[name] = [source, sub, answer, choice, "" if name == "own" else context, rewrite, h, check]
        if ok["own"] or ok["rag"]:
            a, b = ("own", "rag") if ok["own"] else ("rag", "own")
            golden.append([*path, [*steps[a], "", chosen[a]]])
            negative.append([*path, [*steps[b], "", chosen[b]]])
            break
        whole = {n: [*steps[n], follow[n], chosen[n]] for n in steps}
        negative += [[*path, whole["rag"]], [*path, whole["own"]]]
        queue += [(follow["own"], [*path, whole["own"]], h_own), (follow["rag"], [*path, whole["rag"]], h_rag)]
        taken += 1
    return golden, negative


def test_sampled_paths(spark):
    from vitalgrid.operators.agent import ask, echo_llm, subqueries
    from vitalgrid.operators.paths import PROMPTS, sample_paths, traces_from_paths
    from vitalgrid.operators.traces import instruction_rows, rewards

    rows = [(i, f"Why does item {i} work and how? Or when {i}", ("yes", "no", "zzz")[i % 3]) for i in range(12)] + [(50, "plain words here", "zzz"), (51, "", "yes"), (52, "one", None)]
    q = spark.createDataFrame(rows, "qid long, question string, groundtruth string")
    retrieve = lambda df: df.withColumn("context", F.concat(F.lit("ctx "), F.col("qid").cast("string"))).withColumn("chosen", F.array(F.lit(1), F.lit(5)))
    sampled = sample_paths(q, retrieve, "binary", most=5)
    paths: dict = {}
    for r in sampled.orderBy("qid", "kind", "n").collect():
        paths.setdefault((r["qid"], r["kind"]), []).append([list(s) for s in r["path"]])
    made = {r["qid"]: r["m"] for r in q.select("qid", subqueries(F.col("question"), ask(PROMPTS["rewrite"](F.col("question")), echo_llm)).alias("m")).collect()}
    llm = lambda p: echo_llm(pd.Series([p])).iloc[0]
    right = lambda a, g: (g or "") in " ".join(w for w in a.lower().replace(":", "").replace("?", "").replace(".", "").split() if w not in ("a", "an", "the"))
    ended = Counter()
    for i, question, gold in rows:
        seeds = [f"Base query: {question} \n\nSub query: {s}\n" for s in made[i][:2]]
        rewrite = "\n".join(f"{k + 1}. {s}\n" for k, s in enumerate(made[i]))
        golden, negative = plain_sample(llm, question, f"ctx {i}", gold, right, seeds, rewrite, 5)
        assert paths.get((i, "golden"), []) == golden and paths.get((i, "negative"), []) == negative, i
        ended[len(golden), len(negative) > 1] += 1
    assert len(ended) > 2  # ends at once, later and never
    traces = traces_from_paths(q, sampled)
    for r in traces.collect():
        golden, negative = paths.get((r["qid"], "golden"), [[]])[0], paths.get((r["qid"], "negative"), [[]])[0]
        assert [list(s) for s in r["path"]] == [[s[0], s[1], s[2], s[3], s[9], s[6], s[7]] for s in golden]
        assert (r["positive"], r["negative"]) == (golden[-1][6] if golden else None, negative[-1][6] if negative else None)
    kinds = Counter(r["kind"] for r in instruction_rows(traces, "qid").collect())
    some = sum(1 for i, *_ in rows if (i, "golden") in paths)
    assert kinds["no_gold_path"] == len(rows) - some and kinds["terminal"] == kinds["final_answer"] == some
    assert {r["rank"] for r in rewards(traces, "qid", [1, 2]).collect()} <= {0.0, 0.1, -0.1}


def plain_predict(llm, qid, question, context, seeds, rewrite, most):
    """The answering loop of one question, item by item."""
    first = llm(f"check:  {question}")
    if "incomplete" not in first.lower():
        return first, [], []
    queue, negatives, taken, path, history = deque((s, [], "") for s in [*seeds, question]), [], 0, [], ""
    while queue and taken < most:
        sub, path, past = queue.popleft()
        rag = "yes" in llm(f"decide: {past} {sub}").lower()
        source, known = ("RAG", context) if rag else ("LLM", "")
        answer = llm(f"answer: {known} {past} {sub}")
        history = past + f"\n{len(path)}. {sub}\nAnswer{answer}"
        check, follow = llm(f"check: {history} {question}"), llm(f"follow: {history} {sub}")
        done = "incomplete" not in check.lower()
        step = [source, sub, answer, "yes" if rag else "no", known, rewrite, history, check, "" if done else follow, []]
        if done:
            if int(hashlib.md5(f"{qid}-{taken}-0".encode()).hexdigest()[:2], 16) < 128:
                other = ["LLM" if rag else "RAG", sub, "", "yes" if rag else "no", "", rewrite, history + f"\n{len(path)}. {sub}\nAnswer", "", "", []]
                return check, [*path, step], [*negatives, [*path, other]]
            return check, [*path, step], [*negatives, [*path, step]]
        negatives.append([*path, step])
        queue.append((follow, [*path, step], history))
        taken += 1
    return llm(f"check: {history} {question}"), path, negatives


def test_predicted_paths(spark):
    from vitalgrid.operators.agent import ask, checking_llm, subqueries
    from vitalgrid.operators.paths import PROMPTS, predict_paths

    rows = [(i, f"Why does item {i} work and how? Or when {i}") for i in range(20)] + [(51, ""), (52, "one")]
    q = spark.createDataFrame(rows, "qid long, question string")
    got = {r["qid"]: r for r in predict_paths(q, lambda df: df.withColumn("context", F.lit("ctx")), checking_llm, most=5).collect()}
    made = {r["qid"]: r["m"] for r in q.select("qid", subqueries(F.col("question"), ask(PROMPTS["rewrite"](F.col("question")), checking_llm)).alias("m")).collect()}
    llm, ends = lambda p: checking_llm(pd.Series([p])).iloc[0], Counter()
    assert sorted(got) == sorted(i for i, _ in rows)
    for i, question in rows:
        seeds = [f"Base query: {question} \n\nSub query: {s}\n" for s in made[i][:1]]
        rewrite = "\n".join(f"{k + 1}. {s}\n" for k, s in enumerate(made[i]))
        answer, golden, negatives = plain_predict(llm, i, question, "ctx", seeds, rewrite, 5)
        lists = lambda path: [list(s) for s in path]
        assert (got[i]["answer"], lists(got[i]["golden"]), [lists(p) for p in got[i]["negatives"]]) == (answer, golden, negatives), i
        ends[len(negatives)] += 1
    assert len(ends) > 2  # at once, later and never


def test_vector_store(spark, sf, tmp_path, monkeypatch):
    from vitalgrid.operators import retrieval
    from vitalgrid.operators.stores import VectorStore

    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("kind"))
    rows = e.union(spark.createDataFrame([(10_000 + i, [0.5] * 64, 3) for i in range(300)] + [(20_000, None, 1)], "id long, vector array<float>, kind int"))  # a hot vector
    store = VectorStore.make(rows.where("id % 2 = 0"), f"{tmp_path}/store", cells=12)
    store.add(rows.where("id % 2 <> 0"))
    assert store.items().count() == rows.count() - 1 and sorted(store.items().columns) == ["cell", "id", "kind", "vector"]
    queries = rows.where("id % 20 = 0 and vector is not null").select(F.col("id").alias("qid"), "vector")
    key = lambda df: {(r["qid"], r["rank"]): (r["item"], round(r["distance"], 5)) for r in df.collect()}
    exact = key(retrieval.top_k(queries, rows.where("vector is not null"), 3, vector="vector"))
    assert key(store.exact(queries, 3)) == exact and key(store.search(queries, 3, probes=12)) == exact
    found = key(VectorStore(spark, f"{tmp_path}/store").search(queries, 3))
    true = Counter((q, x[0]) for (q, _), x in exact.items())
    assert sum(((q, x[0]) in true) for (q, _), x in found.items()) >= 0.9 * len(exact) and 1 <= store.probes <= 12
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 2000)  # several passes
    assert key(store.search(queries, 3, probes=12)) == exact and key(store.exact(queries, 3)) == exact


def test_mixing_by_weight(spark):
    from vitalgrid.operators.groups import interleave_by_weight

    parts = [spark.range(a, b).withColumnRenamed("id", "k") for a, b in ((0, 40), (100, 110), (200, 200))]
    over = interleave_by_weight(parts, [3.0, 1.0, 1.0], "k", "over", 2).collect()
    assert {r["k"] for r in over} == {*range(40), *range(100, 110)}
    under = interleave_by_weight(parts[:2], [1.0, 1.0], "k", "under", 2).collect()
    assert sorted(r["turn"] for r in under) == list(range(len(under))) and len({r["k"] for r in under}) == len(under)
    assert sum(r["k"] >= 100 for r in under) == 10 and next(r["k"] for r in under if r["turn"] == len(under) - 1) >= 100
    assert interleave_by_weight(parts, [1, 1, 1], "k").collect() == [] and uuid.uuid4()


def plain_grams(words, n):
    return list(zip(*(words[i:] for i in range(n))))


def plain_bleu(candidate, reference):
    logs = 0.0
    for n in range(1, 5):
        c, r = Counter(plain_grams(candidate, n)), Counter(plain_grams(reference, n))
        hit, total = sum((c & r).values()), sum(c.values())
        if n == 1 and not hit:
            return 0.0
        logs += np.log((hit + (n > 1)) / (total + (n > 1)))
    return np.exp(logs / 4 + min(0.0, 1 - len(reference) / len(candidate)))


def plain_sari(source, candidate, reference):
    ratio, scores = lambda a, b: a / b if b else 1.0, []
    for n in range(1, 5):
        s, c, r = (set(plain_grams(x, n)) for x in (source, candidate, reference))
        f = []
        for got, want in ((c & s, r & s), (c - s, r - s)):
            p, q = ratio(len(got & want), len(got)), ratio(len(got & want), len(want))
            f.append(2 * p * q / (p + q) if p + q else 0.0)
        scores.append((f[0] + f[1] + ratio(len((s - c) - r), len(s - c))) / 3)
    return sum(scores) / 4


def test_generation_scores(spark):
    from vitalgrid.operators.overlap import character_bleu, sari

    rng = np.random.default_rng(3)
    text = lambda: "".join(rng.choice(list("abé 😀"), rng.integers(0, 30)))
    rows = [(i, text(), text()) for i in range(80)] + [(80, None, "a"), (81, "", ""), (82, "a", None), (83, "ab", "ab")]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    for r in df.select("k", "a", "b", character_bleu("a", "b").alias("s")).collect():
        a, b = list(r["a"] or ""), list(r["b"] or "")
        assert r["s"] == pytest.approx(plain_bleu(a, b) if a else 0.0)
    words = lambda: [str(x) for x in rng.integers(0, 5, rng.integers(0, 12))]
    lists = [(i, words(), words(), words()) for i in range(80)] + [(80, [], [], []), (81, None, ["1"], ["2"])]
    for r in spark.createDataFrame(lists, "k int, s array<string>, c array<string>, r array<string>").select("*", sari("s", "c", "r").alias("x")).collect():
        assert r["x"] == pytest.approx(plain_sari(r["s"] or [], r["c"] or [], r["r"] or []))


def test_readability(spark):
    from vitalgrid.functions.text import coleman_liau, dale_chall, reading_grade

    df = spark.createDataFrame([(1, "The little table is here. Make it so!"), (2, ""), (3, None), (4, "?!"), (5, "hard words hard")], "k int, t string")
    got = {r["k"]: (r["g"], r["c"]) for r in df.select("k", reading_grade("t").alias("g"), coleman_liau("t").alias("c")).collect()}
    # the, lit-tle, ta-ble, is, here, make, it, so: final e of here and make is silent, that of table is not
    assert got[1][0] == pytest.approx(0.39 * 8 / 2 + 11.8 * 10 / 8 - 15.59) and got[2] == (0, 0) and got[3] == (None, None) and got[4] == (0, 0)
    familiar = spark.createDataFrame([("the",), ("little",), ("table",), ("is",), ("here",), ("make",), ("it",), ("words",), ("words",)], "word string")
    hard = {r[0]: r[1] for r in dale_chall(df, "k", "t", familiar).collect()}
    assert hard[1] == pytest.approx(0.1579 * 12.5 + 0.0496 * 4 + 3.6365) and hard[5] == pytest.approx(0.1579 * 200 / 3 + 0.0496 * 3 + 3.6365) and hard[2] == hard[3] == hard[4] == 0


def test_communities(spark):
    from vitalgrid.operators.communities import community_chunks, described, described_communities

    rows = [(i, None if i % 7 == 0 else f"t{i}", "a" if i % 3 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, t string, c string").repartition(4)
    chunks = {(r["community"], r["chunk"]): r["texts"] for r in community_chunks(df, "c", "k", "t", 8).collect()}
    for c in ("a", None):
        texts = [t for _, t, x in rows if x == c and t]
        assert [chunks[c, i] for i in range(-(-len(texts) // 8))] == [texts[i : i + 8] for i in range(0, len(texts), 8)]
    tries = Counter()

    def model(prompts):
        if len(prompts) > 1:
            raise RuntimeError("busy")
        p = prompts.iloc[0]
        tries[p] += 1
        if p.endswith("3") or (p.endswith("4") and tries[p] < 3):
            raise RuntimeError("no")
        return prompts.str.upper()

    one = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "k int, p string").coalesce(1)
    assert sorted((r["k"], r["description"]) for r in described(one, F.col("p"), model).collect()) == [(i, f"P{i}") for i in (0, 1, 2, 4, 5)]
    assert 4 not in [r["k"] for r in described(one, F.col("p"), model, tries=2).collect()]
    told = described_communities(df, "c", "k", "t", lambda p: p.str.len().astype(str), 8).orderBy("id").collect()
    assert [r["id"] for r in told] == list(range(len(chunks))) and told[0]["community"] is None
    assert described_communities(df.limit(0), "c", "k", "t", lambda p: p).collect() == []


def test_shuffle_buffer(spark, tmp_path):
    from vitalgrid.streaming.loading import buffered_shuffle

    rows = spark.range(1000).repartition(3).cache()
    order = lambda **x: [r["id"] for r in buffered_shuffle(rows, **x).collect()]
    first = order(buffer=50, seed=1)
    assert sorted(first) == list(range(1000)) and first != [r["id"] for r in rows.collect()]
    assert order(buffer=50, seed=1) == first and order(buffer=50, seed=1, epoch=1) != first and order(buffer=50, seed=2) != first
    assert order(buffer=1, seed=1) == [r["id"] for r in rows.collect()] and sorted(order(buffer=10**6)) == list(range(1000))
    line = spark.range(5000).coalesce(1)
    moved = [r["id"] for r in buffered_shuffle(line, 100, 3).collect()]
    assert sorted(moved) == list(range(5000)) and all(x <= i + 100 for i, x in enumerate(moved))  # nothing comes out before it came in
    rows.write.parquet(f"{tmp_path}/in")
    stream = buffered_shuffle(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), 50, 1)
    q = stream.writeStream.format("memory").queryName("shuffled").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.table("shuffled").collect()) == list(range(1000))


def test_append_log(spark, tmp_path):
    from vitalgrid.streaming.loading import append_batch, append_stream, read_log, reward_rows

    at, rows = f"{tmp_path}/log", spark.createDataFrame([("a", "b", 1.5, None)], "predicted string, gold string, reward double, parts string")
    append_batch(reward_rows(rows), at, 0)
    append_batch(reward_rows(rows), at, 1)
    append_batch(reward_rows(rows), at, 1)  # a batch again after a restart
    append_batch(reward_rows(rows), at, 1, source="other")
    got = Counter((r["source"], r["batch"], r["reward"], r["parts"]) for r in read_log(spark, at).collect())
    assert got == {("main", 0, "1.5", "NA"): 1, ("main", 1, "1.5", "NA"): 1, ("other", 1, "1.5", "NA"): 1}
    for k in range(2):
        spark.range(k * 10, k * 10 + 10).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema("id long").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        append_stream(stream, f"{tmp_path}/ids", f"{tmp_path}/marks")
    assert sorted(r["id"] for r in read_log(spark, f"{tmp_path}/ids").collect()) == list(range(20))


def test_registry_keys(spark, tmp_path):
    from vitalgrid.sources.registry import Dataset, Registry, Tags

    (tmp_path / "d" / "sub" / "fold").mkdir(parents=True)
    (tmp_path / "d" / "sub" / "fold" / "train-0.json").write_text('{"instruction": "q1", "output": "a1"}\n{"instruction": "q2", "output": "a2"}\n')
    (tmp_path / "d" / "sub" / "fold" / "test-0.json").write_text('{"instruction": "q3", "output": "a3"}\n')
    (tmp_path / "rank.json").write_text('{"q": "x", "good": "g", "bad": "b"}\n{"q": "y", "good": "g"}\n')
    m = lambda *turns: '{"messages": [' + ", ".join(f'{{"who": "{a}", "what": "{b}"}}' for a, b in turns) + "]}\n"
    (tmp_path / "chat.json").write_text(m(("s", "sys"), ("u", "1"), ("b", "2"), ("u", "3"), ("b", "4")) + m(("u", "5"), ("b", "6")) + m(("u", "7")) + m(("b", "8"), ("u", "9")) + m(("u", "1"), ("?", "2")) + '{"messages": []}\n')
    reg = Registry(
        train=Dataset(f"{tmp_path}/d", subset="sub", folder="fold", split="train"), all=Dataset(f"{tmp_path}/d", subset="sub", folder="fold"), few=Dataset(f"{tmp_path}/d", subset="sub", folder="fold", num_samples=7),
        rank=Dataset(f"{tmp_path}/rank.json", columns={"prompt": "q", "chosen": "good", "rejected": "bad"}, ranking=True), bad=Dataset(f"{tmp_path}/rank.json", ranking=True),
        chat=Dataset(f"{tmp_path}/chat.json", formatting="chat", columns={"messages": "messages"}, tags=Tags("who", "what", "u", "b", "o", "f", "s")),
    )
    prompts = lambda *a, **k: sorted(r["prompt"] for r in reg.load(spark, *a, **k).collect())
    assert prompts("train") == ["q1", "q2"] and prompts("all") == ["q1", "q2", "q3"] and prompts("train", most=1) == ["q1"]
    assert len(prompts("few")) == 7 and max(Counter(prompts("few")).values()) == 3
    assert [(r["prompt"], r["chosen"], r["rejected"]) for r in reg.load(spark, "rank").collect()] == [("x", "g", "b")]
    got = sorted(((r["system"], r["history"], r["prompt"], r["response"]) for r in reg.load(spark, "chat").collect()), key=str)
    assert got == [("sys", ["1", "2"], "3", "4"), (None, [], "5", "6")] or got == [(None, [], "5", "6"), ("sys", ["1", "2"], "3", "4")]
    assert Counter(r["dataset"] for r in reg.mix(spark, "train", "rank").collect()) == {"train": 2, "rank": 1}
    for name in ("bad", "none"):
        with pytest.raises(ValueError):
            reg.load(spark, name)


def test_evaluation_by_task(spark):
    from vitalgrid.operators.evaluate import NAMES, evaluate, unmatched

    qa = spark.createDataFrame([("A", "A"), ("B", "A"), ("x", "C"), ("C", "C")], "predicted string, y string")
    got = {r["metric"]: r["value"] for r in evaluate(qa, "SINGLE").collect()}
    assert got == {"accuracy": 0.5, "em": 0.5, "f1_score": pytest.approx((2 * 2 / 3 + 1) / 3)}
    text = spark.createDataFrame([(1, "a cat sat", "the cat sat", "a big cat sat down"), (2, "", "x", "y")], "key int, predicted string, y string, source string")
    assert {r["metric"] for r in evaluate(text, "SUMMARY").collect()} == set(NAMES["summary"])
    assert [r["metric"] for r in evaluate(text, mode="words", metrics=("recall",)).collect()] == ["recall"]
    pairs = spark.createDataFrame([(1, 0.9, 1), (0, 0.4, 0), (1, 0.2, 0)], "y int, score double, predicted int")
    assert {r["metric"]: r["value"] for r in evaluate(pairs, "REA").collect()}["roc_auc"] == 0.5
    for bad in ({"task": "MULTI"}, {"mode": "none"}, {}, {"task": "REA", "metrics": ("none",)}):
        with pytest.raises(ValueError):
            evaluate(pairs, **bad)
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,), (3,)], "k int")
    assert sorted(map(tuple, unmatched(a, b, "k").collect())) == [(1, "prediction"), (3, "truth"), (3, "truth")]


def test_normal_forms(spark):
    from vitalgrid.functions.text import normal_output, normalize_answer, spaced_normal, unify

    assert one(spark, normalize_answer("t"), t="L’a b, The a an Theo a_b é a") == "l’ b theo ab é" and one(spark, normalize_answer("t"), t="the an a") == ""
    assert one(spark, normalize_answer("t"), t="l’a b") == "l’ b" and one(spark, normalize_answer("t"), t="a the an x1 a") == "x1"
    text = "“q” ‘s’ – — −\x0b5′ 6″ 7‴ 8⁗ x… y\xadz ⁄ ～ ˜ ?? !!! \x01\x1b\x10"
    assert one(spark, unify("t"), t=text) == "\"q\" 's' - - - 5' 6'' 7''' 8'''' x... yz / ~ ~ ? ! \x10"
    assert one(spark, normal_output("t"), t="The “A” – an end… a") == '" " - end...' and one(spark, spaced_normal("t"), t="The “A” – an end… a") == "end"


def test_task_samples(spark):
    from vitalgrid.operators.cohort import MODES, SOURCES, task_samples

    assert {t for tasks in SOURCES.values() for t in tasks} == {"PHE", "DIAG", "REC", "LOS", "MOR", "REA", "IHM"} <= set(MODES)
    for source, task in (("MIV", "DIAG"), ("PIC", "LOS"), ("none", "LOS"), ("MIII", "PHE")):
        with pytest.raises(ValueError):
            task_samples(spark.range(1), source, task)


def test_training_mix(spark):
    from vitalgrid.operators.groups import training_mix, validation_split

    kinds = ["rewrite", "followup", "sub_response", "meta_chose", "final_answer", "decision", "other"]
    rows = [(f"{k}{i}", k, "x") for k in kinds for i in range(9)] + [(f"t{i}", "terminal", "yes" if i < 4 else "no") for i in range(20)] + [(f"n{i}", "no_gold_path", "x") for i in range(5)]
    df = spark.createDataFrame(rows, "key string, kind string, output string")
    count = lambda *a, **k: Counter(r["kind"] for r in training_mix(df, "key", *a, **k).collect())
    full = {"terminal": 20, "no_gold_path": 5}
    assert count("MIII-IHM", divisor=10) == {**full, **dict.fromkeys(kinds[:6], 2)} and count("MIII-IHM") == full
    assert count("eICU-LOS", divisor=5) == {**full, "rewrite": 5, "followup": 5, "final_answer": 5, "decision": 5}
    assert count("X-SUMMARY", divisor=5) == {**full, "final_answer": 5, "decision": 5}
    twice = training_mix(df, "key", "MIII-IHM", label="yes", times=3, divisor=10).where("kind = 'terminal'").collect()
    assert Counter((r["output"], r["copy"]) for r in twice) == {("yes", 1): 4, ("yes", 2): 4, ("yes", 3): 4, ("no", 1): 4}
    assert count("MIII-REA", label="yes", times=3, divisor=10) == {**full, **dict.fromkeys(kinds[:5], 2)}
    split = lambda n: Counter(r["split"] for r in validation_split(spark.range(10), "id", n).collect())
    assert split(3) == {"val": 3, "train": 7} and split(0.25) == {"val": 3, "train": 7} and split(0) == {"train": 10} and split(99) == {"val": 9, "train": 1}
    with pytest.raises(ValueError):
        validation_split(spark.range(1), "id", 1.5)


def test_prompts(spark):
    from vitalgrid.operators.prompts import FAMILIES, fill, found_chunks, found_graph, summary_prompts
    from vitalgrid.sources.visits import names_at_level, names_without_dots

    assert one(spark, fill("{a} and {b}{a}", a="x", b=F.col("y")), x="1", y=None) == "1 and 1"
    with pytest.raises(ValueError):
        fill(FAMILIES["answer"], context=F.lit("x"))
    chunks = spark.createDataFrame([(1, 2, 0.5, "b"), (1, 1, 0.9, "a")], "qid int, rank int, score double, text string")
    asked = spark.createDataFrame([(1, "why"), (2, "how")], "qid int, question string")
    got = {r["qid"]: r["prompt"] for r in summary_prompts(asked, found_chunks(chunks)).collect()}
    assert got[1] == "Question: why\n\nText found:\n- chunk 1 (score 0.9): a\n- chunk 2 (score 0.5): b\nSummarise what bears on the question." and "Nothing found." in got[2]
    graph = spark.createDataFrame([(1, "node", "gene", 1, 7, "g7"), (1, "node", "drug", 1, 3, "d3")], "qid int, part string, kind string, rank int, item int, text string")
    assert found_graph(graph).first()["found"] == "Nodes found:\n- drug\n  - 3: d3\n- gene\n  - 7: g7\nEdges found:\nnone"
    names = spark.createDataFrame([("A", "x"), ("A01", "y"), ("01.2", "z")], "code string, name string")
    assert [r["code"] for r in names_at_level(names, 2).collect()] == ["A01"] and "012" in [r["code"] for r in names_without_dots(names).collect()]


def test_fewshot_prompt(spark, tmp_path):
    from oracle import TABLES, compare

    from vitalgrid.plans.registry import ORACLES, QUERIES

    rows = [(i, f"first {i}\nsecond, Q: {i}\n\nlast", "many") for i in range(2500)]
    rows += [(3000, "a\nb", "few"), (3001, None, "few"), (3002, "", "few"), (3003, "x", None), (3004, None, "none"), (3005, None, "none"), (3006, None, "none"), (3007, None, "none")]
    late = max(range(3004, 3008), key=lambda i: hashlib.md5(f"{i}-9".encode()).hexdigest())
    rows = [(i, "a target", s) if i == late else (i, t, s) for i, t, s in rows]
    for name in TABLES:
        table = spark.createDataFrame(rows, "doc_id long, text string, source string") if name == "documents" else spark.range(1)
        table.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    made = QUERIES["fewshot_prompt"](spark, str(tmp_path))
    compare(made, ORACLES["fewshot_prompt"], str(tmp_path))
    got = {r["doc_id"]: r["prompt"] for r in made.collect()}
    assert len(got) == len(rows) - 1 and 3003 not in got
    shots = {s: sorted((hashlib.md5(f"{i}-9".encode()).hexdigest(), t) for i, t, g in rows if g == s)[:3] for s in ("many", "few")}
    for i, t, s in rows:
        if s in shots:
            asked = "\n".join(f"Q: {x}" for _, x in shots[s] if x is not None)
            assert got[i] == (None if t is None else f"Questions on {s}\n{asked}\nQ: {t}\nA:")
    assert got[late] is None


def test_join_group_rows(spark):
    from vitalgrid.operators.groups import join_group_rows

    rows = spark.createDataFrame([(i, "a" if i < 40 else "b" if i < 43 else "c" if i < 50 else None) for i in range(60)], "id int, g string")
    one = spark.createDataFrame([("a", "x"), ("b", "y"), ("d", "z")], "g string, v string")
    want = sorted((i, "a", "x") if i < 40 else (i, "b", "y") for i in range(43))
    for most in (1, 7, 40, 1000):
        got = join_group_rows(rows, one, "g", "id", most)
        assert got.columns == ["g", "id", "v"] and sorted((r["id"], r["g"], r["v"]) for r in got.collect()) == want


def test_answers_from_texts(spark):
    from vitalgrid.functions.text import author_name, chat_question, journal_text, match_words
    from vitalgrid.operators.evaluate import evaluate_answers

    value = lambda rows, task: {r["metric"]: r["value"] for r in evaluate_answers(spark.createDataFrame(rows, "key int, predicted string, gold string, source string"), task).collect()}
    got = value([(1, "The answer is: yes.", "yes", ""), (2, "Answer: no", "yes", ""), (3, "hm", "no", ""), (4, None, "no", "")], "REA")
    assert got["accuracy"] == 0.75 and got["recall"] == 0.5 and got["precision"] == 1 and got["no_answer"] == 0.5
    stay = value([(1, "3 days", "3days", ""), (2, "some 12", "0days", ""), (3, "9", "4days", "")], "LOS")
    assert stay["accuracy"] == pytest.approx(2 / 3)
    assert value([(1, "It is B", "B", ""), (2, "Answer: C", "A", "")], "SINGLE")["em"] == 0.5
    assert value([(1, "the cat sat", "a cat sat", "cat sat there")], "SUMMARY")["rouge1"] == 1.0
    with pytest.raises(KeyError):
        value([(1, "x", "y", "")], "MULTI")
    chat = "x<|start_header_id|>user<|end_header_id|>\n\n Why\n  so ⋮?<|start_header_id|>assistant<|end_header_id|>a"
    assert one(spark, chat_question("t"), t=chat) == "Why so ?" and one(spark, chat_question("t"), t="none") == ""
    assert one(spark, author_name(F.col("a"), F.col("b")), a="Doe", b="Ann  Mary") == "Doe AM" and one(spark, author_name(F.col("a"), F.col("b")), a="Doe", b=None) == "Doe"
    journal = lambda t, y: one(spark, journal_text(F.col("t"), F.col("y")), t=t, y=y)
    assert journal("The Journal of Very Long Names Indeed", "2020") == "Journal Very Long Names Indeed, 2020" and journal("Cell", None) == "Cell" and journal(None, "1999") == "1999" and journal(None, None) is None
    assert one(spark, match_words("t"), t="A-b, (C) d") == ["ab", "c", "d"]
