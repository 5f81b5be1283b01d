"""Rules of the survey on hand-made rows."""

import datetime as dt
import json

from pyspark.sql import functions as F

from vitalgrid.functions import text as T
from vitalgrid.operators import cohort as C
from vitalgrid.operators import groups as G
from vitalgrid.operators import metrics as M
from vitalgrid.operators import stats as S
from vitalgrid.operators import traces as R
from vitalgrid.sources import files
from vitalgrid.streaming.sessions import event_sessions


def ts(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


def visits(spark):
    rows = [
        ("p1", 1, ts(0), "0", ["a"], ["x"], ["d"]),
        ("p1", 2, ts(14, 23), "1", [], ["x"], ["d"]),
        ("p1", 3, ts(30), "0", ["b"], ["y"], ["e"]),
        ("p1", 4, ts(45), None, ["c"], ["y"], ["f"]),
        ("p2", 5, ts(0), "0", ["a"], ["x"], ["d"]),
    ]
    return spark.createDataFrame(rows, "patient_id string, visit_id int, encounter_time timestamp, discharge_status string, conditions array<string>, procedures array<string>, drugs array<string>")


def test_next_visit_is_taken_before_the_filter(spark):
    got = {r["visit_id"]: (r["label"], r["conditions_hist"]) for r in C.build_samples(visits(spark), "readmission").collect()}
    assert got == {1: (1, [["a"]]), 3: (0, [["a"], ["b"]])}  # 14 d 23 h counts, exactly 15 days does not
    got = {r["visit_id"]: r["label"] for r in C.build_samples(visits(spark), "next_mortality").collect()}
    assert got == {1: 1, 3: 0}


def test_days_and_stay_classes(spark):
    row = spark.range(1).select(C.elapsed_days(F.lit(ts(1, 1)), F.lit(ts(0, 23))).alias("d"), *(C.los_class(F.lit(x)).alias(f"c{x}") for x in (0, 1, 7, 8, 14, 15))).first()
    assert tuple(row) == (0, 0, 1, 7, 8, 8, 9)


def test_masked_history_hides_the_current_value(spark):
    rows = C.with_masked_history(visits(spark).where("patient_id = 'p1'"), "drugs").orderBy("visit_id").collect()
    assert rows[0]["drugs_hist"] == [["<pad>"] * 3] and rows[2]["drugs_hist"] == [["<pad>"] * 3, ["d"], ["d"]]


def test_split_is_disjoint_and_whole(spark):
    s = G.split_keys(spark.range(1000), "id", (0.8, 0.1), 1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in s} == {"train": 800, "val": 100, "test": 100}
    assert G.split_keys(spark.range(0), "id", (0.8, 0.1), 1).count() == 0


def test_metrics_with_ties_and_single_class(spark):
    rows = spark.createDataFrame([("g", 1, 0.5), ("g", 0, 0.5), ("g", 1, 0.9), ("h", 1, 0.1)], "g string, y int, score double")
    assert {r["g"]: r["roc_auc"] for r in M.roc_auc(rows, by=("g",)).collect()} == {"g": 0.75, "h": None}
    got = M.multilabel_metrics(spark.createDataFrame([(1, "a", 0, 0), (1, "b", 0, 0), (2, "a", 1, 1), (2, "b", 1, 0)], "r int, label string, y int, predicted int"), "r").first()
    assert got["f1_samples"] == (1 + 2 / 3) / 2 and got["f1_macro"] == 0.5


def test_packed_masks(spark):
    rows = spark.createDataFrame([(0, [1, 1, 2, 2, 2, 0]), (1, [1, 2, 2, 3, 3, 3])], "k int, mask array<int>")
    s = S.sequence_offsets(S.segments(rows, "k", "mask"), "k").orderBy("k", "segment").collect()
    assert [r["length"] for r in s] == [2, 3, 1, 2, 3]
    assert [r["index"] for r in S.unpad_indices(rows, "k", "mask").where("k = 0").orderBy("index").collect()] == [0, 1, 2, 3, 4]


def test_text_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(T.multiple_choice(F.lit("The Answer is C"))) == "A"
    assert one(T.normalize_answer(F.lit("The  Cat, a DOG!"))) == "cat dog"
    assert one(T.locate_answer(F.lit(None).cast("string"))) == "NA"
    assert one(T.numbers(F.lit("1 x 22 y 99999999999999999999"))) == [1, 22, None]
    assert one(T.character_overlap(F.lit("ab"), F.lit(""))) == 0.0
    assert one(T.match_ratio(F.lit("the of"), F.lit("anything"))) == 0.0
    assert one(R.path_reward(F.array().cast("array<array<int>>"), F.array(F.lit(1)))) == 0.0
    assert one(R.length_reward(F.lit(5))) == -1.0 and one(R.length_reward(F.lit(1))) == one(R.length_reward(F.lit(3))) == 0.0


def test_readers(spark, tmp_path):
    (tmp_path / "log.txt").write_text("a || b || 1 || 2\nbroken\n")
    assert files.reward_log(spark, str(tmp_path / "log.txt")).collect() == [("a", "b", "1", "2")]
    (tmp_path / "q.json").write_text(json.dumps({"question": "q", "options": {"B": "two", "A": "one"}, "answer_idx": "A"}) + "\n\nbroken\n")
    assert files.split_questions(spark, str(tmp_path / "q.json")).na.drop("all", subset=["question"]).first()["options"] == "A. one\nB. two"
    (tmp_path / "s.json").write_text(json.dumps({"law": {"name": "Law", "category": "Other"}}))
    assert tuple(files.subject_categories(spark, str(tmp_path / "s.json")).first()) == ("law", "Law", "Other")
    (tmp_path / "b.csv").write_text('"what, then",1,2,3,4,C\n')
    assert files.benchmark_rows(spark, str(tmp_path / "b.csv"), "dev").first()["question"] == "what, then"
    xml = "<A><PMID>7</PMID><ArticleTitle>T</ArticleTitle><AbstractText Label='AIM'>x</AbstractText><Author><LastName>Li</LastName><Initials>B</Initials></Author><Journal><Title>J</Title></Journal></A>"
    row = files.articles(spark.createDataFrame([(xml,)], "xml string")).withColumn("chunk", files.chunk_text()).first()
    assert (row["id"], row["authors"], row["chunk"]) == ("7", ["Li B"], "AIM: x")


def test_registry(spark, tmp_path):
    rows = spark.createDataFrame([("i", "q", "a")], "instruction string, input string, output string")
    files.write_json_lines(rows, str(tmp_path / "d"))
    reg = files.Registry(d=files.Dataset(str(tmp_path / "d")))
    row = reg.mix(spark, "d", "d").first()
    assert (row["prompt"], row["query"], row["response"], row["system"]) == ("i", "q", "a", None)


def test_sessions_on_a_stream_meet_the_table(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    q = event_sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    whole = event_sessions(spark.read.parquet(f"{sf}/events.parquet"))
    closed = spark.table("sessions")
    assert closed.count() > 0 and closed.exceptAll(whole).count() == 0


def test_generation_scores_of_whole_texts(spark, tmp_path):
    import math
    import random
    import re
    import string

    from vitalgrid.plans.registry import QUERIES

    rng = random.Random(3)
    line = lambda n: " ".join(rng.choice(["ab", "ba,", "The", "Cat.", "é😀"]) for _ in range(n))
    texts = {1: "ab " * 90 + "xyz\n" + "ab " * 90 + "q", 2: f"{line(150)}\n{line(200)}\n{line(300)}", 3: line(400), 4: "a b\nb a", 5: "", 6: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    grams = lambda x, n: [tuple(x[i : i + n]) for i in range(len(x) - n + 1)]
    words = lambda t: re.sub("[%s]" % re.escape(string.punctuation), "", t.lower()).split()
    div = lambda a, b: a / b if b else 1.0

    def bleu(c, r):
        if not c or not set(c) & set(r):
            return 0.0
        logs = 0.0
        for n in range(1, 5):
            x, y = grams(c, n), grams(r, n)
            hit = sum(min(x.count(g), y.count(g)) for g in set(x))
            logs += math.log((hit + (n > 1)) / (len(x) + (n > 1))) / 4
        return math.exp(logs + min(0, 1 - len(r) / len(c)))

    def sari(source, cand, ref):
        out = 0.0
        for n in range(1, 5):
            s, c, r = (set(grams(words(x), n)) for x in (source, cand, ref))
            for got, want in ((c & s, r & s), (c - s, r - s)):
                p, q = div(len(got & want), len(got)), div(len(got & want), len(want))
                out += (2 * p * q / (p + q) if p + q else 0) / 12
            out += div(len((s - c) - r), len(s - c)) / 12
        return out

    for r in QUERIES["generation_scores"](spark, str(tmp_path)).collect():
        t = texts[r["doc_id"]] or ""
        a, c = t.split("\n")[0], (t.split("\n", 1) + [""])[1] or t
        assert abs(r["bleu4"] - bleu(a, c)) < 1e-8 and abs(r["sari"] - sari(t, a, c)) < 1e-8, r


def test_answer_rules_by_hand(spark):
    from pyspark.sql import functions as F

    from vitalgrid.functions import text as T
    from vitalgrid.operators import traces as R

    one = lambda c: spark.range(1).select(c).first()[0]
    located = {'x {"answer_choice": "B"} y': "B", "so {'answer': {'yes'}}": "yes", "The answer is: {Paris }": "Paris", "**Answer**: C, since": "C", "The Answer is C": "C", " no mark  here ": "no mark here", "": ""}
    assert {k: one(T.locate_answer(F.lit(k))) for k in located} == located
    assert one(T.fallback_subqueries(F.lit("Why and how"))) == ["Why Why and how", "How Why and how", "Why", "how", "Why and how"]
    assert one(T.fallback_subqueries(F.lit("what when where"))) == ["What what when where", "When what when where", "Where what when where"]
    assert one(T.clean_subqueries(F.array(*map(F.lit, ("Is it  so, née (x)?", "short", "A long one!", "A long one!", "don't stop"))))) == ["Is it so, n e x?", "A long one?", "dont stop?"]
    assert one(T.match_ratio(F.lit("The cat, the Dog"), F.lit("a catalogue of birds"))) == 0.25
    assert one(T.token_overlap(F.lit("A b  b c."), F.lit("b c A"))) == 2
    legal = F.array(*map(F.lit, range(10)))
    path = lambda *c: one(R.path_reward(F.array(*(F.array(*map(F.lit, x)) for x in c)), legal))
    assert path([1, 1, 12]) == -0.5 and path([1, 2]) == 1.0 and path([1], [1]) == 1.0 and path([11], [12]) == -0.5
    forms = lambda p, g, t: tuple(one(T.parsed_answers(F.lit(p), F.lit(g), t)))
    assert forms("Yes, I know", "no", "binary") == ("1", "0", False) and forms("unsure", "yes", "binary") == ("0", "1", True) and forms("unknown", "yes", "binary") == ("0", "1", False)
    assert forms("about 3 to 12 days", "4", "stay") == ("0", "4", True) and forms("class 7", "7.", "stay") == ("7", "7", False)
    assert forms("", "B", "single") == ("A", "B", True) and forms("The", "a cat", "summary") == ("NA", "cat", True)
    assert one(R.outcome_reward(F.lit("The answer is: {no}"), F.lit("no"))) == 5.0 and one(R.retrieval_reward(*(F.lit(x) for x in ("", "q", "s", "g")))) is None
    assert one(R.answer_rank(F.lit("cats"), F.lit("q"), F.lit("two cats"), F.lit("dogs"))) == 1.0 and one(R.answer_rank(F.lit("yes"), F.lit("cats"), F.lit("dogs"), F.lit("dogs"))) == 0.0


def test_entity_matches_in_blocks(spark, monkeypatch):
    from vitalgrid.operators import matching as M

    monkeypatch.setattr(M, "BLOCK", 2)
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["red cat", "the of", "zebra", "", None])], "item_id long, text string")
    d = spark.createDataFrame([("Red-hot.",), ("a concatenation",), (None,), ("x",)], "d string")
    assert {r["item_id"]: r["matched"] for r in M.entity_matches(d, q, "item_id").collect()} == {0: 2, 1: 0, 2: 0, 3: 0, 4: 0}
    assert M.entity_matches(d, q.limit(0), "item_id").count() == 0


def test_swapped_history(spark):
    from vitalgrid.operators import cohort as C

    df = spark.createDataFrame([(1, [["p"]], ["d"], [["h"]])], "visit_id long, procedures array<array<string>>, drugs array<string>, drugs_hist array<array<string>>")
    row = C.swapped_history(df).first()
    assert (row["procedures"], row["drugs"], row["drugs_hist"]) == ([["h"]], [["p"]], [["h"]])


def test_other_readers_and_writers(spark, tmp_path):
    (tmp_path / "s.csv").write_text('input,target,input_tokens,target_tokens\n"a, b\nc",t,3,1\nonly,,1,\n')
    assert [tuple(r) for r in files.summaries(spark, str(tmp_path / "s.csv")).collect()] == [("a, b\nc", "t", 3, 1)]
    (tmp_path / "q.csv").write_text("question,answer\nx,y\n")
    pairs = files.question_pairs(spark, str(tmp_path / "q.csv"), str(tmp_path / "q.csv"), "question string, answer string")
    assert sorted(map(tuple, pairs.collect())) == [("x", "y", "test"), ("x", "y", "train")]
    (tmp_path / "r.json").write_text('{"q": "one", "i": 1}\n\nbroken\n{"q": "two", "i": 2}\n')
    long = files.long_names(spark, str(tmp_path / "r.json"), "q string, i int", {"q": "query", "i": "pmid"}, "two")
    assert [r.asDict() for r in long.collect()] == [{"query": "two", "pmid": 2}]
    assert files.long_names(spark, str(tmp_path / "r.json"), "q string, i int", {"q": "query"}).count() == 2
    (tmp_path / "nodes.csv").write_text("node_id,node_type,node_name\n1,drug,D\n")
    (tmp_path / "kg.csv").write_text("x_id,x_type,relation,y_id,y_type\n1,drug,treats,2,disease\n")
    nodes, triples = files.graph_tables(spark, str(tmp_path))
    assert (tuple(nodes.first()), tuple(triples.first())) == (("1", "drug", "D"), ("1", "drug", "treats", "2", "disease"))
    files.write_test_rows(spark.createDataFrame([("q", "t")], "query string, groundtruth string"), str(tmp_path / "t"))
    assert files.json_lines(spark, str(tmp_path / "t"), "instruction string, input string, output string").first() == ("", "q", "t")
    files.write_csv(spark.createDataFrame([('a "b", c', 1)], "x string, n int"), str(tmp_path / "w"))
    assert tuple(spark.read.csv(str(tmp_path / "w"), header=True, escape='"').first()) == ('a "b", c', "1")


def test_profile_of_nested_columns(spark):
    df = spark.createDataFrame([(1, [[1.0]], {"k": ["v"]}, (1, [2])), (2, None, None, None), (3, [], None, None)], "a int, b array<array<double>>, c map<string,array<string>>, d struct<x:int,y:array<int>>")
    got = {r["column"]: (r["level"], r["least"], r["most"]) for r in files.schema_profile(df).collect()}
    assert got == {"a": (0, None, None), "b": (2, 0, 1), "c": (2, None, None), "d": (2, None, None)}
    assert {r["least"] for r in files.schema_profile(df.where("a > 3")).collect()} == {None}


def test_training_rows_of_baselines_and_policies(spark):
    rows = spark.createDataFrame([(1, "q1", "t1", "yes", "k", "n", True), (2, "q2", "t2", "no", None, "n", False), (3, "q3", "t3", "no", "k", "n", None)], "id int, query string, groundtruth string, decision string, kg_results string, naive_results string, ok boolean")
    assert sorted(map(tuple, R.gated_rows(rows, "id", F.col("ok")).collect())) == [
        (1, "decision", "decide:\nq1", "yes"), (1, "pure_path", "q1", "t1"), (1, "rag", "answer:\nq1\nk\nn", "t1"),
        (2, "pure_path", "q2", "t2"), (2, "wrong", "q2", "t2"), (3, "pure_path", "q3", "t3"), (3, "wrong", "q3", "t3"),
    ]
    step = ("LLM", "s", "a", "no", [], "h", "f")
    t = spark.createDataFrame([(1, "q", "t", [step, (*step[:5], "last", "f")]), (2, "q", "t", [])], f"id int, query string, groundtruth string, path array<{R.STEP}>")
    assert sorted(map(tuple, R.policy_rows(t, "id", F.lit("own")).collect())) == [(1, "no_gold_path", "q", "own"), (1, "terminal", "q\nlast", "own"), (2, "no_gold_path", "q", "own")]
    p = spark.createDataFrame([(" ".join("abcdefghij"),), (" ".join("abcdefghijk"),), ("  ",), (None,)], "a string").select(R.length_penalty(F.col("a"))).collect()
    assert [r[0] for r in p] == [0.0, -0.5, 0.0, 0.0]


def test_small_groups_stay_whole(spark):
    rows = spark.createDataFrame([("big", i) for i in range(10)] + [("small", i) for i in range(4)] + [(None, 1)], "g string, k int")
    got = {r["g"]: r["n"] for r in G.sample_if_many(rows, "g", "k", 5, 3, 1).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got == {"big": 3, "small": 4, None: 1}
    assert [tuple(r) for r in G.smallest_groups(rows, "g", 2).collect()] == [(None, 1), ("small", 4)]
