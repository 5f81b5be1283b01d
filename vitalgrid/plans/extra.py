"""Scans, lookups, set operations and the remaining sequence and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import groups as G
from ..operators import metrics as M
from ..operators import overlap as O
from ..session import small_batches
from ..sources.tables import table
from ..sources.visits import map_codes, visits_from_codes
from .common import joined, query
from .metrics import _E, _classes
from .text import _WORDS, _pairs


@query("""WITH m AS (SELECT p_name AS code, min(p_brand) AS target FROM part GROUP BY 1), c AS (SELECT DISTINCT l_orderkey AS visit_id, target[1:7] AS code FROM lineitem JOIN part ON l_partkey = p_partkey JOIN m ON m.code = p_name)
SELECT o_orderkey AS visit_id, coalesce(string_agg(code, '|' ORDER BY code), '') AS drugs FROM orders LEFT JOIN c ON visit_id = o_orderkey GROUP BY o_orderkey""")
def mapped_code_scan(spark, sf_dir):
    """A long code table mapped to another coding, cut to a level, as arrays by visit."""
    parts, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    mapping = parts.groupBy(F.col("p_name").alias("code")).agg(F.min("p_brand").alias("target"))
    codes = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("visit_id"), F.lit("drugs").alias("role"), F.col("p_name").alias("code"))
    visits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("visit_id"))
    return visits_from_codes(visits, map_codes(codes, mapping, 7)).select("visit_id", joined("drugs").alias("drugs"))


@query("""WITH u AS (SELECT replace(p_brand, '#', '') AS code, p_type AS name, 1 AS pri, p_partkey AS k FROM part WHERE p_size < 10 UNION ALL SELECT replace(p_brand, '#', ''), p_name, 2, p_partkey FROM part WHERE p_size > 40)
SELECT code, name FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY pri DESC, k DESC) AS r FROM u) WHERE r = 1""")
def merged_name_map(spark, sf_dir):
    """Two name maps by code, the second and the later entry win."""
    p = table(spark, sf_dir, "part")
    code = F.replace("p_brand", F.lit("#"), F.lit(""))
    both = p.where("p_size < 10").select(code.alias("code"), F.col("p_type").alias("name"), F.lit(1).alias("pri"), "p_partkey").unionByName(p.where("p_size > 40").select(code.alias("code"), F.col("p_name").alias("name"), F.lit(2).alias("pri"), "p_partkey"))
    return both.groupBy("code").agg(F.max_by("name", F.struct("pri", "p_partkey")).alias("name"))


@query("""WITH n AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: TRY_CAST(x AS BIGINT)) AS c FROM documents), d AS (SELECT doc_id, c, list_distinct(list_filter(c, lambda x: x IS NOT NULL)) AS k FROM n)
SELECT doc_id, len(list_filter(k, lambda x: x < 10)) AS legal, len(list_filter(k, lambda x: x >= 10)) AS illegal, len(list_filter(c, lambda x: x IS NOT NULL)) - len(k) AS repeated FROM d""")
def choice_set_counts(spark, sf_dir):
    """Chosen ids against the legal ones 0 to 9: in common, beyond, repeated."""
    c = F.filter(T.numbers("text"), lambda x: x.isNotNull())
    legal = F.array(*(F.lit(i).cast("long") for i in range(10)))
    d = table(spark, sf_dir, "documents").select("doc_id", c.alias("c"))
    return d.select("doc_id", F.size(F.array_intersect("c", legal)).cast("long").alias("legal"), F.size(F.array_except("c", legal)).cast("long").alias("illegal"), (F.size("c") - F.size(F.array_distinct("c"))).cast("long").alias("repeated"))


@query("""WITH s AS (SELECT conv_id, CAST(turn % 5 AS INT) AS pred, lead(CASE WHEN role = 'system' THEN -100 ELSE length(text) % 5 END) OVER (PARTITION BY conv_id ORDER BY turn) AS label FROM conversations),
r AS (SELECT conv_id, avg(CAST(label = pred AS INT)) AS a FROM s WHERE label <> -100 GROUP BY conv_id) SELECT round(avg(a), 9) AS accuracy, count(*) AS n FROM r""")
def masked_token_accuracy(spark, sf_dir):
    """Accuracy of each position's prediction of the next position's label, over unmasked ones by row, then the mean of rows that have any."""
    c = table(spark, sf_dir, "conversations")
    label = F.when(F.col("role") == "system", -100).otherwise(F.length("text") % 5)
    s = c.select("conv_id", (F.col("turn") % 5).alias("pred"), F.lead(label).over(Window.partitionBy("conv_id").orderBy("turn")).alias("label")).where("label <> -100")
    return s.groupBy("conv_id").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("a")).agg(F.round(F.avg("a"), 9).alias("accuracy"), F.count("*").alias("n"))


@query("SELECT user_id, round(sum(CASE WHEN event_type <> 'error' THEN value ELSE 0 END), 6) AS log_prob, count(*) FILTER (event_type <> 'error') AS valid FROM events GROUP BY 1")
def masked_log_prob(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ok = F.col("event_type") != "error"
    return e.groupBy("user_id").agg(F.round(F.sum(F.when(ok, F.col("value")).otherwise(0)), 6).alias("log_prob"), F.count_if(ok).alias("valid"))


@query("SELECT c.conv_id, t.turn, round(c.n / 10, 9) AS reward FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) c JOIN conversations t USING (conv_id)")
def repeated_rewards(spark, sf_dir):
    """A conversation's reward on each of its turns."""
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.collect_list("turn").alias("turns"))
    return g.select("conv_id", F.explode("turns").alias("turn"), F.round(F.col("n") / 10, 9).alias("reward"))


@query("""WITH b AS (SELECT doc_id, doc_id // 10 AS batch, doc_id % 10 AS i, count(*) OVER (PARTITION BY doc_id // 10) AS n FROM documents) SELECT batch, k AS position, doc_id FROM b, range(0, 16) r(k) WHERE k % n = i""")
def padded_batches(spark, sf_dir):
    """Batches brought to exactly 16 rows by starting again at their head."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 10).alias("batch"), (F.col("doc_id") % 10).alias("i"))
    d = d.withColumn("n", F.count("*").over(Window.partitionBy("batch"))).where("i < 16")
    return d.select("batch", F.explode(F.sequence(F.col("i"), F.lit(15).cast("long"), F.col("n"))).alias("position"), "doc_id")


@query(f"{_E}, k AS (SELECT *, list_sum(list_transform(scores, lambda s: exp(CAST(s AS DOUBLE)))) AS z FROM e) SELECT round(avg(pow(CAST(y = predicted AS INT) - exp(CAST(list_max(scores) AS DOUBLE)) / z, 2)), 9) AS brier_top1 FROM k")
def brier_top1(spark, sf_dir):
    """Squared gap of the top probability to whether it is right."""
    z = F.aggregate(F.transform("scores", lambda s: F.exp(s.cast("double"))), F.lit(0.0), lambda a, b: a + b)
    p = F.exp(F.array_max("scores").cast("double")) / z
    return _classes(spark, sf_dir).agg(F.round(F.avg(F.pow((F.col("y") == F.col("predicted")).cast("double") - p, F.lit(2.0))), 9).alias("brier_top1"))


@query(f"""{_E}, o AS (SELECT vec_id, y, i AS k, scores[i + 1] AS s FROM e, range(0, 10) r(i) WHERE y < 10), a AS (SELECT x.k AS k, x.y AS neg, avg(CASE WHEN p.s > x.s THEN 1.0 WHEN p.s = x.s THEN 0.5 ELSE 0.0 END) AS v FROM o p JOIN o x ON x.k = p.k AND p.y = p.k AND x.y <> x.k GROUP BY ALL), c AS (SELECT y, count(*) AS n FROM e WHERE y < 10 GROUP BY y)
SELECT round(avg(v), 9) AS macro_ovo, round(sum(v * (s.n + t.n)) / sum(s.n + t.n), 9) AS weighted_ovo FROM a JOIN c s ON s.y = a.k JOIN c t ON t.y = a.neg""")
def multiclass_auc_ovo(spark, sf_dir):
    """AUC of every ordered pair of the ten classes that have a score, plain and weighted by the rows of both; vectors of other labels are in no pair."""
    cells = _classes(spark, sf_dir).where("y < 10").select("y", F.posexplode("scores").alias("k", "s"))
    own = cells.where("y = k").select("k", "s", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("neg"), F.lit(1).alias("t")).where("neg <> k")
    other = cells.where("y <> k").select("k", "s", F.col("y").alias("neg"), F.lit(0).alias("t"))
    sizes = lambda k, n: F.broadcast(cells.where("k = 0").groupBy(F.col("y").cast("int").alias(k)).agg(F.count("*").alias(n)))  # noqa: E731  a row a class
    pairs = M.roc_auc(own.unionByName(other), "t", "s", ("k", "neg")).where("roc_auc is not null").join(sizes("k", "n_k"), "k").join(sizes("neg", "n_neg"), "neg")
    n = F.col("n_k") + F.col("n_neg")
    return pairs.agg(F.round(F.avg("roc_auc"), 9).alias("macro_ovo"), F.round(F.sum(F.col("roc_auc") * n) / F.sum(n), 9).alias("weighted_ovo"))


@query("SELECT CASE WHEN regexp_extract(d.text, '(A|B|C|D)', 1) <> '' THEN regexp_extract(d.text, '(A|B|C|D)', 1) END AS choice, count(*) AS n, round(avg(CAST(toxic = 1 AS INT)), 9) AS share FROM documents d JOIN labels USING (doc_id) GROUP BY 1")
def choice_accuracy(spark, sf_dir):
    """Rows by normalised choice, with the share of hits; rows without a choice apart."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy(F.nullif(F.regexp_extract("text", "(A|B|C|D)", 1), F.lit("")).alias("choice")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("toxic") == 1).cast("double")), 9).alias("share"))


@query(f"""WITH w AS (SELECT doc_id, {_WORDS('text')} AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS k FROM w), c AS (SELECT k, count(*) AS n, count(DISTINCT doc_id) AS docs FROM u GROUP BY k) SELECT k AS word, n, docs FROM c WHERE docs >= 20""")
def corpus_words(spark, sf_dir):
    """Occurrences and documents of words that 20 documents have."""
    u = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.words("text")).alias("word"))
    return u.groupBy("doc_id", "word").count().groupBy("word").agg(F.sum("count").alias("n"), F.count("*").alias("docs")).where("docs >= 20")


_CHOICE = lambda x: f"coalesce(nullif(regexp_extract({x}, '(A|B|C|D)', 1), ''), trim({x}))"


@query(f"""WITH r AS (SELECT conv_id, {_CHOICE('arg_min(text, turn)')} AS p, {_CHOICE('arg_max(text, turn)')} AS y FROM conversations GROUP BY conv_id), f AS (SELECT * FROM r WHERE p IN ('A', 'B', 'C', 'D') AND y IN ('A', 'B', 'C', 'D')),
k AS (SELECT c, (SELECT count(*) FROM f WHERE p = c AND y = c) AS tp, (SELECT count(*) FROM f WHERE p = c) AS np, (SELECT count(*) FROM f WHERE y = c) AS nt FROM (SELECT unnest(['A', 'B', 'C', 'D']) AS c))
SELECT round((SELECT avg(CAST(p = y AS INT)) FROM r), 9) AS em, round(sum(coalesce(2 * tp / nullif(np + nt, 0), 0) * nt) / nullif(sum(nt), 0), 9) AS f1_weighted, CAST(sum(nt) AS BIGINT) AS n_choices FROM k""")
def choice_scores(spark, sf_dir):
    """Exact match of two answers over all rows, and F1 weighted by class over those where both are a capital from A to D."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(T.multiple_choice(F.min_by("text", "turn")).alias("predicted"), T.multiple_choice(F.max_by("text", "turn")).alias("y"))
    em = c.agg(F.round(F.avg((F.col("predicted") == F.col("y")).cast("double")), 9).alias("em"))
    both = c.where(F.col("predicted").isin(*"ABCD") & F.col("y").isin(*"ABCD"))
    f1 = M.multiclass_metrics(both).agg(F.round(F.max("f1_weighted"), 9).alias("f1_weighted"), F.coalesce(F.max("n"), F.lit(0)).alias("n_choices"))
    return em.join(f1)  # one row each


_SPLIT = lambda x: f"list_filter(string_split(trim(regexp_replace({x}, '[ \\t\\n\\r\\f]+', ' ', 'g')), ' '), lambda w: w <> '')"


@query(f"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'yes' ELSE split_part(text, chr(10), 1) END AS a, CASE WHEN doc_id % 5 = 0 THEN 'yes' ELSE coalesce(nullif(substr(text, strpos(text, chr(10)) + 1), ''), text) END AS c FROM documents), g AS (SELECT *, {_SPLIT('a')} AS x, {_SPLIT('c')} AS y FROM p),
u AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, unnest(x) AS k FROM g) GROUP BY ALL), v AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, unnest(y) AS k FROM g) GROUP BY ALL), s AS (SELECT doc_id, sum(least(u.n, v.n)) AS s FROM u JOIN v USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN a <> c AND (a IN ('yes', 'no', 'noanswer') OR c IN ('yes', 'no', 'noanswer')) THEN 0 WHEN len(x) + len(y) > 0 THEN 2 * coalesce(s, 0) / (len(x) + len(y)) ELSE 0 END, 9) AS f1 FROM g LEFT JOIN s USING (doc_id)""")
def answer_f1_scores(spark, sf_dir):
    """Word F1 of answers, 0 where they differ and one is a fixed answer; every third prediction and fifth truth is yes."""
    p = _pairs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 == 0, "yes").otherwise(F.col("a")).alias("p"), F.when(F.col("doc_id") % 5 == 0, "yes").otherwise(F.col("c")).alias("g"))
    return T.answer_f1(p, "doc_id", "p", "g").select("doc_id", F.round("f1", 9).alias("f1"))


@query()
def generation_scores(spark, sf_dir):
    """BLEU-4 by characters of the first line against the second, SARI of the first line as a short form of the text, and the text's reading grade; all of whole strings."""
    p = _pairs(spark, sf_dir).select("doc_id", F.col("a").alias("ca"), F.col("c").alias("cc"), T.words("a").alias("a"), T.words("c").alias("c"), T.words("b").alias("b"), F.col("b").alias("text"))
    return small_batches(p).select("doc_id", F.round(O.character_bleu("ca", "cc"), 9).alias("bleu4"), F.round(O.sari("b", "a", "c"), 9).alias("sari"), F.round(T.reading_grade("text"), 9).alias("grade"))


@query(f"""SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(doc_id || '-4'), 1, 8) AS BIGINT) < {int(0.1 * 2**32)} THEN 'val' ELSE 'train' END AS split FROM documents""")
def fractional_val_split(spark, sf_dir):
    """A tenth of the rows for validation, each row by its own hash."""
    return table(spark, sf_dir, "documents").select("doc_id", F.when(G.bernoulli("doc_id", 4, 0.1), "val").otherwise("train").alias("split"))
