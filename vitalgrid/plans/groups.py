"""Rarity groups, splits, sampling, balancing and mixing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups as G
from ..sources.tables import table
from ..sources.visits import VISITS_SQL, order_visits
from .common import query

_LAST = f"""WITH {VISITS_SQL}, lastv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY visit_id DESC) AS r FROM visits) WHERE r = 1),
freq AS (SELECT code, count(*) AS n FROM (SELECT unnest(conditions) AS code FROM lastv) GROUP BY code),
rk AS (SELECT code, n, row_number() OVER (ORDER BY n, code) - 1 AS position, count(*) OVER () AS total FROM freq)"""
_HASH = "md5(CAST({k} AS VARCHAR) || '-{s}')"


def _last(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("patient_id").orderBy(F.desc("visit_id"))
    return order_visits(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


@query(f"{_LAST} SELECT code, n FROM freq")
def disease_freq(spark, sf_dir):
    """Code occurrences over last visits."""
    return G.code_frequency(_last(spark, sf_dir), "conditions")


@query(f"""WITH {VISITS_SQL} SELECT code, count(*) AS n FROM (SELECT unnest(list_concat(conditions, procedures)) AS code FROM visits) GROUP BY code""")
def disease_freq_with_labels(spark, sf_dir):
    """Code occurrences over two roles together."""
    return G.code_frequency(order_visits(spark, sf_dir), "conditions", "procedures")


@query(f"{_LAST} SELECT code, n, position, CASE WHEN position < ceil(total * 0.7) THEN 'tail' ELSE 'head' END AS side FROM rk")
def head_tail_codes(spark, sf_dir):
    """The rarest seven tenths of codes against the rest."""
    return G.head_tail(disease_freq(spark, sf_dir), 0.7).select("code", "n", "position", "side")


@query(f"""{_LAST} SELECT side, count(*) AS n_codes, CAST(sum(n) AS BIGINT) AS n_interactions FROM (SELECT *, CASE WHEN position < ceil(total * 0.7) THEN 'tail' ELSE 'head' END AS side FROM rk) GROUP BY side""")
def head_tail_totals(spark, sf_dir):
    """Codes and interactions on either side."""
    return G.head_tail(disease_freq(spark, sf_dir), 0.7).groupBy("side").agg(F.count("*").alias("n_codes"), F.sum("n").alias("n_interactions"))


_TER = "CASE WHEN position < CAST(floor(0.3333333333333333 * total) AS BIGINT) THEN 0 WHEN position < CAST(floor(0.6666666666666666 * total) AS BIGINT) THEN 1 ELSE 2 END AS grp"


@query(f"{_LAST} SELECT code, n, {_TER} FROM rk")
def rare_groups(spark, sf_dir):
    """Codes in three groups by rarity."""
    return G.terciles(disease_freq(spark, sf_dir)).select("code", "n", "grp")


@query(f"""{_LAST}, g AS (SELECT code, {_TER} FROM rk), u AS (SELECT patient_id, unnest(conditions) AS code FROM lastv) SELECT patient_id, min(grp) AS grp FROM u JOIN g USING (code) GROUP BY patient_id""")
def rare_patient(spark, sf_dir):
    """A patient's group is the rarest one that any code of the last visit is in."""
    return G.first_matching_group(_last(spark, sf_dir), "patient_id", "conditions", G.terciles(disease_freq(spark, sf_dir)))


def _split_sql(key: str, source: str, seed: int, r0: float, r1: float) -> str:
    return f"""SELECT {key}, CASE WHEN p < CAST(floor(n * {r0!r}::DOUBLE) AS BIGINT) THEN 'train' WHEN p < CAST(floor(n * {r0 + r1!r}::DOUBLE) AS BIGINT) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT {key}, row_number() OVER (ORDER BY {_HASH.format(k=key, s=seed)}, {key}) - 1 AS p, count(*) OVER () AS n FROM {source})"""


@query(_split_sql("o_custkey", "(SELECT DISTINCT o_custkey FROM orders)", 42, 0.8, 0.1))
def patient_split(spark, sf_dir):
    """Patients into train, val and test."""
    keys = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    return G.split_keys(keys, "o_custkey", (0.8, 0.1), 42).select("o_custkey", "split")


@query(_split_sql("item_id", "benchmark", 7, 0.7, 0.2))
def qa_row_split(spark, sf_dir):
    """Rows into 0.7, 0.2 and 0.1."""
    return G.split_keys(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", (0.7, 0.2), 7).select("item_id", "split")


@query(_split_sql("doc_id", "documents", 3, 0.5, 0.0))
def summary_row_split(spark, sf_dir):
    """Rows into halves, with an empty val."""
    return G.split_keys(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", (0.5, 0.0), 3).select("doc_id", "split")


@query(f"""WITH s AS ({_split_sql('o_custkey', '(SELECT DISTINCT o_custkey FROM orders)', 42, 0.8, 0.1)}), c AS (SELECT o_custkey, count(*) AS n_rows FROM orders GROUP BY 1)
SELECT o_custkey, n_rows, CASE WHEN n_rows > 1 THEN 'warm' ELSE 'cold' END AS kind FROM s JOIN c USING (o_custkey) WHERE split = 'test'""")
def warm_cold_split(spark, sf_dir):
    """Test patients with more than one row are warm."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_rows"))
    test = patient_split(spark, sf_dir).where("split = 'test'").join(rows, "o_custkey")
    return test.select("o_custkey", "n_rows", F.when(F.col("n_rows") > 1, "warm").otherwise("cold").alias("kind"))


@query(f"""SELECT doc_id, p AS position FROM (SELECT doc_id, row_number() OVER (ORDER BY {_HASH.format(k='doc_id', s=5)}, doc_id) - 1 AS p FROM documents)""")
def full_shuffle(spark, sf_dir):
    """Every row's place in a seeded order."""
    return G.hashed_position(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 5).select("doc_id", "position")


@query(f"""SELECT doc_id, p // 32 AS batch FROM (SELECT doc_id, row_number() OVER (ORDER BY {_HASH.format(k='doc_id', s=5)}, doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) WHERE p < (n // 32) * 32""")
def batches_drop_last(spark, sf_dir):
    """Batches of 32 in seeded order without the incomplete last one."""
    return G.drop_last(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 32, 5).select("doc_id", "batch")


@query(f"""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_HASH.format(k='doc_id', s=9)}, doc_id) AS r FROM documents) WHERE r <= 3""")
def fewshot_support(spark, sf_dir):
    """Three support rows for each subject."""
    return G.per_group_sample(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 3, 9)


@query(f"""SELECT doc_id, CASE WHEN CAST('0x' || substr({_HASH.format(k='doc_id', s=1)}, 1, 8) AS BIGINT) < {int(0.3 * 2**32)} THEN regexp_replace(text, '\\n[^\\n]*', '', '') ELSE text END AS text FROM documents""")
def prompt_dropout(spark, sf_dir):
    """A section of the prompt (here the second line) is left out with chance 0.3."""
    d = table(spark, sf_dir, "documents")
    cut = F.regexp_replace("text", "(?s)\\A([^\\n]*)\\n[^\\n]*", "$1")
    return d.select("doc_id", F.when(G.bernoulli("doc_id", 1, 0.3), cut).otherwise(F.col("text")).alias("text"))


@query(f"""WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1), m AS (SELECT min(n) AS m FROM c)
SELECT doc_id, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY {_HASH.format(k='doc_id', s=0)}, doc_id) AS r FROM labels), m WHERE r <= CASE WHEN toxic = 1 THEN m ELSE 2 * m END""")
def class_balance(spark, sf_dir):
    """All of the rarer class and twice as many of the other."""
    caps = F.when(F.col("toxic") == 1, F.col("n_least")).otherwise(2 * F.col("n_least"))
    return G.balance(table(spark, sf_dir, "labels"), "toxic", "doc_id", caps).select("doc_id", "toxic")


@query(f"""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), m AS (SELECT least(min(n), 100) AS m FROM c)
SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_HASH.format(k='vec_id', s=0)}, vec_id) AS r FROM embeddings), m WHERE r <= m""")
def class_balance_multi(spark, sf_dir):
    """As many rows of every class as the rarest has, 100 at most."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return G.balance(e, "label", "vec_id", F.least("n_least", F.lit(100))).select("vec_id", "label")


@query("SELECT doc_id, toxic, copy FROM labels, generate_series(1, 3) g(copy) WHERE copy <= CASE WHEN toxic = 1 THEN 3 ELSE 1 END")
def oversampled(spark, sf_dir):
    """Toxic rows three times."""
    return G.oversample(table(spark, sf_dir, "labels"), F.when(F.col("toxic") == 1, 3).otherwise(1)).select("doc_id", "toxic", F.col("copy").cast("long").alias("copy"))


_MIX = f"a AS (SELECT doc_id, row_number() OVER (ORDER BY {_HASH.format(k='doc_id', s=0)}, doc_id) - 1 AS p FROM documents WHERE lang = 'fr'), b AS (SELECT doc_id, row_number() OVER (ORDER BY {_HASH.format(k='doc_id', s=0)}, doc_id) - 1 AS p FROM documents WHERE lang = 'es'), n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb)"


def _two(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return [d.where(F.col("lang") == x).select("doc_id") for x in ("fr", "es")]


@query(f"WITH {_MIX} SELECT doc_id, 0 AS part, p AS turn FROM a, n WHERE p < least(na, nb) UNION ALL SELECT doc_id, 1, p FROM b, n WHERE p < least(na, nb)")
def mix_interleave_under(spark, sf_dir):
    """Two sources in turns until the shorter ends."""
    return G.interleave(_two(spark, sf_dir), "doc_id").select("doc_id", "part", "turn")


@query(f"WITH {_MIX} SELECT doc_id, 0 AS part, t AS turn FROM a, n, generate_series(0, 1000000) g(t) WHERE t < greatest(na, nb) AND t % na = p UNION ALL SELECT doc_id, 1, t FROM b, n, generate_series(0, 1000000) g(t) WHERE t < greatest(na, nb) AND t % nb = p")
def mix_interleave_over(spark, sf_dir):
    """Two sources in turns until the longer ends; the shorter starts again."""
    return G.interleave(_two(spark, sf_dir), "doc_id", "over").select("doc_id", "part", "turn")


@query("""WITH k AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY md5(conv_id || '.' || turn || '-0'), conv_id || '.' || turn) AS r FROM conversations), c AS (SELECT (count(*) FILTER (role = 'user') + count(*) FILTER (role = 'system')) // 5 AS cap FROM conversations)
SELECT conv_id, turn, role FROM k, c WHERE role = 'assistant' OR r <= cap""")
def mix_concat_capped(spark, sf_dir):
    """Kinds of rows together, two of them capped by a fraction of their number."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"))
    cap = F.broadcast(t.agg(F.floor(F.count_if(F.col("role").isin("user", "system")) / 5).alias("cap")))  # one row
    r = G.hashed_position(t, "key", 0, "role").join(cap)
    return r.where((F.col("role") == "assistant") | (F.col("position") < F.col("cap"))).select("conv_id", "turn", "role")


_WEIGHTS = [0.5, 0.2, 0.3]


def _weighted_sql(until: str) -> str:
    """Draws of a turn from the hash of turn and seed, numbered by source; the first turn at which the stop rule holds."""
    d = f"d AS (SELECT t, CASE WHEN h < {int(0.5 * 2**32)} THEN 0 WHEN h < {int(0.7 * 2**32)} THEN 1 ELSE 2 END AS part FROM (SELECT t, CAST('0x' || substr(md5(t || '-5'), 1, 8) AS BIGINT) AS h FROM range(0, 20 * (SELECT count(*) FROM documents)) r(t)))"
    p = f"p AS (SELECT doc_id, part, row_number() OVER (PARTITION BY part ORDER BY {_HASH.format(k='doc_id', s=5)}, doc_id) - 1 AS p, count(*) OVER (PARTITION BY part) AS n FROM (SELECT doc_id, CASE lang WHEN 'fr' THEN 0 WHEN 'es' THEN 1 ELSE 2 END AS part FROM documents WHERE lang IN ('fr', 'es', 'de')))"
    return f"""WITH {d}, {p}, k AS (SELECT t, part, row_number() OVER (PARTITION BY part ORDER BY t) - 1 AS k FROM d), e AS (SELECT {until}(t) AS last FROM k JOIN (SELECT DISTINCT part, n FROM p) USING (part) WHERE k = n - 1)
SELECT doc_id, k.part AS part, t AS turn FROM k JOIN p ON p.part = k.part AND p.p = k.k % p.n, e WHERE t <= last"""


def _three(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return [d.where(F.col("lang") == x).select("doc_id") for x in ("fr", "es", "de")]


@query(_weighted_sql("min"))
def mix_by_weight_under(spark, sf_dir):
    """Three sources by chance with given weights, until the first has given all its rows."""
    return G.interleave_by_weight(_three(spark, sf_dir), _WEIGHTS, "doc_id", seed=5).select("doc_id", "part", "turn")


@query(_weighted_sql("max"))
def mix_by_weight_over(spark, sf_dir):
    """The same until all have given all their rows; shorter ones start again."""
    return G.interleave_by_weight(_three(spark, sf_dir), _WEIGHTS, "doc_id", "over", 5).select("doc_id", "part", "turn")
