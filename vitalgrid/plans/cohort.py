"""Cohort and label queries over orders as visits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import cohort as C
from ..sources.tables import table
from ..sources.visits import VISITS_SQL, order_visits
from .common import joined, nested, query

_FULL = "len(conditions) > 0 AND len(procedures) > 0 AND len(drugs) > 0"
_NEXT = f"""WITH {VISITS_SQL},
n AS (SELECT *, lead(encounter_time) OVER p AS next_time, lead(discharge_status) OVER p AS next_status, lead(drugs) OVER p AS next_drugs, lead(conditions) OVER p AS next_conditions FROM visits WINDOW p AS (PARTITION BY patient_id ORDER BY encounter_time, visit_id))"""
_DAYS = "(epoch_us({a}) - epoch_us({b})) // 86400000000"


def _least(rows: str, k: int) -> str:
    return f"s AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY patient_id) AS n_samples FROM {rows}) WHERE n_samples >= {k})"


_HIST = "array_to_string(list_transform(list({c}) OVER w, lambda x: array_to_string(x, '|')), ';')"
_W = "WINDOW w AS (PARTITION BY patient_id ORDER BY encounter_time, visit_id ROWS UNBOUNDED PRECEDING)"


@query(f"""{_NEXT}, f AS (SELECT * FROM n WHERE {_FULL} AND next_time IS NOT NULL), {_least('f', 2)}
SELECT patient_id, visit_id, {_HIST.format(c='conditions')} AS conditions_hist, {_HIST.format(c='procedures')} AS procedures_hist, len(list(visit_id) OVER w) AS n_hist,
  CAST({_DAYS.format(a='next_time', b='encounter_time')} < 15 AS INT) AS label FROM s {_W}""")
def rea_samples(spark, sf_dir):
    """Readmission within 15 days, with cumulative history."""
    s = C.build_samples(order_visits(spark, sf_dir), "readmission", least=2, history=("conditions", "procedures"))
    return s.select("patient_id", "visit_id", nested("conditions_hist").alias("conditions_hist"), nested("procedures_hist").alias("procedures_hist"), F.size("visit_id_hist").cast("long").alias("n_hist"), "label")


@query(f"""WITH {VISITS_SQL}, f AS (SELECT *, ({_DAYS.format(a='discharge_time', b='encounter_time')}) % 20 AS d0 FROM visits WHERE {_FULL}),
g AS (SELECT *, CASE WHEN d0 < 0 THEN d0 + 20 ELSE d0 END AS d FROM f), {_least('g', 2)}
SELECT patient_id, visit_id, CAST(CASE WHEN d < 1 THEN 0 WHEN d <= 7 THEN d WHEN d <= 14 THEN 8 ELSE 9 END AS INT) AS label, CASE WHEN d < 1 THEN '0days' WHEN d <= 7 THEN d || 'days' WHEN d <= 14 THEN '8days' ELSE '9days' END AS said FROM s""")
def los_samples(spark, sf_dir):
    """Length of stay in ten classes; the stand-in's gaps are taken modulo 20 days."""
    days = F.pmod(C.elapsed_days("discharge_time", "encounter_time"), F.lit(20))
    s = C.build_samples(order_visits(spark, sf_dir), "stay", least=2, history=(), label=C.los_class(days))
    return s.select("patient_id", "visit_id", "label", F.concat(F.col("label").cast("string"), F.lit("days")).alias("said"))


@query(f"""{_NEXT}, f AS (SELECT * FROM n WHERE {_FULL} AND next_time IS NOT NULL), {_least('f', 2)}
SELECT patient_id, visit_id, CASE WHEN next_status = 'F' THEN 1 ELSE 0 END AS label, CASE WHEN next_status = 'F' THEN 'yes' ELSE 'no' END AS said FROM s""")
def ihm_samples(spark, sf_dir):
    """Next-visit mortality; order status F stands for a death in hospital."""
    v = order_visits(spark, sf_dir).withColumn("discharge_status", F.when(F.col("discharge_status") == "F", "1").when(F.col("discharge_status") == "O", "0").otherwise("2"))
    s = C.build_samples(v, "next_mortality", least=2, history=())
    return s.select("patient_id", "visit_id", "label", F.when(F.col("label") == 1, "yes").otherwise("no").alias("said"))


@query(f"""WITH {VISITS_SQL}, e AS (SELECT user_id, min(ts) AS death FROM events WHERE event_type = 'error' GROUP BY user_id), f AS (SELECT v.*, death FROM visits v LEFT JOIN e ON user_id = patient_id WHERE {_FULL}), {_least('f', 2)}
SELECT patient_id, visit_id, CAST(coalesce(epoch_us(death) - epoch_us(encounter_time) < 86400000000, FALSE) AS INT) AS label FROM s""")
def mor24_samples(spark, sf_dir):
    """Death within a day of the encounter; a patient's first error event stands for the death."""
    deaths = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("patient_id")).agg(F.min("ts").alias("death_time"))
    v = order_visits(spark, sf_dir).join(deaths, "patient_id", "left")
    return C.build_samples(v, "mortality", least=2, history=()).select("patient_id", "visit_id", "label")


@query(f"""WITH {VISITS_SQL}, f AS (SELECT * FROM visits WHERE {_FULL}), {_least('f', 1)}
SELECT patient_id, visit_id, array_to_string(list_transform(drugs, lambda x: x[1:4]), '|') AS labels,
  array_to_string(list_concat(['<pad>|<pad>|<pad>'], coalesce(list_transform(list(drugs) OVER (PARTITION BY patient_id ORDER BY encounter_time, visit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lambda x: array_to_string(list_transform(x, lambda y: y[1:4]), '|')), [])), ';') AS drugs_hist FROM s""")
def rec_history(spark, sf_dir):
    """Current drugs as the label, with a shifted history that hides them; codes cut to four characters."""
    s = C.task_samples(order_visits(spark, sf_dir), "MIV", "REC")
    return s.select("patient_id", "visit_id", joined("label").alias("labels"), nested("drugs_hist").alias("drugs_hist"))


@query(f"""{_NEXT}, f AS (SELECT * FROM n WHERE {_FULL} AND next_time IS NOT NULL), u AS (SELECT visit_id, patient_id, unnest(next_conditions) AS code FROM f)
SELECT visit_id, string_agg(DISTINCT grp, '|' ORDER BY grp) AS labels FROM (SELECT visit_id, 'G' || CAST(ascii(code[7:7]) % 3 AS VARCHAR) AS grp FROM u) GROUP BY visit_id""")
def phe_labels(spark, sf_dir):
    """Groups of the next visit's conditions by a lookup table of codes."""
    codes = table(spark, sf_dir, "part").select(F.col("p_brand").alias("code")).distinct()
    groups = codes.withColumn("grp", F.concat(F.lit("G"), (F.ascii(F.substring("code", 7, 1)) % 3).cast("string")))
    return C.task_samples(order_visits(spark, sf_dir), "MIII", "PHE", groups=groups).select("visit_id", joined("label").alias("labels"))


@query(f"""{_NEXT}, f AS (SELECT * FROM n WHERE {_FULL} AND len(next_conditions) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY encounter_time DESC, visit_id DESC) AS r FROM f), k AS (SELECT * FROM r WHERE r <= 20), {_least('k', 3)}
SELECT patient_id, visit_id, array_to_string(next_conditions, '|') AS labels, len(list(visit_id) OVER w) AS n_hist FROM s {_W}""")
def diag_samples(spark, sf_dir):
    """Next visit's codes as the label; only the last 20 samples of a patient, and patients with three or more."""
    s = C.task_samples(order_visits(spark, sf_dir), "OMOP", "DIAG")
    return s.select("patient_id", "visit_id", joined("label").alias("labels"), F.size("visit_id_hist").cast("long").alias("n_hist"))


@query(f"""WITH {VISITS_SQL}, f AS (SELECT * FROM visits WHERE {_FULL}), h AS (SELECT patient_id, visit_id, list(conditions) OVER w AS hist FROM f {_W})
SELECT patient_id, visit_id, array_to_string(list_transform(hist[greatest(1, len(hist) - 3):], lambda x: array_to_string(x[greatest(1, len(x) - 1):], '|')), ';') AS conditions_tail FROM h""")
def tail_truncation(spark, sf_dir):
    """The last four visits, and of each the last two codes."""
    s = C.with_history(order_visits(spark, sf_dir).where(C.nonempty("conditions", "procedures", "drugs")), "conditions")
    kept = F.transform(C.tail(F.col("conditions_hist"), 4), lambda x: C.tail(x, 2))
    return s.select("patient_id", "visit_id", nested(kept).alias("conditions_tail"))


@query(f"""WITH {VISITS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY CAST(visit_id AS DOUBLE) DESC, encounter_time) AS r FROM visits)
SELECT patient_id, visit_id, array_to_string(conditions, '|') AS conditions FROM r WHERE r = 1""")
def last_visit(spark, sf_dir):
    """The visit with the largest number of each patient; the earliest wins a tie."""
    w = Window.partitionBy("patient_id").orderBy(F.desc(F.col("visit_id").cast("double")), "encounter_time")
    v = order_visits(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r = 1")
    return v.select("patient_id", "visit_id", joined("conditions").alias("conditions"))


@query(f"""WITH {VISITS_SQL}, c AS (SELECT visit_id, unnest(conditions) AS code, generate_subscripts(conditions, 1) AS pos FROM visits)
SELECT visit_id, string_agg(coalesce(name, 'Unknown'), '|' ORDER BY pos) AS names FROM c LEFT JOIN (SELECT DISTINCT p_brand AS code, replace(p_brand, '#', ' ') AS name FROM part WHERE p_size > 45) USING (code) GROUP BY visit_id""")
def code_lookup(spark, sf_dir):
    """Code names in order, Unknown where the map has none."""
    names = table(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_brand").alias("code"), F.regexp_replace("p_brand", "#", " ").alias("name")).distinct()
    codes = order_visits(spark, sf_dir).select("visit_id", F.posexplode("conditions").alias("pos", "code")).join(names, "code", "left")
    rows = codes.groupBy("visit_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", F.lit("Unknown")).alias("name")))).alias("x"))
    return rows.select("visit_id", joined(F.transform("x", lambda x: x["name"])).alias("names"))


@query(f"""WITH {VISITS_SQL}, i AS (SELECT visit_id, patient_id, CAST(len(conditions) = 0 AS INT) + CAST(len(drugs) < 3 AS INT) AS missing FROM visits), m AS (SELECT patient_id, sum(missing) AS s FROM i GROUP BY patient_id), x AS (SELECT max(s) AS top FROM m)
SELECT patient_id, s AS n_missing, CASE WHEN s <= CAST(floor(top * 1.0 / 6) AS INT) THEN 'G1' WHEN s <= CAST(floor(top * 1.0 / 3) AS INT) THEN 'G2' WHEN s <= CAST(floor(top * 1.0 / 2) AS INT) THEN 'G3' WHEN s <= CAST(floor(top * 2.0 / 3) AS INT) THEN 'G4' END AS grp FROM m, x""")
def completeness_groups(spark, sf_dir):
    """Patients grouped by how many modalities their visits lack, against the largest such number."""
    v = order_visits(spark, sf_dir).select("patient_id", (F.size("conditions") == 0).cast("int").alias("a"), (F.size("drugs") < 3).cast("int").alias("b"))
    m = v.groupBy("patient_id").agg(F.sum(F.col("a") + F.col("b")).alias("n_missing"))
    top = F.broadcast(m.agg(F.max("n_missing").alias("top")))  # one row
    cut = lambda f: F.floor(F.col("top") * f)
    grp = F.when(F.col("n_missing") <= cut(1 / 6), "G1").when(F.col("n_missing") <= cut(1 / 3), "G2").when(F.col("n_missing") <= cut(1 / 2), "G3").when(F.col("n_missing") <= cut(2 / 3), "G4")
    return m.join(top).select("patient_id", "n_missing", grp.alias("grp"))


@query("""SELECT o_custkey AS patient_id, o_orderkey AS visit_id, CASE WHEN embedding IS NULL THEN 64 ELSE len(embedding) END::INT AS size, round(CASE WHEN embedding IS NULL THEN 0 ELSE CAST(embedding[1] AS DOUBLE) + CAST(embedding[64] AS DOUBLE) END, 6) AS ends FROM orders LEFT JOIN embeddings ON vec_id = o_orderkey""")
def visit_notes(spark, sf_dir):
    """The note vector of each visit, zeros where it has none; vectors are notes of the order with their number."""
    v = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("visit_id"))
    notes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("visit_id"), "embedding").join(v, "visit_id")
    out = C.with_notes(v, notes, ["patient_id", "visit_id"], "embedding", 64)
    return out.select("patient_id", "visit_id", F.size("embedding").alias("size"), F.round(F.col("embedding")[0] + F.col("embedding")[63], 6).alias("ends"))
