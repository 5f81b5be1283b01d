"""Queries for overlap of texts: stemmed ROUGE, corpus BLEU, F1 with precision and recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stems as P
from ..functions import text as T
from ..operators import overlap as O
from ..sources.tables import table
from .common import query
from .text import _PAIR, _WORDS, _pairs


def _case(rules: tuple, otherwise: str = "w") -> str:
    """SQL of a step: the first rule whose suffix the word has decides."""
    out = []
    for suffix, put, condition in rules:
        left = f"left(w, length(w) - {len(suffix)})"
        tested = f"{left} || '{put}'" if suffix in ("sion", "tion") else left
        new = f"{left} || '{put}'"
        out.append(f"WHEN suffix(w, '{suffix}') THEN " + (f"CASE WHEN regexp_matches({tested}, '{condition}') THEN {new} ELSE w END" if condition else new))
    return f"CASE {' '.join(out)} ELSE {otherwise} END"


_CUT = lambda n: f"left(w, length(w) - {n})"
_IS = lambda n, c: f"regexp_matches({_CUT(n)}, '{c}')"
_STEMS = [
    f"CASE WHEN regexp_full_match(w, '.ies') THEN left(w, 3) ELSE {_case(P.PLURALS)} END",
    f"CASE WHEN suffix(w, 'ied') THEN CASE WHEN length(w) = 4 THEN {_CUT(1)} ELSE {_CUT(2)} END WHEN suffix(w, 'eed') THEN CASE WHEN {_IS(3, P.MORE_THAN_0)} THEN {_CUT(1)} ELSE w END WHEN suffix(w, 'ed') AND {_IS(2, P.VOWEL)} THEN {_CUT(2)} || '*' WHEN suffix(w, 'ing') AND {_IS(3, P.VOWEL)} THEN {_CUT(3)} || '*' ELSE w END",
    f"""CASE WHEN NOT suffix(w, '*') THEN w WHEN suffix(w, 'at*') OR suffix(w, 'bl*') OR suffix(w, 'iz*') THEN {_CUT(1)} || 'e'
     WHEN regexp_matches(w, '([^aeiouylsz*]|[aeiou]y)[*]$') AND w[-2] = w[-3] OR regexp_matches(w, '[aeiou]yy[*]$') THEN {_CUT(2)} WHEN regexp_matches(w, '(ll|ss|zz)[*]$') THEN {_CUT(1)} WHEN {_IS(1, P.IS_1)} AND {_IS(1, P.SHORT)} THEN {_CUT(1)} || 'e' ELSE {_CUT(1)} END""",
    f"CASE WHEN regexp_matches(w, '^.+([^aeiouy]|[aeiou]y)y$') THEN {_CUT(1)} || 'i' ELSE w END",
    f"CASE WHEN suffix(w, 'alli') AND {_IS(4, P.MORE_THAN_0)} THEN {_CUT(2)} ELSE w END",
    _case(P.DOUBLE, f"CASE WHEN suffix(w, 'logi') AND {_IS(3, P.MORE_THAN_0)} THEN {_CUT(1)} ELSE w END"),
    _case(P.SINGLE),
    _case(P.LAST),
    f"CASE WHEN suffix(w, 'e') AND ({_IS(1, P.MORE_THAN_1)} OR ({_IS(1, P.IS_1)} AND NOT {_IS(1, P.SHORT)})) THEN {_CUT(1)} ELSE w END",
    f"CASE WHEN suffix(w, 'll') AND {_IS(1, P.MORE_THAN_1)} THEN {_CUT(1)} ELSE w END",
]
_OWN = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in P.IRREGULAR.items())
_TOKENS = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
#: Stems by word for all words of the texts in ``p`` (columns a and c).
_STEMMED = f"""k0 AS (SELECT DISTINCT unnest({_TOKENS('a')}) AS k FROM p UNION SELECT DISTINCT unnest({_TOKENS('c')}) FROM p), k AS (SELECT k, k AS w FROM k0 WHERE length(k) > 3 AND k NOT IN ({', '.join(f"'{w}'" for w in P.IRREGULAR)})),
{', '.join(f'st{i} AS (SELECT k, {step} AS w FROM {f"st{i - 1}" if i else "k"})' for i, step in enumerate(_STEMS))},
stem AS (SELECT k, w FROM st{len(_STEMS) - 1} UNION ALL SELECT k, CASE k {_OWN} ELSE k END FROM k0 WHERE k NOT IN (SELECT k FROM k))"""


def _rouge_sql() -> str:
    side = lambda c: f"(SELECT doc_id, i, w FROM (SELECT doc_id, unnest({_TOKENS(c)}) AS k, generate_subscripts({_TOKENS(c)}, 1) AS i FROM p) JOIN stem USING (k))"
    bag = lambda t: f"SELECT doc_id, {t} AS g, count(*) AS n FROM"
    return f"""{_PAIR}, {_STEMMED}, x AS {side('a')}, y AS {side('c')},
x1 AS ({bag('w')} x GROUP BY ALL), y1 AS ({bag('w')} y GROUP BY ALL), x2 AS ({bag("s.w || ' ' || t.w")} x s JOIN x t USING (doc_id) WHERE t.i = s.i + 1 GROUP BY ALL), y2 AS ({bag("s.w || ' ' || t.w")} y s JOIN y t USING (doc_id) WHERE t.i = s.i + 1 GROUP BY ALL),
c1 AS (SELECT doc_id, sum(least(x1.n, y1.n)) AS c FROM x1 JOIN y1 USING (doc_id, g) GROUP BY 1), c2 AS (SELECT doc_id, sum(least(x2.n, y2.n)) AS c FROM x2 JOIN y2 USING (doc_id, g) GROUP BY 1)
SELECT doc_id, round(coalesce(2 * c1.c / (len({_TOKENS('a')}) + len({_TOKENS('p.c')})), 0), 9)::DOUBLE AS rouge1, round(coalesce(2 * c2.c / (len({_TOKENS('a')}) + len({_TOKENS('p.c')}) - 2), 0), 9)::DOUBLE AS rouge2 FROM p LEFT JOIN c1 USING (doc_id) LEFT JOIN c2 USING (doc_id)"""


@query(_rouge_sql())
def stemmed_rouge_scores(spark, sf_dir):
    """ROUGE-1 and ROUGE-2 of stemmed words: the first line of a text against what follows it."""
    p = _pairs(spark, sf_dir).select("doc_id", P.summary_words("a").alias("a"), P.summary_words("c").alias("c"))
    return O.rouge_runs(p, "doc_id", "a", "c").select("doc_id", *(F.round(c, 9).alias(c) for c in ("rouge1", "rouge2")))


@query()
def rouge_lsum_scores(spark, sf_dir):
    """All three ROUGE scores of the first line against what follows it, sentence by sentence."""
    r = O.rouge(_pairs(spark, sf_dir), "doc_id", "a", "c")
    return r.select("doc_id", *(F.round(c, 9).alias(c) for c in ("rouge1", "rouge2", "rougeLsum")))


def _grams(n: int) -> str:
    gram = lambda c: f"list_transform(generate_series(1, len({c}) - {n - 1}), lambda i: array_to_string({c}[i:i + {n - 1}], ' '))"
    side = lambda c: f"(SELECT source, doc_id, g, count(*) AS n FROM (SELECT source, doc_id, unnest({gram(c)}) AS g FROM w) GROUP BY ALL)"
    return f"g{n} AS (SELECT u.source, sum(least(u.n, coalesce(v.n, 0))) AS c{n}, sum(u.n) AS t{n} FROM {side('x')} u LEFT JOIN {side('y')} v USING (source, doc_id, g) GROUP BY u.source)"


@query(f"""{_PAIR}, w AS (SELECT source, doc_id, {_WORDS('a')} AS x, {_WORDS('c')} AS y FROM p JOIN documents USING (doc_id)), {', '.join(map(_grams, range(1, 5)))},
l AS (SELECT source, count(*) AS n, sum(len(x)) AS sys, sum(len(y)) AS ref FROM w GROUP BY source), j AS (SELECT l.*, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2, coalesce(c3, 0) AS c3, coalesce(c4, 0) AS c4, coalesce(t1, 0) AS t1, coalesce(t2, 0) AS t2, coalesce(t3, 0) AS t3, coalesce(t4, 0) AS t4 FROM l LEFT JOIN g1 USING (source) LEFT JOIN g2 USING (source) LEFT JOIN g3 USING (source) LEFT JOIN g4 USING (source)),
m AS (SELECT *, (c1 = 0)::INT AS z1, (c1 = 0)::INT + (c2 = 0)::INT AS z2, (c1 = 0)::INT + (c2 = 0)::INT + (c3 = 0)::INT AS z3, (c1 = 0)::INT + (c2 = 0)::INT + (c3 = 0)::INT + (c4 = 0)::INT AS z4 FROM j),
q AS (SELECT *, {', '.join(f"CASE WHEN t{n} = 0 THEN 0 WHEN c{n} > 0 THEN c{n} / t{n} ELSE 1 / (2.0::DOUBLE ** z{n} * t{n}) END AS p{n}" for n in range(1, 5))}, CASE WHEN sys = 0 THEN 0 WHEN sys >= ref THEN 1 ELSE exp(1 - ref / sys) END AS brevity FROM m)
SELECT source, round(CASE WHEN c1 > 0 AND p4 > 0 THEN 100 * brevity * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) ELSE 0 END, 9)::DOUBLE AS bleu, round(brevity, 9)::DOUBLE AS brevity, n FROM q""")
def corpus_bleu_scores(spark, sf_dir):
    """BLEU by source over all its texts: what follows the first line is the reference of the first line."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    p = _pairs(spark, sf_dir).join(d, "doc_id").select("source", T.words("a").alias("a"), T.words("c").alias("c"))
    return O.corpus_bleu(p, "a", "c", ("source",)).select("source", F.round("bleu", 9).alias("bleu"), F.round("brevity", 9).alias("brevity"), "n")


@query(f"""{_PAIR}, w AS (SELECT doc_id, {_WORDS('a')} AS x, {_WORDS('c')} AS y FROM p), u AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, unnest(x) AS k FROM w) GROUP BY ALL), v AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, unnest(y) AS k FROM w) GROUP BY ALL), s AS (SELECT doc_id, sum(least(u.n, v.n)) AS s FROM u JOIN v USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, round(coalesce(2 * s / (len(x) + len(y)), 0), 9)::DOUBLE AS f1, round(coalesce(s / len(x), 0), 9)::DOUBLE AS precision, round(coalesce(s / len(y), 0), 9)::DOUBLE AS recall FROM w LEFT JOIN s USING (doc_id)""")
def word_overlap_scores(spark, sf_dir):
    """F1, precision and recall of words of the first line against what follows it."""
    p = _pairs(spark, sf_dir).select("doc_id", T.words("a").alias("a"), T.words("c").alias("c"))
    return O.run_scores(p, "doc_id", "a", "c").select("doc_id", *(F.round(c, 9).alias(c) for c in ("f1", "precision", "recall")))
