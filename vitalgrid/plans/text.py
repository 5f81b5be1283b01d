"""Text queries over documents, benchmark items and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import matching as M
from ..sources.tables import table
from .common import query

_PUNCT = T.ASCII_PUNCTUATION.replace("'", "''")
_SQ = lambda x: f"trim(regexp_replace({x}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"
_NOP = lambda x: f"translate({x}, '{_PUNCT}', '')"
_WORDS = lambda x: f"list_filter(string_split({_SQ(_NOP('lower(' + x + ')'))}, ' '), lambda w: w <> '')"
_ARTICLE = "(^|[^\\p{L}\\p{N}_])(?:a|an|the)([^\\p{L}\\p{N}_]|$)"
# RE2 looks at no character beside a match: it is taken along and put back, twice, as the one after a match can begin the next.
_NOART = lambda x: f"regexp_replace(regexp_replace({x}, '{_ARTICLE}', '\\1 \\2', 'g'), '{_ARTICLE}', '\\1 \\2', 'g')"
_NORM = lambda x: _SQ(_NOART(_NOP("lower(" + x + ")")))
_QUOTED = lambda p: p.replace("'", "''")


def _unified(x: str) -> str:
    out = f"translate(regexp_replace({x}, '{T._GONE}', '', 'g'), '{_QUOTED(T._ONE_TO_ONE[0])}', '{_QUOTED(T._ONE_TO_ONE[1])}')"
    for mark, plain in T._SEVERAL:
        out = f"replace({out}, '{mark}', '{_QUOTED(plain)}')"
    return f"regexp_replace(regexp_replace({out}, '[?]{{2,}}', '?', 'g'), '[!]{{2,}}', '!', 'g')"


_SPACED = lambda x: _SQ(_NOART(f"translate({_unified('lower(' + x + ')')}, '{_PUNCT}', '{' ' * len(T.ASCII_PUNCTUATION)}')"))


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: CAST(TRY_CAST(x AS BIGINT) AS VARCHAR)), ',') AS numbers FROM documents")
def numbers_extract(spark, sf_dir):
    """All numbers of a text; those beyond 64 bits are left out."""
    n = F.filter(T.numbers("text"), lambda x: x.isNotNull())
    return _docs(spark, sf_dir).select("doc_id", F.array_join(n.cast("array<string>"), ",").alias("numbers"))


@query(f"SELECT doc_id, {_NORM('text')} AS normal FROM documents")
def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalize_answer("text").alias("normal"))


@query("SELECT doc_id, CASE WHEN regexp_extract(text, '(A|B|C|D)', 1) <> '' THEN regexp_extract(text, '(A|B|C|D)', 1) ELSE trim(text) END AS choice FROM documents")
def multichoice(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.multiple_choice("text").alias("choice"))


@query(f"""WITH s AS (SELECT doc_id, regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(t, '{_QUOTED(p)}') THEN regexp_extract(t, '{_QUOTED(p)}', 1)" for p in T._LOCATE)} WHEN t IS NULL THEN 'NA' ELSE trim(t) END AS answer FROM s""")
def locate_answers(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.locate_answer("text").alias("answer"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'yes') THEN 1 WHEN contains(lower(text), 'no') THEN 0 END AS answer FROM documents")
def binary_answers(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.yes_no("text").alias("answer"))


@query(f"WITH n AS (SELECT doc_id, TRY_CAST(list_last(regexp_extract_all({_NORM('text')}, '[0-9]+')) AS BIGINT) AS x FROM documents) SELECT doc_id, CAST(CASE WHEN x < 10 THEN x ELSE 0 END AS INT) AS class FROM n")
def stay_answers(spark, sf_dir):
    """The last number of the normalised text as a class from 0 to 9, 0 for larger ones."""
    return _docs(spark, sf_dir).select("doc_id", T.last_digit_class("text").alias("class"))


_MESS = "replace(replace(replace(replace(text, ' a ', ' “a” – '), '. ', '… '), 'e', 'e' || chr(173)), 'the ', 'l’the″ ?? !! ')"


def _messy(text):
    """Texts with characters that are written in several ways."""
    out = F.replace(F.replace(text, F.lit(" a "), F.lit(" “a” – ")), F.lit(". "), F.lit("… "))
    return F.replace(F.replace(out, F.lit("e"), F.lit("e\xad")), F.lit("the "), F.lit("l’the″ ?? !! "))


@query(f"SELECT doc_id, {_unified(_MESS)} AS plain FROM documents")
def unify_text(spark, sf_dir):
    """Texts with several kinds of quotes, hyphens and dots in one form."""
    return _docs(spark, sf_dir).select("doc_id", T.unify(_messy(F.col("text"))).alias("plain"))


@query(f"SELECT doc_id, {_SQ(_NOART(_unified('lower(' + _MESS + ')')))} AS normal FROM documents")
def output_normalize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normal_output(_messy(F.col("text"))).alias("normal"))


@query(f"SELECT doc_id, {_SPACED('text')} AS normal FROM documents")
def spaced_normalize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.spaced_normal("text").alias("normal"))


@query(f"SELECT doc_id, list_bool_or(list_transform(['the', 'clown show', 'moron', 'que', 'der'], lambda a: contains(t, {_SPACED('a')}))) AS found FROM (SELECT doc_id, {_SPACED('text')} AS t FROM documents)")
def answer_in_text(spark, sf_dir):
    answers = F.array(*(F.lit(x) for x in ("the", "clown show", "moron", "que", "der")))
    return _docs(spark, sf_dir).select("doc_id", T.any_answer_in(F.col("text"), answers).alias("found"))


_CLEAN = "list_transform(list_filter(list_transform({p}, lambda q: regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(q, '[^\\x00-\\x7f]+', ' ', 'g'), '[ \\t\\n\\r\\f\\x0b\\x1c-\\x1f]+', ' ', 'g'), '[^[:word:] ?.!,-]', '', 'g')), ' +', ' ', 'g'), '[^[:word:] ]$', '')), lambda q: length(q) > 5), lambda q: CASE WHEN contains(q, '?') THEN q ELSE q || '?' END)"


@query(f"""WITH p AS (SELECT doc_id, {_CLEAN.format(p="string_split(text, chr(10))")} AS q FROM documents), u AS (SELECT doc_id, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM p), f AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY ALL), g AS (SELECT doc_id, string_agg(x, '|' ORDER BY i) AS q FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(q, '') AS subqueries FROM documents LEFT JOIN g USING (doc_id)""")
def clean_queries(spark, sf_dir):
    """Lines of a text as cleaned sub-queries."""
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.clean_subqueries(F.split("text", "\n")), "|").alias("subqueries"))


# RE2 looks at no character before a match: it is taken along and put back, twice, as the one after a match can begin the next.
_NUMBERED = f"(^|[^\\p{{L}}\\p{{N}}_])[1-5]{T.WHITE}*(?:[.]|{T.WHITE}){T.WHITE}*"
_STRIPPED = lambda x: f"regexp_replace({x}, '^{T.WHITE}+|{T.WHITE}+$', '', 'g')"


@query(f"""WITH s AS (SELECT doc_id, '1. ' || text AS t FROM documents), m AS (SELECT doc_id, regexp_replace(regexp_replace(t, '{_NUMBERED}', '\\1' || chr(1), 'g'), '{_NUMBERED}', '\\1' || chr(1), 'g') AS t FROM s)
SELECT doc_id, array_to_string(list_filter(list_transform(flatten(list_transform(list_filter(string_split(t, chr(1)), lambda x: NOT regexp_full_match({_STRIPPED('x')}, '\\p{{Nd}}*')), lambda x: string_split(x, chr(10)))), lambda x: {_STRIPPED('x')}), lambda x: x <> ''), '|') AS items FROM m""")
def numbered_lists(spark, sf_dir):
    """Items of a numbered list; a number is put before the text."""
    t = F.concat(F.lit("1. "), "text")
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.numbered_items(t), "|").alias("items"))


@query("""WITH k AS (SELECT item_id, text, list_transform(list_filter(['what', 'why', 'how', 'when', 'where'], lambda k: contains(lower(text), k)), lambda k: upper(k[1]) || k[2:] || ' ' || text) AS k FROM benchmark),
u AS (SELECT item_id, unnest(list_concat(k, string_split(text, ' and '), string_split(text, ' or '))) AS x, generate_subscripts(list_concat(k, string_split(text, ' and '), string_split(text, ' or ')), 1) AS i FROM k),
f AS (SELECT item_id, trim(x) AS x, min(i) AS i FROM u GROUP BY item_id, u.x), g AS (SELECT item_id, string_agg(x, '|' ORDER BY i) AS q FROM f WHERE x <> '' GROUP BY item_id)
SELECT item_id, CASE WHEN len(k) < 3 THEN coalesce(q, '') ELSE array_to_string(k, '|') END AS subqueries FROM k LEFT JOIN g USING (item_id)""")
def fallback_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.fallback_subqueries("text"), "|").alias("subqueries"))


@query("SELECT doc_id, trim(regexp_extract(text, 'the (.*?) of', 1, 's')) AS inner_text FROM documents")
def between_markers(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.between("text", "the ", " of").alias("inner_text"))


@query("""WITH k AS (SELECT doc_id, regexp_replace(text, '[^a-zA-Z]', '', 'g') AS k FROM documents), m AS (SELECT k, max(doc_id) AS record FROM k WHERE k <> '' AND doc_id % 2 = 1 GROUP BY k)
SELECT doc_id, record FROM k LEFT JOIN m USING (k) WHERE doc_id % 2 = 0""")
def letters_key_join(spark, sf_dir):
    """Texts of even ids to those of odd ids by their letters only; the last writer wins, a miss is null."""
    k = _docs(spark, sf_dir).select("doc_id", F.md5(T.letters_only("text")).alias("k"), (T.letters_only("text") != "").alias("some"))
    m = k.where("some and doc_id % 2 = 1").groupBy("k").agg(F.max("doc_id").alias("record"))
    return k.where("doc_id % 2 = 0").join(m, "k", "left").select("doc_id", "record")


_PAIR = "WITH p AS (SELECT doc_id, split_part(text, chr(10), 1) AS a, text AS b, coalesce(nullif(substr(text, strpos(text, chr(10)) + 1), ''), text) AS c FROM documents)"


def _pairs(spark, sf_dir):
    """The first line of a text and all that follows it; the whole text twice where nothing does."""
    first, rest = F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), F.expr("substring(text, instr(text, '\n') + 1)")
    return _docs(spark, sf_dir).select("doc_id", first.alias("a"), F.col("text").alias("b"), F.coalesce(F.nullif(rest, F.lit("")), F.col("text")).alias("c"))


_STOP = ", ".join("'" + _QUOTED(w) + "'" for w in T.STOPWORDS)
_SIGNS = lambda x: f"translate(lower({x}), '{T.MATCH_PUNCTUATION}', '')"
_CONTENT = lambda x: f"list_filter(string_split({_SQ(_SIGNS(x))}, ' '), lambda w: w <> '' AND w NOT IN ({_STOP}))"


@query(f"{_PAIR}, w AS (SELECT doc_id, {_SIGNS('c')} AS c, {_CONTENT('a')} AS k FROM p) SELECT doc_id, round(CASE WHEN len(k) > 0 THEN len(list_filter(k, lambda w: contains(c, w))) / (2 * len(k)) ELSE 0 END, 9) AS ratio FROM w")
def match_ratios(spark, sf_dir):
    """Content words of the first line that the rest of the text has."""
    return _pairs(spark, sf_dir).select("doc_id", F.round(T.match_ratio("a", "c"), 9).alias("ratio"))


@query(f"WITH q AS (SELECT item_id, {_CONTENT('text')} AS k FROM benchmark WHERE item_id % 20 = 0), d AS (SELECT {_SIGNS('text')} AS d FROM documents) SELECT item_id, count(*) FILTER (len(list_filter(k, lambda x: contains(d, x))) > 0)::BIGINT AS matched FROM q, d GROUP BY item_id")
def entity_matches(spark, sf_dir):
    """How many documents any content word of a question is in; questions are those of ids divisible by 20, in blocks."""
    q = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select("item_id", "text")
    d = _docs(spark, sf_dir).select(F.col("text").alias("d"))
    return M.entity_matches(d, q, "item_id")


_RUNS = lambda x: f"list_distinct(list_filter(string_split({_SQ(x)}, ' '), lambda w: w <> ''))"


@query(f"{_PAIR} SELECT doc_id, len(list_intersect({_RUNS('a')}, {_RUNS('c')})) AS overlap FROM p")
def token_overlaps(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", T.token_overlap("a", "c").cast("long").alias("overlap"))


_LAST = lambda x: f"string_split(string_split(string_split({x}, chr(10) || chr(10))[-1], 'Answer: ')[-1], 'The answer is: ')[-1]"


@query(f"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, '. ', chr(10) || chr(10) || 'The answer is: ') ELSE 'Answer: ' || text END AS t FROM documents) SELECT doc_id, {_NORM(_LAST('t'))} AS answer, lower({_LAST('t')}) AS gold FROM t")
def final_answers(spark, sf_dir):
    """The answer of the last paragraph, normalised, and as a gold one; half of the texts are cut into paragraphs at their sentences."""
    t = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(". "), F.lit("\n\nThe answer is: "))).otherwise(F.concat(F.lit("Answer: "), "text"))
    return _docs(spark, sf_dir).select("doc_id", T.last_paragraph_answer(t).alias("answer"), T.last_paragraph_answer(t, gold=True).alias("gold"))


@query(f"{_PAIR}, x AS (SELECT doc_id, list_distinct(list_filter(string_split(a, ''), lambda k: k <> '')) AS x, list_distinct(list_filter(string_split(c, ''), lambda k: k <> '')) AS y FROM p) SELECT doc_id, round(CASE WHEN len(y) > 0 THEN len(list_intersect(x, y)) / len(y) ELSE 0 END, 9) AS ratio FROM x")
def character_overlaps(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", F.round(T.character_overlap("a", "c"), 9).alias("ratio"))


def _bag(n: int) -> str:
    gram = lambda c: f"list_transform(generate_series(1, len({c}) - {n - 1}), lambda i: array_to_string({c}[i:i + {n - 1}], ' '))"
    return f"""{_PAIR}, w AS (SELECT doc_id, {_WORDS('a')} AS x, {_WORDS('c')} AS y FROM p), g AS (SELECT doc_id, {gram('x')} AS x, {gram('y')} AS y FROM w), u AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, unnest(x) AS k FROM g) GROUP BY ALL), v AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, unnest(y) AS k FROM g) GROUP BY ALL),
c AS (SELECT doc_id, sum(least(u.n, v.n)) AS c FROM u JOIN v USING (doc_id, k) GROUP BY doc_id) SELECT doc_id, round(CASE WHEN len(x) + len(y) > 0 THEN 2 * coalesce(c, 0) / (len(x) + len(y)) ELSE 0 END, 9) AS f1 FROM g LEFT JOIN c USING (doc_id)"""


@query(_bag(1))
def token_f1_scores(spark, sf_dir):
    """Bag-of-words F1 of the first two lines."""
    rows = _pairs(spark, sf_dir).select("doc_id", T.words("a").alias("a"), T.words("c").alias("b"))
    return T.bag_f1(rows, "doc_id", "a", "b").select("doc_id", F.round("f1", 9).alias("f1"))


@query(_bag(2))
def rouge2_scores(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("doc_id", T.words("a").alias("a"), T.words("c").alias("b"))
    return T.rouge_n(rows, "doc_id", "a", "b", 2).select("doc_id", F.round("f1", 9).alias("f1"))


@query(f"SELECT doc_id, round(CASE WHEN len(w) > 0 THEN 0.0588::DOUBLE * (100.0::DOUBLE * l / len(w)) - 0.296::DOUBLE * (100.0::DOUBLE * s / len(w)) - 15.8::DOUBLE ELSE 0 END, 9)::DOUBLE AS cli FROM (SELECT doc_id, {_WORDS('text')} AS w, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS l, greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS s FROM documents)")
def coleman_liau_scores(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(T.coleman_liau("text"), 9).alias("cli"))


_LETTERS = "regexp_extract_all(lower(text), '\\p{L}+')"
_SENTENCES = "greatest(1, len(regexp_extract_all(text, '[.!?]+')))"


@query(f"""WITH w AS (SELECT doc_id, {_LETTERS} AS w, {_SENTENCES} AS s FROM documents), y AS (SELECT doc_id, s, len(w) AS n, list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '{T.VOWELS}')) - regexp_matches(x, '{T.SILENT}')::INT))) AS y FROM w)
SELECT doc_id, round(CASE WHEN n > 0 THEN 0.39::DOUBLE * n / s + 11.8::DOUBLE * y / n - 15.59::DOUBLE ELSE 0 END, 9)::DOUBLE AS grade FROM y""")
def reading_grades(spark, sf_dir):
    """Flesch-Kincaid grade of a text."""
    return _docs(spark, sf_dir).select("doc_id", F.round(T.reading_grade("text"), 9).alias("grade"))


@query(f"""WITH w AS (SELECT doc_id, unnest({_LETTERS}) AS k FROM documents), f AS (SELECT k FROM w GROUP BY k HAVING count(DISTINCT doc_id) >= 50), h AS (SELECT doc_id, count(*) FILTER (f.k IS NULL) AS hard, count(*) AS n FROM w LEFT JOIN f ON f.k = w.k GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN n > 0 THEN 0.1579::DOUBLE * (100.0::DOUBLE * hard / n) + 0.0496::DOUBLE * n / {_SENTENCES} + CASE WHEN 100.0::DOUBLE * hard / n > 5 THEN 3.6365::DOUBLE ELSE 0 END ELSE 0 END, 9)::DOUBLE AS dale_chall FROM documents LEFT JOIN h USING (doc_id)""")
def dale_chall_scores(spark, sf_dir):
    """Dale-Chall score of a text; words that 50 texts have stand for the familiar ones."""
    d = _docs(spark, sf_dir)
    words = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("(\\p{L}+)"), 1))).alias("word"))
    familiar = words.groupBy("word").count().where("count >= 50").select("word")
    return T.dale_chall(d, "doc_id", "text", familiar).select("doc_id", F.round("dale_chall", 9).alias("dale_chall"))


@query("SELECT doc_id, right(text, 2047) AS tail FROM documents")
def query_tail(spark, sf_dir):
    """The last 2,047 characters of a query."""
    return _docs(spark, sf_dir).select("doc_id", F.right("text", F.lit(2047)).alias("tail"))


@query("WITH p AS (SELECT doc_id, split_part(text, chr(10), 1) AS q, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS c FROM documents) SELECT doc_id, CASE WHEN length(c) < 2 THEN 'Question: ' || q ELSE 'Context: ' || c || chr(10) || 'Question: ' || q END AS input FROM p")
def conditional_prompt(spark, sf_dir):
    """A prompt of the first line as question, with all that follows it as context where there is some."""
    q = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    c = F.when(F.contains("text", F.lit("\n")), F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.lit(""))
    p = _docs(spark, sf_dir).select("doc_id", q.alias("q"), c.alias("c"))
    return p.select("doc_id", F.when(F.length("c") < 2, F.concat(F.lit("Question: "), "q")).otherwise(F.concat(F.lit("Context: "), "c", F.lit("\nQuestion: "), "q")).alias("input"))


@query("SELECT doc_id, '' AS instruction, text AS input, lang AS output FROM documents WHERE n_chars >= 500 AND text IS NOT NULL AND lang IS NOT NULL")
def instruction_rows(spark, sf_dir):
    """Complete rows of enough length as instruction, input and output."""
    return _docs(spark, sf_dir).where("n_chars >= 500").na.drop("any", subset=["text", "lang"]).select("doc_id", F.lit("").alias("instruction"), F.col("text").alias("input"), F.col("lang").alias("output"))


@query("""WITH m AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS tag, text FROM conversations), p AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply, lead(tag) OVER (PARTITION BY conv_id ORDER BY turn) AS next_tag, string_agg(tag || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist FROM m)
SELECT conv_id, turn, text AS instruction, reply AS output, md5(coalesce(hist, '')) AS history_md5 FROM p WHERE tag = 'human' AND next_tag = 'gpt'""")
def chat_to_instruction(spark, sf_dir):
    """Role tags mapped; each user turn with its reply and the history before it."""
    tag = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", tag.alias("tag"), "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    hist = F.array_join(F.collect_list(F.concat("tag", F.lit(": "), "text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), "\n")
    c = c.withColumns({"reply": F.lead("text").over(w), "next_tag": F.lead("tag").over(w), "hist": hist})
    return c.where("tag = 'human' and next_tag = 'gpt'").select("conv_id", "turn", F.col("text").alias("instruction"), F.col("reply").alias("output"), F.md5("hist").alias("history_md5"))


@query("""WITH s AS (SELECT source, string_agg('Q: ' || text, chr(10) ORDER BY r) AS shots FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '-9'), doc_id) AS r FROM documents) WHERE r <= 3 GROUP BY source)
SELECT doc_id, 'Questions on ' || source || chr(10) || shots || chr(10) || 'Q: ' || text || chr(10) || 'A:' AS prompt FROM documents JOIN s USING (source)""")
def fewshot_prompt(spark, sf_dir):
    """A subject prefix, three support questions in seeded order, and the target, all as whole texts.

    A support row without text is left out; a target without text, or a subject without any support text, has a null prompt.
    """
    from ..operators.groups import hashed, join_group_rows, per_group_sample

    d = _docs(spark, sf_dir).select("doc_id", "source", F.col("text").alias("q"))
    s = per_group_sample(d, "source", "doc_id", 3, 9).withColumn("h", hashed("doc_id", F.lit(9)))
    shots = s.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("h", "doc_id", "q"))).alias("x")).select("source", F.nullif(F.array_join(F.transform("x", lambda x: F.concat(F.lit("Q: "), x["q"])), "\n"), F.lit("")).alias("shots"))
    return join_group_rows(d, shots, "source", "doc_id").select("doc_id", F.concat(F.lit("Questions on "), "source", F.lit("\n"), "shots", F.lit("\nQ: "), "q", F.lit("\nA:")).alias("prompt"))


@query("""SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, array_to_string(regexp_extract_all(html, '<a href="([^"]*)">', 1), '|') AS links, len(regexp_extract_all(html, '<p>')) AS n_paragraphs FROM pages""")
def page_extract(spark, sf_dir):
    """Records from markup: title, host, links, number of paragraphs."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"),
        F.array_join(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), 1), "|").alias("links"), F.size(F.regexp_extract_all("html", F.lit("(<p>)"), 1)).cast("long").alias("n_paragraphs"),
    )


@query("""SELECT c_custkey, array_to_string(list_transform(string_split(c_name, '#'), lambda x: x[1:1]), '') AS initials, (array_to_string(list_filter(string_split(replace(c_name, '#', ' '), ' '), lambda w: length(w) > 3), ' '))[1:30] AS short FROM customer""")
def short_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", T.initials(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("initials"), T.short_name(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("short"))
