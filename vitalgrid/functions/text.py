"""Text normalisation, parsing and matching as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def numbers(s: Column | str) -> Column:
    """All runs of digits as integers; runs that do not fit are null."""
    return F.transform(F.regexp_extract_all(s, F.lit("([0-9]+)"), 1), lambda x: x.try_cast("bigint"))


def squeeze(s: Column) -> Column:
    """White space made single, ends trimmed."""
    return F.trim(F.regexp_replace(s, "[ \\t\\n\\r\\f]+", " "))


def without_punctuation(s: Column | str) -> Column:
    return F.translate(s, ASCII_PUNCTUATION, "")


def without_articles(s: Column) -> Column:
    """Articles as words of their own become spaces; letters, digits and underscores of any script belong to words."""
    return F.regexp_replace(s, "(?<![\\p{L}\\p{N}_])(?:a|an|the)(?![\\p{L}\\p{N}_])", " ")


def normalize_answer(s: Column | str) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    return squeeze(without_articles(without_punctuation(F.lower(s))))


def multiple_choice(s: Column | str) -> Column:
    """The first capital A to D anywhere, else the trimmed text."""
    found = F.regexp_extract(s, "(A|B|C|D)", 1)
    return F.when(found != "", found).otherwise(F.trim(s))


#: How answers are marked, in the order in which the marks are looked for.
_LOCATE = (
    "answer_choice[\"']: *\\{?[\"']?(.+?)[\"']? *\\}",
    "answer[\"']: *\\{?[\"']?(.+?)[\"']? *\\}",
    "answer is:? *\\{?[\"']?(.+?)[\"']? *\\}",
    "[Aa]nswer[*]?[*]?: *(A|B|C|D)",
    "is:? *[*]?[*]?(A|B|C|D)",
)


def locate_answer(s: Column | str) -> Column:
    """What follows an answer mark, by marks in order; else the whole text, white space made single; NA for null."""
    text = F.regexp_replace(s, "[ \\t\\n\\r\\f]+", " ")
    tries = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in _LOCATE]
    return F.coalesce(*tries, F.trim(text), F.lit("NA"))


def yes_no(s: Column | str) -> Column:
    """1 if the text has yes, else 0 if it has no, else null; yes is looked for first."""
    low = F.lower(s)
    return F.when(low.contains("yes"), 1).when(low.contains("no"), 0)


def last_digit_class(s: Column | str, classes: int = 10) -> Column:
    """The last number of the normalised text if it is below ``classes``; else 0."""
    last = F.try_element_at(numbers(normalize_answer(s)), F.lit(-1))
    return F.when(last < classes, last).otherwise(0).cast("int")


def parsed_answers(predicted: Column | str, gold: Column | str, task: str) -> Column:
    """A struct of the compared forms of prediction and gold, and whether the prediction holds no answer.

    ``binary``: 1 for yes, 0 for no and for none; ``stay``: the last number as a class from 0 to 9, 0 for none;
    ``single``: a capital from A to D, A for an empty one; ``summary``: the normalised texts, NA for an empty one. Null is an empty text.
    """
    p, g = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in (predicted, gold))
    if task == "binary":
        found = yes_no(normalize_answer(p))
        forms = F.coalesce(found, F.lit(0)).cast("string"), (normalize_answer(g) == "yes").cast("int").cast("string"), found.isNull()
    elif task == "stay":
        last = F.try_element_at(numbers(normalize_answer(p)), F.lit(-1))
        forms = last_digit_class(p).cast("string"), F.try_element_at(numbers(normalize_answer(g)), F.lit(-1)).cast("string"), F.coalesce(last > 9, F.lit(True))
    elif task in ("single", "summary"):
        form, other = (multiple_choice, "A") if task == "single" else (normalize_answer, "NA")
        forms = F.coalesce(F.nullif(form(p), F.lit("")), F.lit(other)), form(g), form(p) == ""
    else:
        raise ValueError(f"no such task: {task}")
    return F.struct(*(x.alias(n) for x, n in zip(forms, ("predicted", "gold", "no_answer"))))


#: Characters that are written in several ways, and their plain forms, one for one.
_PLAIN = (
    ("‐‑‒–—―⁃", "-"), ("−－⁻", "-"), ("“”„‟", '"'), ("‘’‚‛", "'"), ("՚Ꞌꞌ＇", "'"), ("`´", "'"), ("′‵", "'"),
    ("⁄∕", "/"), ("˜⁓∼∽∿〜～", "~"), ("\x0b\x0c\x85", " "),
)
_ONE_TO_ONE = ("".join(a for a, _ in _PLAIN), "".join(b * len(a) for a, b in _PLAIN))
#: Characters that become several, and those that go.
_SEVERAL = (("″", "''"), ("‶", "''"), ("‴", "'''"), ("‷", "'''"), ("⁗", "''''"), ("…", "..."), (" . . . ", " ... "))
_GONE = "[\\x01-\\x08\\x0e\\x0f\\x11-\\x1b\\x{ad}]"


def unify(s: Column | str) -> Column:
    """Controls and soft hyphens out, hyphens, quotes, primes, slashes and tildes in one form, ellipsis as dots, repeated question and exclamation marks once."""
    out = F.translate(F.regexp_replace(s, _GONE, ""), *_ONE_TO_ONE)
    for mark, plain in _SEVERAL:
        out = F.replace(out, F.lit(mark), F.lit(plain))
    return F.regexp_replace(F.regexp_replace(out, "[?]{2,}", "?"), "[!]{2,}", "!")


def normal_output(s: Column | str) -> Column:
    """Lower case, unified, no articles, single spaces; punctuation stays."""
    return squeeze(without_articles(unify(F.lower(s))))


def spaced_normal(s: Column | str) -> Column:
    """As ``normal_output``, and ASCII punctuation becomes space."""
    return squeeze(without_articles(F.translate(unify(F.lower(s)), ASCII_PUNCTUATION, " " * len(ASCII_PUNCTUATION))))


def any_answer_in(text: Column, answers: Column) -> Column:
    return F.exists(answers, lambda a: spaced_normal(text).contains(spaced_normal(a)))


_BLANK = "[ \\t\\n\\r\\f\\x0b\\x1c-\\x1f]+"


def clean_subqueries(parts: Column) -> Column:
    """Other than ASCII as space, then letters, digits, underscores, spaces and ``?.!,-`` only, single spaces, without one sign at the end; those of more than five characters, asked with a question mark, first ones of equals."""
    plain = F.transform(parts, lambda q: F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(q, "[^\\x00-\\x7f]+", " "), _BLANK, " "), "[^A-Za-z0-9_ ?.!,-]", "")), " +", " "))
    ended = F.transform(plain, lambda q: F.regexp_replace(q, "[^A-Za-z0-9_ ]$", ""))
    asked = F.transform(F.filter(ended, lambda q: F.length(q) > 5), lambda q: F.when(q.contains("?"), q).otherwise(F.concat(q, F.lit("?"))))
    return F.array_distinct(asked)


#: White space of any script, as a class of regular expressions of Java and of RE2.
WHITE = "[\\t-\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def stripped(s: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(s, f"^{WHITE}+|{WHITE}+$", "")


def numbered_items(s: Column | str) -> Column:
    """The items of a numbered list, line by line: a number is 1 to 5, no part of a word, before a dot or white space.

    Parts between numbers that are digits only are left out whole; lines are stripped, empty ones left out.
    """
    parts = F.split(s, f"(?<![\\p{{L}}\\p{{N}}_])[1-5]{WHITE}*(?:[.]|{WHITE}){WHITE}*")
    kept = F.filter(parts, lambda x: ~F.rlike(stripped(x), F.lit("^\\p{Nd}*$")))
    return F.filter(F.transform(F.flatten(F.transform(kept, lambda x: F.split(x, "\n"))), stripped), lambda x: x != "")


def fallback_subqueries(s: Column | str) -> Column:
    """Sub-queries of a question that could not be split: each keyword it contains before the question; if these are fewer than three, also its parts at ' and ' and at ' or ', first ones of equals."""
    col = F.col(s) if isinstance(s, str) else s
    asked = F.array_compact(F.array(*(F.when(F.contains(F.lower(col), F.lit(k)), F.concat(F.lit(k.capitalize() + " "), col)) for k in ("what", "why", "how", "when", "where"))))
    parts = F.array_distinct(F.concat(asked, F.split(col, " and "), F.split(col, " or ")))
    return F.when(F.size(asked) < 3, F.filter(F.transform(parts, F.trim), lambda x: x != "")).otherwise(asked)


def between(s: Column | str, start: str, end: str) -> Column:
    """What stands between two literal markers, over line breaks; empty if they are missing."""
    quote = lambda x: "".join("\\" + c if not c.isalnum() and c != " " else c for c in x)
    return F.trim(F.regexp_extract(s, f"(?s){quote(start)}(.*?){quote(end)}", 1))


def letters_only(s: Column | str) -> Column:
    return F.regexp_replace(s, "[^a-zA-Z]", "")


def words(s: Column | str) -> Column:
    """Words without ASCII punctuation; none for an empty text."""
    return F.filter(F.split(squeeze(without_punctuation(F.lower(s))), " "), lambda w: w != "")


#: Words and signs that carry no content in matching, and signs that are taken out before.
STOPWORDS = tuple(
    """in on at to for with by from about a an the it they we you he she i me my mine ours us your yours his hers their theirs
    and or but because if then than as is are was were do does did have has had having be been being not no nor none
    what where when who why how which whom whose . , ! ? ; : - ( ) [ ] { } " ' ... -- / \\ | < > = + * & ^ % $ # @ ~ `
    of that this these those such there here all any both each few more some most other another every either neither""".split()
)
MATCH_PUNCTUATION = ".,!?;:\"()[]{}-"


def content_words(s: Column | str) -> Column:
    """Words in lower case, repeats included, without signs and words that carry no content."""
    return F.filter(F.split(squeeze(F.translate(F.lower(s), MATCH_PUNCTUATION, "")), " "), lambda w: (w != "") & ~w.isin(*STOPWORDS))


def match_ratio(answer: Column | str, document: Column | str) -> Column:
    """Content words of the answer that are substrings of the document without signs, over twice their number; 0 without any."""
    both = F.array(F.struct(F.translate(F.lower(document), MATCH_PUNCTUATION, "").alias("d"), content_words(answer).alias("k")))  # each made once, not for every word
    ratio = lambda x: F.size(F.filter(x["k"], lambda w: F.contains(x["d"], w))) / (2 * F.size(x["k"]))
    return F.element_at(F.transform(both, lambda x: F.when(F.size(x["k"]) > 0, ratio(x)).otherwise(F.lit(0.0))), 1)


def token_overlap(a: Column | str, b: Column | str) -> Column:
    """Distinct runs without white space, as written, in common."""
    return F.size(F.array_intersect(*(F.filter(F.split(squeeze(F.col(x) if isinstance(x, str) else x), " "), lambda w: w != "") for x in (a, b))))


def last_paragraph_answer(s: Column | str, gold: bool = False) -> Column:
    """The last paragraph (after two line breaks), from behind its last 'Answer: ', then behind the last 'The answer is: ' of that; normalised, a gold one in lower case only."""
    last = F.element_at(F.split(s, "\n\n"), -1)
    for mark in ("Answer: ", "The answer is: "):
        last = F.element_at(F.split(last, mark), -1)
    return F.lower(last) if gold else normalize_answer(last)


def character_overlap(a: Column | str, b: Column | str) -> Column:
    """Distinct characters in common over those of the second text; 0 if it has none."""
    x, y = (F.array_distinct(F.filter(F.split(c, ""), lambda k: k != "")) for c in (a, b))
    return F.when(F.size(y) > 0, F.size(F.array_intersect(x, y)) / F.size(y)).otherwise(F.lit(0.0))


def safe_name(*parts: Column | str) -> Column:
    return F.regexp_replace(F.concat_ws("_", *parts), "/", "_")


def bag_f1(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, f1): F1 of two array columns as bags, 0 where both are empty."""
    from ..operators.overlap import run_scores

    return run_scores(rows, key, a, b).select(key, "f1")


def answer_scores(rows: DataFrame, key: str, predicted: str, gold: str) -> DataFrame:
    """(key, f1, precision, recall) of the words of two answers; 0 where they differ and either is yes, no or noanswer."""
    from ..operators.overlap import run_scores

    fixed = ("yes", "no", "noanswer")
    lost = (F.col(predicted) != F.col(gold)) & (F.col(predicted).isin(*fixed) | F.col(gold).isin(*fixed))
    bags = rows.select(key, *(F.when(~F.coalesce(lost, F.lit(False)), F.filter(F.split(squeeze(F.col(c)), " "), lambda w: w != "")).alias(x) for c, x in ((predicted, "a"), (gold, "b"))))
    return run_scores(bags, key, "a", "b")


def answer_f1(rows: DataFrame, key: str, predicted: str, gold: str) -> DataFrame:
    """(key, f1) of ``answer_scores``."""
    return answer_scores(rows, key, predicted, gold).select(key, "f1")


def rouge_n(rows: DataFrame, key: str, a: str, b: str, n: int) -> DataFrame:
    """(key, f1): ROUGE-n of two word-array columns as they are."""
    from ..operators.overlap import run_scores

    return run_scores(rows, key, a, b, n).select(key, "f1")


def coleman_liau(s: Column | str) -> Column:
    """0.0588 letters and -0.296 sentences per 100 words, less 15.8; 0 without words, null for null."""
    w = F.size(words(s))
    letters = F.length(F.regexp_replace(s, "[^a-zA-Z]", ""))
    return F.when(w > 0, 0.0588 * (100.0 * letters / w) - 0.296 * (100.0 * sentence_count(s) / w) - 15.8).when(w == 0, 0.0)


def sentence_count(s: Column | str) -> Column:
    """Runs of signs that end a sentence; one at least."""
    return F.greatest(F.lit(1), F.regexp_count(F.col(s) if isinstance(s, str) else s, F.lit("[.!?]+")))


#: Runs of vowels, and a silent e at the end of a word (not in le).
VOWELS, SILENT = "[aeiouyáéíóúèêàäöü]+", "[^l]e$"


def syllables(word: Column) -> Column:
    """Runs of vowels of a word in lower case, less a silent final e; one at least."""
    return F.greatest(F.lit(1), F.regexp_count(word, F.lit(VOWELS)) - F.rlike(word, F.lit(SILENT)).cast("int"))


def reading_grade(s: Column | str) -> Column:
    """Flesch-Kincaid grade by runs of letters as words: 0.39 words a sentence and 11.8 syllables a word, less 15.59; 0 without words, null for null."""
    w = F.regexp_extract_all(F.lower(s), F.lit("(\\p{L}+)"), 1)
    n = F.size(w)
    many = F.aggregate(F.transform(w, syllables), F.lit(0), lambda a, b: a + b)
    return F.when(n > 0, 0.39 * n / sentence_count(s) + 11.8 * many / n - 15.59).when(n == 0, 0.0)


def dale_chall(rows: DataFrame, key: str, text: str, familiar: DataFrame, word: str = "word") -> DataFrame:
    """(key, dale_chall): 0.1579 times the percentage of words that are not in ``familiar`` and 0.0496 words a sentence; 3.6365 more above five per cent; 0 without words.

    ``familiar`` has words in lower case. Each distinct word of a text is looked up once; null texts have no words.
    """
    s = F.coalesce(F.col(text), F.lit(""))
    w = rows.select(key, F.regexp_extract_all(F.lower(s), F.lit("(\\p{L}+)"), 1).alias("_w"), sentence_count(s).alias("_s"))
    seen = w.select(key, F.explode("_w").alias("_k")).groupBy(key, "_k").agg(F.count("*").alias("_n"))
    known = familiar.select(F.col(word).alias("_k")).distinct().withColumn("_known", F.lit(1))
    hard = seen.join(known, "_k", "left").groupBy(key).agg(F.sum(F.when(F.col("_known").isNull(), F.col("_n")).otherwise(0)).alias("_hard"), F.sum("_n").alias("_all"))
    share, length = 100 * F.col("_hard") / F.col("_all"), F.col("_all") / F.col("_s")
    score = 0.1579 * share + 0.0496 * length + F.when(share > 5, 3.6365).otherwise(0.0)
    return w.select(key, "_s").join(hard, key, "left").select(key, F.coalesce(F.when(F.col("_all") > 0, score), F.lit(0.0)).alias("dale_chall"))


def initials(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, " "), lambda x: F.substring(x, 1, 1)), "")


def short_name(s: Column | str, longer_than: int = 3, most: int = 30) -> Column:
    """Words of more than three characters, 30 characters in all at most."""
    return F.substring(F.array_join(F.filter(F.split(s, " "), lambda w: F.length(w) > longer_than), " "), 1, most)


def author_name(last: Column, fore: Column) -> Column:
    """The last name, and behind it the initials of the fore names if there are any."""
    own = initials(squeeze(F.coalesce(fore, F.lit(""))))
    return F.when(own != "", F.concat(last, F.lit(" "), own)).otherwise(last)


def journal_text(title: Column, year: Column) -> Column:
    """A journal's title (of more than two words: in its short form) and the year, parted by a comma; null without both."""
    many = F.size(F.filter(F.split(squeeze(title), " "), lambda w: w != "")) > 2
    name = F.when(many, short_name(squeeze(title))).otherwise(title)
    return F.nullif(F.concat_ws(", ", F.nullif(name, F.lit("")), F.nullif(year, F.lit(""))), F.lit(""))


#: What stands before and behind a question in a rendered chat, and a sign that is taken out of it.
_CHAT = ("<|start_header_id|>user<|end_header_id|>", "<|start_header_id|>assistant<|end_header_id|>", "⋮")


def chat_question(s: Column | str) -> Column:
    """The first user text of a rendered chat, white space made single; empty if there is none."""
    return stripped(F.replace(F.regexp_replace(between(s, *_CHAT[:2]), f"{WHITE}+", " "), F.lit(_CHAT[2])))


def without_match_signs(s: Column | str) -> Column:
    """Without the signs that are taken out before matching."""
    return F.translate(s, MATCH_PUNCTUATION, "")


def match_words(s: Column | str) -> Column:
    """Words in lower case without those signs."""
    return F.filter(F.split(F.regexp_replace(F.lower(without_match_signs(s)), f"{WHITE}+", " "), " "), lambda w: w != "")


def path_list(number: str, path: str, description: str | None = None) -> Column:
    """Meta-paths (few) as the text of a prompt, by number: an aggregate."""
    parts = [F.lit("ID: "), F.col(number).cast("string"), F.lit("\nMeta_path: "), F.col(path), F.lit("\n")]
    if description:
        parts += [F.lit("Description: "), F.col(description), F.lit("\n")]
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.concat(*parts).alias("t")))), lambda x: x["t"]), "\n")
