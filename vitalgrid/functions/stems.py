"""The Porter stemmer, with its usual later additions, as column expressions over arrays of words.

Each step is a list of rules; the first rule whose suffix a word has decides, whether or not its condition on what is
left holds. A step reads each word once (an array is transformed step by step), so expressions do not grow with the steps.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of consonants and of vowels; y is a vowel after a consonant.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: Conditions on what is left of a word, as regular expressions of Java and of RE2.
ANY, VOWEL = "", f"^(?:{_C})?[aeiouy]"
MORE_THAN_0, IS_1, MORE_THAN_1 = f"^(?:{_C})?{_V}{_C}", f"^(?:{_C})?{_V}{_C}(?:{_V})?$", f"^(?:{_C})?{_V}{_C}{_V}{_C}"
#: consonant, vowel, consonant other than w, x and y; or a vowel and a consonant alone
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$|^[aeiou][^aeiou]$"

#: Words that keep a form of their own.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Suffix, what takes its place, condition on what is left.
PLURALS = (("sses", "ss", ANY), ("ies", "i", ANY), ("ss", "ss", ANY), ("s", "", ANY))
MENDED = (("at", "ate", ANY), ("bl", "ble", ANY), ("iz", "ize", ANY))
DOUBLE = tuple((a, b, MORE_THAN_0) for a, b in (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
))
SINGLE = tuple((a, b, MORE_THAN_0) for a, b in (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")))
LAST = tuple((a, "", MORE_THAN_1) for a in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent")) + (
    ("sion", "s", MORE_THAN_1), ("tion", "t", MORE_THAN_1), ("ion", "ion", ANY)) + tuple((a, "", MORE_THAN_1) for a in ("ou", "ism", "ate", "iti", "ous", "ive", "ize"))


def _holds(left: Column, condition: str) -> Column:
    return F.rlike(left, F.lit(condition)) if condition else F.lit(True)


def _rules(w: Column, rules: tuple, otherwise: Column | None = None) -> Column:
    """The word after the first rule whose suffix it has; a condition of ``sion`` and ``tion`` is on all before ``ion``."""
    out = None
    for suffix, put, condition in rules:
        left = F.substring(w, F.lit(1), F.length(w) - len(suffix))
        tested = F.concat(left, F.lit(put)) if suffix in ("sion", "tion") else left
        new = F.when(_holds(tested, condition), F.concat(left, F.lit(put))).otherwise(w)
        out = F.when(F.endswith(w, F.lit(suffix)), new) if out is None else out.when(F.endswith(w, F.lit(suffix)), new)
    return out.otherwise(w if otherwise is None else otherwise)


def _plurals(w: Column) -> Column:
    return F.when(F.rlike(w, F.lit("^.ies$")), F.substring(w, 1, 3)).otherwise(_rules(w, PLURALS))


def _past(w: Column) -> Column:
    """Takes off ed and ing; what has to be mended after that ends in a star."""
    less = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    return (
        F.when(F.endswith(w, F.lit("ied")), F.when(F.length(w) == 4, less(1)).otherwise(less(2)))
        .when(F.endswith(w, F.lit("eed")), F.when(_holds(less(3), MORE_THAN_0), less(1)).otherwise(w))
        .when(F.endswith(w, F.lit("ed")) & _holds(less(2), VOWEL), F.concat(less(2), F.lit("*")))
        .when(F.endswith(w, F.lit("ing")) & _holds(less(3), VOWEL), F.concat(less(3), F.lit("*")))
        .otherwise(w)
    )


def _mended(w: Column) -> Column:
    x = F.substring(w, F.lit(1), F.length(w) - 1)
    twice = F.rlike(x, F.lit("(?:bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|[aeiou]yy|00|11|22|33|44|55|66|77|88|99)$"))
    short = F.rlike(x, F.lit(IS_1)) & F.rlike(x, F.lit(SHORT))
    loose = F.when(twice, F.substring(x, F.lit(1), F.length(x) - 1)).when(F.rlike(x, F.lit("(?:ll|ss|zz)$")), x).when(short, F.concat(x, F.lit("e"))).otherwise(x)
    return F.when(F.endswith(w, F.lit("*")), _rules(x, MENDED, loose)).otherwise(w)


def _y(w: Column) -> Column:
    """y after a consonant that is not the first letter."""
    return F.when(F.rlike(w, F.lit("^.+(?:[^aeiouy]|[aeiou]y)y$")), F.concat(F.substring(w, F.lit(1), F.length(w) - 1), F.lit("i"))).otherwise(w)


def _full(w: Column) -> Column:
    """``alli`` is taken to ``al`` before the other rules look at the word."""
    left = F.substring(w, F.lit(1), F.length(w) - 4)
    return F.when(F.endswith(w, F.lit("alli")) & _holds(left, MORE_THAN_0), F.concat(left, F.lit("al"))).otherwise(w)


def _double(w: Column) -> Column:
    logi = F.when(_holds(F.substring(w, F.lit(1), F.length(w) - 3), MORE_THAN_0), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return _rules(w, DOUBLE, F.when(F.endswith(w, F.lit("logi")), logi).otherwise(w))


def _e(w: Column) -> Column:
    x = F.substring(w, F.lit(1), F.length(w) - 1)
    off = F.rlike(x, F.lit(MORE_THAN_1)) | (F.rlike(x, F.lit(IS_1)) & ~F.rlike(x, F.lit(SHORT)))
    return F.when(F.endswith(w, F.lit("e")) & off, x).otherwise(w)


def _ll(w: Column) -> Column:
    x = F.substring(w, F.lit(1), F.length(w) - 1)
    return F.when(F.endswith(w, F.lit("ll")) & F.rlike(x, F.lit(MORE_THAN_1)), x).otherwise(w)


_STEPS = (_plurals, _past, _mended, _y, _full, _double, lambda w: _rules(w, SINGLE), lambda w: _rules(w, LAST), _e, _ll)


def stemmed(words: Column | str, longer_than: int = 3) -> Column:
    """The stems of an array of words in lower case; words of up to ``longer_than`` characters stay, nulls too."""
    out = F.transform(words, lambda w: F.when(F.length(w) > max(2, longer_than), w).otherwise(F.concat(F.lit("="), w)))
    own = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    out = F.transform(out, lambda w: F.coalesce(F.concat(F.lit("="), F.when(w.isin(*IRREGULAR), F.element_at(own, w))), w))
    on = lambda step: lambda w: F.when(F.startswith(w, F.lit("=")), w).otherwise(step(w))  # noqa: E731  words that are done begin with a sign
    for step in _STEPS:
        out = F.transform(out, on(step))
    return F.transform(out, lambda w: F.when(F.startswith(w, F.lit("=")), F.substring(w, F.lit(2), F.length(w))).otherwise(w))


def summary_words(s: Column | str) -> Column:
    """Runs of ASCII letters and digits in lower case, stemmed if longer than three."""
    return stemmed(F.regexp_extract_all(F.lower(s), F.lit("([a-z0-9]+)"), 1))


def sentences(s: Column | str) -> Column:
    """Lines, cut further behind signs that end a sentence before white space; empty ones left out."""
    return F.filter(F.split(F.regexp_replace(s, "([.!?]+)[ \\t\\r\\f]+", "$1\n"), "\n"), lambda x: F.trim(x) != "")


#: A word in lower case, or the end of a sentence as in ``sentences``, of UTF-8.
TOKENS = re.compile(rb"[a-z0-9]+|[.!?](?=[ \t\r\f])|\n")
_RE = {c: re.compile(c.replace("$", r"\Z")) for c in (VOWEL, MORE_THAN_0, IS_1, MORE_THAN_1, SHORT)}
_TWICE, _FIRM = re.compile(r"(?:bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|[aeiou]yy|00|11|22|33|44|55|66|77|88|99)\Z"), re.compile(r"(?:ll|ss|zz)\Z")
_IES, _LONE_Y = re.compile(r".ies\Z"), re.compile(r".+(?:[^aeiouy]|[aeiou]y)y\Z")


def _met(left: str, condition: str) -> bool:
    return not condition or _RE[condition].search(left) is not None


_ENDS = {rules: tuple(x for x, _, _ in rules) for rules in (PLURALS, MENDED, DOUBLE, SINGLE, LAST)}


def _ruled(w: str, rules: tuple, otherwise: str | None = None) -> str:
    for suffix, put, condition in rules if w.endswith(_ENDS[rules]) else ():
        if w.endswith(suffix):
            left = w[: len(w) - len(suffix)]
            return left + put if _met(left + put if suffix in ("sion", "tion") else left, condition) else w
    return w if otherwise is None else otherwise


def stem(w: str, longer_than: int = 3) -> str:
    """``stemmed`` of one word of ASCII letters and digits: for what reads each distinct word of many once."""
    if len(w) <= max(2, longer_than):
        return w
    if w in IRREGULAR:
        return IRREGULAR[w]
    w = w[:3] if _IES.match(w) else _ruled(w, PLURALS)
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if _met(w[:-3], MORE_THAN_0) else w
    else:
        x = w[:-2] if w.endswith("ed") and _met(w[:-2], VOWEL) else w[:-3] if w.endswith("ing") and _met(w[:-3], VOWEL) else None
        if x is not None:
            short = _met(x, IS_1) and _met(x, SHORT)
            w = _ruled(x, MENDED, x[:-1] if _TWICE.search(x) else x if _FIRM.search(x) else x + "e" if short else x)
    if _LONE_Y.match(w):
        w = w[:-1] + "i"
    if w.endswith("alli") and _met(w[:-4], MORE_THAN_0):
        w = w[:-4] + "al"
    w = _ruled(w, DOUBLE, w[:-1] if w.endswith("logi") and _met(w[:-3], MORE_THAN_0) else w)
    w = _ruled(_ruled(w, SINGLE), LAST)
    if w.endswith("e") and (_met(w[:-1], MORE_THAN_1) or _met(w[:-1], IS_1) and not _met(w[:-1], SHORT)):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _met(w[:-1], MORE_THAN_1) else w
