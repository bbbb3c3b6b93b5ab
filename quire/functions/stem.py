"""The ``english`` configuration: stop words and Porter (1980) stemming as
built-in Column expressions (no UDF).

Each step of the stemmer binds its input once through a one-element
``transform`` (a lambda variable), so the expression tree grows linearly with
the steps and every step is evaluated once per word. Index builds stem each
distinct word once (the vocabulary job in ``quire.operators.analyze``), not
every token. Consonant/vowel
structure is computed as a pattern string of ``C``/``V`` letters (``y`` is a
vowel after a consonant), from which the measure ``m`` of a stem is the number
of ``VC`` pairs in the run-collapsed pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: Spark's default English stop words
# (pyspark.ml.feature.StopWordsRemover.loadDefaultStopWords("english")), 181 words.
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should",
    "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd",
    "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've", "we've",
    "you've", "they've", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't",
    "doesn't", "didn't", "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't",
    "cannot", "could", "here's", "how's", "let's", "ought", "that's", "there's", "what's", "when's",
    "where's", "who's", "why's", "would",
)

# --- Fixed values: Porter (1980) suffix rules, as (suffix, replacement, condition).
# Conditions: "" none, "m>0", "m>1", "*v*" (stem has a vowel), "ion" (m>1 and stem ends s/t).
STEP_1A = (("sses", "ss", ""), ("ies", "i", ""), ("ss", "ss", ""), ("s", "", ""))
STEP_1C = (("y", "i", "*v*"),)
STEP_2 = (
    ("ational", "ate", "m>0"), ("tional", "tion", "m>0"), ("enci", "ence", "m>0"), ("anci", "ance", "m>0"),
    ("izer", "ize", "m>0"), ("abli", "able", "m>0"), ("alli", "al", "m>0"), ("entli", "ent", "m>0"),
    ("eli", "e", "m>0"), ("ousli", "ous", "m>0"), ("ization", "ize", "m>0"), ("ation", "ate", "m>0"),
    ("ator", "ate", "m>0"), ("alism", "al", "m>0"), ("iveness", "ive", "m>0"), ("fulness", "ful", "m>0"),
    ("ousness", "ous", "m>0"), ("aliti", "al", "m>0"), ("iviti", "ive", "m>0"), ("biliti", "ble", "m>0"),
)
STEP_3 = (
    ("icate", "ic", "m>0"), ("ative", "", "m>0"), ("alize", "al", "m>0"), ("iciti", "ic", "m>0"),
    ("ical", "ic", "m>0"), ("ful", "", "m>0"), ("ness", "", "m>0"),
)
STEP_4 = (
    ("al", "", "m>1"), ("ance", "", "m>1"), ("ence", "", "m>1"), ("er", "", "m>1"), ("ic", "", "m>1"),
    ("able", "", "m>1"), ("ible", "", "m>1"), ("ant", "", "m>1"), ("ement", "", "m>1"), ("ment", "", "m>1"),
    ("ent", "", "m>1"), ("ion", "", "ion"), ("ou", "", "m>1"), ("ism", "", "m>1"), ("ate", "", "m>1"),
    ("iti", "", "m>1"), ("ous", "", "m>1"), ("ive", "", "m>1"), ("ize", "", "m>1"),
)
# Step 1b: (m>0) eed -> ee; (*v*) ed -> ; (*v*) ing -> ; after ed/ing: at -> ate, bl -> ble,
# iz -> ize, a double consonant other than l/s/z loses one letter, (m=1 and *o) adds e.
STEP_1B_TAILS = (("at", "ate"), ("bl", "ble"), ("iz", "ize"))
DOUBLE_CONSONANT = "(bb|cc|dd|ff|gg|hh|jj|kk|ll|mm|nn|pp|qq|rr|ss|tt|vv|ww|xx|zz)$"
MIN_STEM_LENGTH = 3  # words of one or two letters are left as they are


def cv_pattern(w: Column) -> Column:
    """``C``/``V`` letter per character (``y`` after a consonant is a vowel)."""
    p = F.regexp_replace(w, "[aeiou]", "V")
    p = F.regexp_replace(p, "[^Vy]", "C")
    p = F.regexp_replace(p, "^y", "C")
    p = F.regexp_replace(p, "Cy", "CV")
    return F.regexp_replace(p, "y", "C")


def measure(p: Column) -> Column:
    """``m`` of a C/V pattern: number of VC pairs after collapsing runs."""
    c = F.regexp_replace(F.regexp_replace(p, "C+", "C"), "V+", "V")
    return ((F.length(c) - F.length(F.replace(c, F.lit("VC"), F.lit("")))) / 2).cast("int")


def _cut(s: Column, k: int) -> Column:
    return s.substr(F.lit(1), F.length(s) - k)


def _cvc(stem: Column, pstem: Column) -> Column:
    """``*o``: stem ends consonant-vowel-consonant, the last not w, x or y."""
    return pstem.rlike("CVC$") & ~stem.rlike("[wxy]$")


def _cond(cond: str, stem: Column, pstem: Column) -> Column:
    if cond == "":
        return F.lit(True)
    if cond == "m>0":
        return measure(pstem) > 0
    if cond == "m>1":
        return measure(pstem) > 1
    if cond == "*v*":
        return pstem.contains("V")
    if cond == "ion":
        return (measure(pstem) > 1) & stem.rlike("[st]$")
    raise ValueError(cond)


def _bind(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value`` (evaluated once, referenced freely)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _let(w: Column, body) -> Column:
    """Evaluate ``body(struct(w, p))`` with ``w`` and its C/V pattern bound once;
    ``w`` is bound first so the struct refers to a variable, not the expression."""
    return _bind(w, lambda x: _bind(F.struct(x.alias("w"), cv_pattern(x).alias("p")), body))


def _rules_body(rules):
    """Longest matching suffix decides; if its condition fails the word stays."""

    def body(word: Column, pat: Column) -> Column:
        out = None
        for suffix, repl, cond in sorted(rules, key=lambda x: -len(x[0])):
            k = len(suffix)
            stem, pstem = _cut(word, k), _cut(pat, k)
            then = F.when(_cond(cond, stem, pstem), F.concat(stem, F.lit(repl))).otherwise(word)
            out = F.when(word.endswith(suffix), then) if out is None else out.when(word.endswith(suffix), then)
        return out.otherwise(word)

    return body


def _step1b_body(word: Column, pat: Column) -> Column:
    def tidy(x: Column, px: Column) -> Column:
        out = None
        for suffix, repl in STEP_1B_TAILS:
            branch = F.concat(_cut(x, len(suffix)), F.lit(repl))
            out = F.when(x.endswith(suffix), branch) if out is None else out.when(x.endswith(suffix), branch)
        out = out.when(x.rlike(DOUBLE_CONSONANT) & ~x.rlike("[lsz]$"), _cut(x, 1))
        out = out.when((measure(px) == 1) & _cvc(x, px), F.concat(x, F.lit("e")))
        return out.otherwise(x)

    s3, p3, s2, p2 = _cut(word, 3), _cut(pat, 3), _cut(word, 2), _cut(pat, 2)
    return (
        F.when(word.endswith("eed"), F.when(measure(p3) > 0, F.concat(s3, F.lit("ee"))).otherwise(word))
        .when(word.endswith("ed"), F.when(p2.contains("V"), tidy(s2, p2)).otherwise(word))
        .when(word.endswith("ing"), F.when(p3.contains("V"), tidy(s3, p3)).otherwise(word))
        .otherwise(word)
    )


def _drop_e_body(word: Column, pat: Column) -> Column:
    stem, pstem = _cut(word, 1), _cut(pat, 1)
    m = measure(pstem)
    ok = (m > 1) | ((m == 1) & ~_cvc(stem, pstem))
    return F.when(word.endswith("e") & ok, stem).otherwise(word)


def _drop_l_body(word: Column, pat: Column) -> Column:
    return F.when(word.endswith("ll") & (measure(pat) > 1), _cut(word, 1)).otherwise(word)


# The steps in order; each maps (word, C/V pattern of word) to the next word.
STEPS = (
    _rules_body(STEP_1A),
    _step1b_body,
    _rules_body(STEP_1C),
    _rules_body(STEP_2),
    _rules_body(STEP_3),
    _rules_body(STEP_4),
    _drop_e_body,
    _drop_l_body,
)


def porter_stem(w: Column) -> Column:
    """Porter (1980) stem of a lower-case word, as one Column (each step bound
    through a lambda variable; usable inside other higher-order functions)."""
    def apply(step):
        return lambda r: step(r["w"], r["p"])

    s = w
    for step in STEPS:
        s = _let(s, apply(step))
    return F.when(F.length(w) >= MIN_STEM_LENGTH, s).otherwise(w)


def english_lexeme(simple: Column) -> Column:
    """Stem of a simple lexeme; null for a stop word (its position stays taken)."""
    return F.when(simple.isin(list(ENGLISH_STOP_WORDS)), F.lit(None).cast("string")).otherwise(porter_stem(simple))


# --- the same rules for the query's own words (driver side, a handful of words) ---
class _Letters(dict):
    """Translation to the C/V pattern; every other letter is a consonant."""

    def __missing__(self, code: int) -> str:
        return "C"


_LETTERS = _Letters({**{ord(c): "V" for c in "aeiou"}, ord("y"): "y"})


def _cv_py(w: str) -> str:
    p = w.translate(_LETTERS)
    if "y" in p:
        p = "C" + p[1:] if p[0] == "y" else p
        p = p.replace("Cy", "CV").replace("y", "C")
    return p


def _m_py(p: str) -> int:
    return p.count("VC")  # a pair for every change from vowels to consonants


def _cvc_py(stem: str, pstem: str) -> bool:
    return pstem.endswith("CVC") and not re.search("[wxy]$", stem)


def _cond_py(cond: str, stem: str, pstem: str) -> bool:
    if cond == "":
        return True
    if cond == "m>0":
        return _m_py(pstem) > 0
    if cond == "m>1":
        return _m_py(pstem) > 1
    if cond == "*v*":
        return "V" in pstem
    if cond == "ion":
        return _m_py(pstem) > 1 and bool(re.search("[st]$", stem))
    raise ValueError(cond)


def by_last_letter(rules) -> dict[str, tuple]:
    """Rules by the last letter of their suffix, longer suffixes first."""
    found: dict[str, list] = {}
    for rule in sorted(rules, key=lambda x: -len(x[0])):
        found.setdefault(rule[0][-1:], []).append(rule)
    return {letter: tuple(of) for letter, of in found.items()}


_RULES_1A, _RULES_1C, _RULES_2, _RULES_3, _RULES_4 = (by_last_letter(x) for x in (STEP_1A, STEP_1C, STEP_2, STEP_3, STEP_4))


def _rules_py(w: str, rules: dict[str, tuple]) -> str:
    for suffix, repl, cond in rules.get(w[-1:], ()):
        if w.endswith(suffix):
            k = len(w) - len(suffix)
            return w[:k] + repl if cond == "" or _cond_py(cond, w[:k], _cv_py(w)[:k]) else w
    return w


def _step1b_py(w: str) -> str:
    if not w.endswith(("ed", "ing")):
        return w
    p = _cv_py(w)

    def tidy(x: str, px: str) -> str:
        for suffix, repl in STEP_1B_TAILS:
            if x.endswith(suffix):
                return x[: len(x) - len(suffix)] + repl
        if re.search(DOUBLE_CONSONANT, x) and not re.search("[lsz]$", x):
            return x[:-1]
        if _m_py(px) == 1 and _cvc_py(x, px):
            return x + "e"
        return x

    if w.endswith("eed"):
        return w[:-3] + "ee" if _m_py(p[:-3]) > 0 else w
    if w.endswith("ed"):
        return tidy(w[:-2], p[:-2]) if "V" in p[:-2] else w
    if w.endswith("ing"):
        return tidy(w[:-3], p[:-3]) if "V" in p[:-3] else w
    return w


def porter_stem_py(w: str) -> str:
    """Python twin of ``porter_stem`` for a query's own words (same rule tables;
    tests check both agree on a whole corpus vocabulary)."""
    if len(w) < MIN_STEM_LENGTH:
        return w
    s = _rules_py(w, _RULES_1A)
    s = _step1b_py(s)
    s = _rules_py(s, _RULES_1C)
    s = _rules_py(s, _RULES_2)
    s = _rules_py(s, _RULES_3)
    s = _rules_py(s, _RULES_4)
    if s.endswith("e"):
        p = _cv_py(s)
        m = _m_py(p[:-1])
        if m > 1 or (m == 1 and not _cvc_py(s[:-1], p[:-1])):
            s = s[:-1]
    if s.endswith("ll") and _m_py(_cv_py(s)) > 1:
        s = s[:-1]
    return s


def english_lexeme_py(simple: str | None) -> str | None:
    """Python twin of ``english_lexeme``."""
    if simple is None or simple in _STOP_SET:
        return None
    return porter_stem_py(simple)


_STOP_SET = frozenset(ENGLISH_STOP_WORDS)
