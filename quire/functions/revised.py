"""The ``english_revised`` configuration: the revised English stemmer ("Porter2", as
published with the Snowball language before its version 3) with its stop list, as
built-in Column expressions (no UDF). ``english`` (``quire.functions.stem``) stays the
1980 stemmer with the longer stop list.

Suffixes are judged by where they begin: R1 is what follows the first non-vowel after
a vowel, R2 the same again inside R1. Both are computed once per word, as the numbers
of characters before them, and stay fixed while the word is cut. Every step binds its
input through a lambda variable, so the expression grows linearly with the steps. Index
builds stem each distinct word once (the vocabulary job in ``quire.operators.analyze``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.stem import ENGLISH_STOP_WORDS, by_last_letter

# The stop list ends at "now": the words Spark's list adds after it are not in it (127 words).
STOP_WORDS = ENGLISH_STOP_WORDS[: ENGLISH_STOP_WORDS.index("now") + 1]

# --- Fixed values: whole words with a stem of their own, and words left as they are.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias",
    "andes": "andes",
}
# Words that are done after step 1a.
DONE_AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
# R1 begins after these openings.
R1_OPENINGS = "^(gener|commun|arsen)"

# --- Fixed values: suffix rules (suffix, replacement, condition). "r1" / "r2": the suffix
# begins in that region; after a colon: the letters one of which must stand before it.
STEP_0 = (("'s'", "", ""), ("'s", "", ""), ("'", "", ""))
STEP_2 = (
    ("tional", "tion", "r1"), ("enci", "ence", "r1"), ("anci", "ance", "r1"), ("abli", "able", "r1"),
    ("entli", "ent", "r1"), ("izer", "ize", "r1"), ("ization", "ize", "r1"), ("ational", "ate", "r1"),
    ("ation", "ate", "r1"), ("ator", "ate", "r1"), ("alism", "al", "r1"), ("aliti", "al", "r1"),
    ("alli", "al", "r1"), ("fulness", "ful", "r1"), ("ousli", "ous", "r1"), ("ousness", "ous", "r1"),
    ("iveness", "ive", "r1"), ("iviti", "ive", "r1"), ("biliti", "ble", "r1"), ("bli", "ble", "r1"),
    ("ogi", "og", "r1:l"), ("fulli", "ful", "r1"), ("lessli", "less", "r1"), ("li", "", "r1:cdeghkmnrt"),
)
STEP_3 = (
    ("tional", "tion", "r1"), ("ational", "ate", "r1"), ("alize", "al", "r1"), ("icate", "ic", "r1"),
    ("iciti", "ic", "r1"), ("ical", "ic", "r1"), ("ful", "", "r1"), ("ness", "", "r1"), ("ative", "", "r2"),
)
STEP_4 = (
    ("al", "", "r2"), ("ance", "", "r2"), ("ence", "", "r2"), ("er", "", "r2"), ("ic", "", "r2"),
    ("able", "", "r2"), ("ible", "", "r2"), ("ant", "", "r2"), ("ement", "", "r2"), ("ment", "", "r2"),
    ("ent", "", "r2"), ("ism", "", "r2"), ("ate", "", "r2"), ("iti", "", "r2"), ("ous", "", "r2"),
    ("ive", "", "r2"), ("ize", "", "r2"), ("ion", "", "r2:st"),
)
VOWEL = "[aeiouy]"
REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"  # up to the first non-vowel after a vowel
SHORT_END = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
DOUBLE_END = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
ADD_E_END = "(at|bl|iz)$"
MIN_LENGTH = 3  # shorter words are left as they are


def _bind(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value`` (evaluated once, referenced freely)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cut(w: Column, k: int) -> Column:
    return w.substr(F.lit(1), F.length(w) - k)


def marked(w: Column) -> Column:
    """No leading apostrophe; ``Y`` for a ``y`` that opens the word or follows a vowel."""
    w = F.regexp_replace(w, "^'", "")
    return F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiouy])y", "$1Y")


def regions(w: Column) -> Column:
    """``struct(r1, r2)``: how many characters of a marked word stand before R1 and R2."""
    def after(text: Column, pattern: str) -> Column:
        return F.length(F.regexp_extract(text, pattern, 0))

    def begin(text: Column) -> Column:
        return F.when(text.rlike(REGION), after(text, REGION)).otherwise(F.length(text))

    r1 = F.when(w.rlike(R1_OPENINGS), after(w, R1_OPENINGS)).otherwise(begin(w))
    return _bind(r1, lambda a: F.struct(a.alias("r1"), (a + begin(w.substr(a + 1, F.length(w)))).alias("r2")))


def _holds(cond: str, stem: Column, r: Column) -> Column:
    region, _, letters = cond.partition(":")
    ok = F.length(stem) >= r[region] if region else F.lit(True)
    return ok & stem.rlike(f"[{letters}]$") if letters else ok


def _rules(rules):
    """The longest suffix decides; where its condition fails the word stays."""

    def step(w: Column, r: Column) -> Column:
        out = F
        for suffix, repl, cond in sorted(rules, key=lambda x: -len(x[0])):
            stem = _cut(w, len(suffix))
            out = out.when(w.endswith(suffix), F.when(_holds(cond, stem, r), F.concat(stem, F.lit(repl))).otherwise(w))
        return out.otherwise(w)

    return step


def _step_1a(w: Column, r: Column) -> Column:
    short = F.length(w) <= 4
    return (
        F.when(w.endswith("sses"), _cut(w, 2))
        .when(w.endswith("ied") | w.endswith("ies"), F.when(short, _cut(w, 1)).otherwise(_cut(w, 2)))
        .when(w.endswith("us") | w.endswith("ss"), w)
        .when(w.endswith("s") & _cut(w, 2).rlike(VOWEL), _cut(w, 1))
        .otherwise(w)
    )


def _step_1b(w: Column, r: Column) -> Column:
    def tidy(x: Column) -> Column:
        return (
            F.when(x.rlike(ADD_E_END), F.concat(x, F.lit("e")))
            .when(x.rlike(DOUBLE_END), _cut(x, 1))
            .when((F.length(x) == r["r1"]) & x.rlike(SHORT_END), F.concat(x, F.lit("e")))
            .otherwise(x)
        )

    out = F
    for k, suffix in ((5, "eedly"), (3, "eed")):
        out = out.when(w.endswith(suffix), F.when(F.length(w) - k >= r["r1"], F.concat(_cut(w, k), F.lit("ee"))).otherwise(w))
    for k, suffix in ((5, "ingly"), (4, "edly"), (3, "ing"), (2, "ed")):
        out = out.when(w.endswith(suffix), F.when(_cut(w, k).rlike(VOWEL), _bind(_cut(w, k), tidy)).otherwise(w))
    return out.otherwise(w)


def _step_1c(w: Column, r: Column) -> Column:
    return F.when(w.rlike("(?s)^.+[^aeiouy][yY]$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _step_5(w: Column, r: Column) -> Column:
    stem = _cut(w, 1)
    far, near = F.length(stem) >= r["r2"], F.length(stem) >= r["r1"]
    drop = (w.endswith("e") & (far | (near & ~stem.rlike(SHORT_END)))) | (w.endswith("ll") & far)
    return F.when(drop, stem).otherwise(w)


def _then(w: Column, r: Column, steps) -> Column:
    for step in steps:
        w = _bind(w, lambda x: step(x, r))  # noqa: B023 (called at once)
    return w


def revised_stem(w: Column) -> Column:
    """Stem of a lower-case word by the revised English rules, as one Column."""

    def stemmed(m: Column) -> Column:
        def within(r: Column) -> Column:
            def rest(x: Column) -> Column:
                return F.when(x.isin(*DONE_AFTER_1A), x).otherwise(
                    _then(x, r, (_step_1b, _step_1c, _rules(STEP_2), _rules(STEP_3), _rules(STEP_4), _step_5))
                )

            return _bind(_then(m, r, (_rules(STEP_0), _step_1a)), rest)

        return _bind(regions(m), within)

    special = F.create_map(*[F.lit(x) for pair in SPECIAL.items() for x in pair])
    whole = F.replace(_bind(marked(w), stemmed), F.lit("Y"), F.lit("y"))
    return F.when(F.length(w) < MIN_LENGTH, w).when(w.isin(*SPECIAL), special[w]).otherwise(whole)


def revised_lexeme(simple: Column) -> Column:
    """Stem of a simple lexeme; null for a stop word (its position stays taken)."""
    return F.when(simple.isin(list(STOP_WORDS)), F.lit(None).cast("string")).otherwise(revised_stem(simple))


# --- the same rules for the query's own words (driver side, a handful of words) ---
def _begin_py(w: str) -> int:
    m = re.match(REGION, w)
    return m.end() if m else len(w)


_RULES_0, _RULES_2, _RULES_3, _RULES_4 = (by_last_letter(x) for x in (STEP_0, STEP_2, STEP_3, STEP_4))


def _rules_py(w: str, rules: dict[str, tuple], r: dict) -> str:
    for suffix, repl, cond in rules.get(w[-1:], ()):
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            region, _, letters = cond.partition(":")
            ok = (not region or len(stem) >= r[region]) and (not letters or stem[-1:] in tuple(letters))
            return stem + repl if ok else w
    return w


def _step_1a_py(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-1] if len(w) <= 4 else w[:-2]
    if w.endswith("s") and not w.endswith(("us", "ss")) and re.search(VOWEL, w[:-2]):
        return w[:-1]
    return w


def _step_1b_py(w: str, r1: int) -> str:
    for suffix in ("eedly", "eed"):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + "ee" if len(stem) >= r1 else w
    for suffix in ("ingly", "edly", "ing", "ed"):
        if w.endswith(suffix):
            x = w[: -len(suffix)]
            if not re.search(VOWEL, x):
                return w
            if re.search(ADD_E_END, x):
                return x + "e"
            if re.search(DOUBLE_END, x):
                return x[:-1]
            return x + "e" if len(x) == r1 and re.search(SHORT_END, x) else x
    return w


def revised_stem_py(word: str) -> str:
    """Python twin of ``revised_stem`` for a query's own words (same tables; tests check
    both agree on a whole corpus vocabulary)."""
    if len(word) < MIN_LENGTH:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.removeprefix("'")
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", w))
    opening = re.match(R1_OPENINGS, w)
    r = {"r1": opening.end() if opening else _begin_py(w)}
    r["r2"] = r["r1"] + _begin_py(w[r["r1"] :])
    w = _step_1a_py(_rules_py(w, _RULES_0, r))
    if w not in DONE_AFTER_1A:
        w = _step_1b_py(w, r["r1"])
        if re.search(r"(?s)^.+[^aeiouy][yY]\Z", w):
            w = w[:-1] + "i"
        for rules in (_RULES_2, _RULES_3, _RULES_4):
            w = _rules_py(w, rules, r)
        stem = w[:-1]
        if w.endswith("e"):
            if len(stem) >= r["r2"] or (len(stem) >= r["r1"] and not re.search(SHORT_END, stem)):
                w = stem
        elif w.endswith("ll") and len(stem) >= r["r2"]:
            w = stem
    return w.replace("Y", "y")


def revised_lexeme_py(simple: str | None) -> str | None:
    """Python twin of ``revised_lexeme``."""
    return None if simple is None or simple in STOP_WORDS else revised_stem_py(simple)
