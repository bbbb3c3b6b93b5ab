"""Column functions for the token, word and lexeme contract.

Every function here takes and returns ``Column``s built from
``pyspark.sql.functions`` only, so they stay inside whole-stage codegen and can
be used in ``select``, ``filter`` and higher-order lambdas alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: the text contract (must stay equal to the oracle SQL) ---
# A token is a run of non-blank characters.
TOKEN_PATTERN = r"\S+"
# A token is a word when it holds a letter or a digit.
WORD_CHAR = r"[\p{L}\p{N}]"
# Leading and trailing characters that are neither letters nor digits.
EDGE_PUNCT = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
# The same lexeme read the other way round: from the first to the last letter or
# digit (a leftmost match, linear even on long punctuation runs).
WORD_CORE = r"(?s)[\p{L}\p{N}](?:.*[\p{L}\p{N}])?"
# Blank runs collapsed by the text presenter.
BLANK_RUN = r"\s+"
# Default fragment size: positions of one fragment stay below 16,384.
DEFAULT_MAX_TOKENS = 16_383


def tokens(text: Column) -> Column:
    """All non-blank runs of ``text`` as ``array<string>`` (empty for '')."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0)


def _begins_plain(text: Column, upper: bool = True) -> Column:
    """Whether the first character is an ASCII letter or digit (two comparisons each;
    ranges end before the character that follows them)."""
    ranges = [("a", "{"), ("0", ":"), *([("A", "[")] if upper else [])]
    return reduce(lambda x, y: x | y, [(text >= lo) & (text < hi) for lo, hi in ranges])


def is_word(token: Column) -> Column:
    """True when the token holds at least one letter or digit (most begin with a plain one,
    which needs no pattern)."""
    return _begins_plain(token) | token.rlike(WORD_CHAR)


def simple_lexeme(token: Column) -> Column:
    """Lower-case the token and strip punctuation at both ends.

    Extracting the letter/digit core is linear, whereas replacing
    ``EDGE_PUNCT`` rescans a punctuation run from each of its positions
    (quadratic on junk tokens); both give the same lexeme. A token that begins and ends
    with a plain letter or digit is its own core."""
    low = F.lower(token)
    whole = _begins_plain(low, False) & _begins_plain(F.substring(low, -1, 1), False)
    return F.when(whole, low).otherwise(F.regexp_extract(low, WORD_CORE, 0))


def present_text(text: Column) -> Column:
    """Collapse blank runs into one blank and trim (H6: internal text to readable text)."""
    return F.trim(F.regexp_replace(text, BLANK_RUN, " "))


def first_line(text: Column) -> Column:
    """Text up to the first line feed."""
    return F.substring_index(text, "\n", 1)
