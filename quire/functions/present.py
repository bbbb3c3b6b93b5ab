"""Presentation Columns: term order, chapter marks, hit marks, file links, counts.

Each mirrors a client-side text step of the reference as a built-in Column
expression, so a whole corpus can be rendered in one distributed pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: markup of the rendered text ---
# The client regex class \s follows JavaScript: ASCII blanks plus Unicode spaces.
JS_SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CHAPTER_LINE = r"\n[Cc][Hh][Aa][Pp][Tt][Ee][Rr]" + JS_SPACE + r"[^\n]+"
CHAPTER_OPEN = "<div class='chapter-title'>"
CHAPTER_CLOSE = "</div>"
BLANK_LINE = "\n\r"
BLANK_LINE_HTML = "\n&nbsp;<br>&nbsp;<br>"
RESULT_OPEN = " <span class='search-result'>"
RESULT_CLOSE = "</span> "
RESULT_MARK = "<span class='search-result'>"
LINK_OPEN_HEAD = "<a class='file-link' href='#file/"
LINK_OPEN_TAIL = "'>"
LINK_CLOSE = "</a>"


def ordered_terms(terms: Column) -> Column:
    """Distinct non-null terms, longest first (ties by text): ``array<string>``."""
    keyed = F.transform(F.array_distinct(F.filter(terms, lambda t: t.isNotNull())),
                        lambda t: F.struct((-F.length(t)).alias("k"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])


def clean_content(content: Column) -> Column:
    """Wrap chapter lines in a div, turn blank lines into html breaks."""
    marked = F.regexp_replace(content, CHAPTER_LINE, CHAPTER_OPEN + "$0" + CHAPTER_CLOSE)
    return F.replace(marked, F.lit(BLANK_LINE), F.lit(BLANK_LINE_HTML))


def highlight(terms: Column, content: Column) -> Column:
    """Fold over ``terms`` (already ordered): every `` term`` becomes a
    search-result span (literal, case-sensitive, all occurrences)."""
    return F.aggregate(
        terms,
        content,
        lambda acc, t: F.replace(
            acc, F.concat(F.lit(" "), t), F.concat(F.lit(RESULT_OPEN), F.trim(t), F.lit(RESULT_CLOSE))
        ),
    )


def count_marks(html: Column, mark: str = RESULT_MARK) -> Column:
    """Number of (non-overlapping) occurrences of ``mark`` in ``html``."""
    return ((F.length(html) - F.length(F.replace(html, F.lit(mark), F.lit("")))) / len(mark)).cast("long")


def link_to_file(headline: Column, file_id: Column) -> Column:
    """``<b>`` -> file link anchor, ``</b>`` -> ``</a>``; null stays null."""
    opened = F.replace(
        headline, F.lit("<b>"), F.concat(F.lit(LINK_OPEN_HEAD), file_id.cast("string"), F.lit(LINK_OPEN_TAIL))
    )
    return F.replace(opened, F.lit("</b>"), F.lit(LINK_CLOSE))
