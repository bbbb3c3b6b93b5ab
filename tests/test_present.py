"""Presentation cases (FIXTURES.md): term order, chapter marks, hit marks, links, counts."""

from pyspark.sql import functions as F

from quire.functions.present import clean_content, count_marks, highlight, link_to_file, ordered_terms
from quire.functions.text import present_text


def one(spark, col, schema, row):
    return spark.createDataFrame([row], schema).select(col.alias("x")).first().x


def test_terms_ordered(spark):
    got = one(spark, ordered_terms(F.col("t")), "t array<string>", (["sea", "old man", "sea", None],))
    assert got == ["old man", "sea"]


def test_clean_content(spark):
    text = "\nChapter I\r\n\r\nx"
    got = one(spark, clean_content(F.col("c")), "c string", (text,))
    assert got == "<div class='chapter-title'>\nChapter I\r</div>\n&nbsp;<br>&nbsp;<br>\nx"
    got = one(spark, clean_content(F.col("c")), "c string", ("a\nCHAPTER II\nb",))
    assert got == "a<div class='chapter-title'>\nCHAPTER II</div>\nb"
    # the blank after the word follows JavaScript's class: a no-break space counts
    nbsp = "a\nchapter\u00a0III\nb"
    got = one(spark, clean_content(F.col("c")), "c string", (nbsp,))
    assert got == "a<div class='chapter-title'>\nchapter\u00a0III</div>\nb"


def test_highlight(spark):
    got = one(spark, highlight(F.col("t"), F.col("c")), "t array<string>, c string", (["cat"], "a category"))
    assert got == "a <span class='search-result'>cat</span> egory"
    # not marked at the very start (no leading blank), all other occurrences are
    got = one(spark, highlight(F.col("t"), F.col("c")), "t array<string>, c string", (["cat"], "cat and cat"))
    assert got == "cat and <span class='search-result'>cat</span> "
    assert one(spark, count_marks(F.col("c")), "c string", (got,)) == 1


def test_link_and_present(spark):
    assert one(spark, link_to_file(F.col("h"), F.lit(7)), "h string", ("<b>x</b>",)) == (
        "<a class='file-link' href='#file/7'>x</a>"
    )
    assert one(spark, link_to_file(F.col("h"), F.lit(7)), "h string", (None,)) is None
    assert one(spark, present_text(F.col("h")), "h string", ("  a \n\t b  ",)) == "a b"


def test_highlight_marks_again_inside_marks(spark):
    # terms are folded longest first; a shorter term then matches inside the
    # first mark (the text " man" follows "old" there)
    terms = one(spark, ordered_terms(F.col("t")), "t array<string>", (["man", "old man"],))
    got = one(spark, highlight(F.col("t"), F.col("c")), "t array<string>, c string", (terms, "an old man"))
    assert got == (
        "an <span class='search-result'>old <span class='search-result'>man</span> </span> "
    )
