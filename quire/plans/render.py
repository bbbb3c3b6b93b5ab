"""Rendering operations: a book as html with its hits marked (E7), linked
headlines of a result list (E8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.present import clean_content, count_marks, highlight, link_to_file, ordered_terms
from quire.plans.index import TextIndex
from quire.plans.search import file_matches


def file_terms(index: TextIndex, query: str, mode: str = "logical", file_id: int | None = None) -> DataFrame:
    """``(file_id, terms)``: the distinct match texts of each book, longest first."""
    m = file_matches(index, query, mode, file_id)
    if file_id is not None:
        m = m.withColumn("file_id", F.lit(int(file_id)).cast("long"))
    return m.groupBy("file_id").agg(ordered_terms(F.collect_set("term")).alias("terms"))


def render_file(index: TextIndex, query: str, mode: str = "logical", file_id: int | None = None) -> DataFrame:
    """``(file_id, html, n_results)``: content with chapter marks and line
    breaks, every match text marked; ``n_results`` counts the marks.

    A book without matches is rendered unmarked (n_results 0).
    """
    terms = file_terms(index, query, mode, file_id)
    books = index.file_rows(file_id).select("file_id", "content")
    out = books.join(terms, "file_id", "left")
    html = clean_content(F.col("content"))
    html = F.when(F.size(F.coalesce("terms", F.array())) > 0, highlight(F.col("terms"), html)).otherwise(html)
    return out.select("file_id", html.alias("html")).select("file_id", "html", count_marks(F.col("html")).alias("n_results"))


def render_list(results: DataFrame) -> DataFrame:
    """Headlines of a search result with ``<b>`` marks turned into file links."""
    return results.withColumn("headline", link_to_file(F.col("headline"), F.col("file_id")))
