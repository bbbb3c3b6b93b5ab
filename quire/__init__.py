"""quire: full-text search over large books on Spark DataFrames.

Books are cut into position-indexed fragments with a lexeme postings table;
phrase and boolean queries (AND / OR / NOT / word distance) are answered with
ranked, highlighted headlines, match lists and rendered documents.
"""

from quire.operators.query import compile_query
from quire.plans.index import TextIndex
from quire.plans.search import file_contents, file_matches, search_files

__all__ = ["TextIndex", "compile_query", "file_contents", "file_matches", "search_files"]
