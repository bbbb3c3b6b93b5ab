"""Read the driver tables as the ``files`` relation of the search engine."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import first_line

FILES_COLUMNS = ("file_id", "filename", "title", "author", "content")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def files_from_documents(documents: DataFrame) -> DataFrame:
    """Map ``documents(doc_id, text, source, ...)`` to ``files``.

    ``file_id = doc_id``, ``filename = source/doc_id.txt``, ``title`` = first line
    of the text, ``author = source``, ``content = text``.
    """
    return documents.select(
        F.col("doc_id").cast("long").alias("file_id"),
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        first_line(F.col("text")).alias("title"),
        F.col("source").alias("author"),
        F.col("text").alias("content"),
    )


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``files`` relation of a driver scale-factor directory."""
    return files_from_documents(table(spark, sf_dir, "documents"))
