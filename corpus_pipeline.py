"""A corpus pipeline of five stages, each an operator of ``quire.llm``.

Quality rules -> near-duplicates -> benchmark decontamination -> mixing -> token ids.
Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it
as Parquet in the shared folder and rereads it as the next stage's ``docs``. All but
the last return the columns of ``documents``; the last returns the token index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import run_folder, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; the trees learn from the labels of ``docs``."""
    from quire.llm.quality_rules import fit, kept_documents

    return kept_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


def _keyed(spark: SparkSession, docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows under a key of their own, pinned in the shared folder: (row, doc) with all
    columns in ``doc``, and (doc_id = row, text) for the operators. So null and repeated
    doc_ids are documents like others, and no column name can clash."""
    x = docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc"))
    x = written(x, run_folder(spark, f"pipeline-{name}"))
    return x, x.select(F.col("row").alias("doc_id"), "doc.text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 80 percent): that of the
    smallest doc_id (null last)."""
    from quire.llm.near_dedup import near_groups

    keyed, texts = _keyed(spark, docs, "near")
    groups = near_groups(texts, shingle=5, percent=80).select(F.col("doc_id").alias("row"), "component_id")
    id_ = F.col("doc.doc_id")
    ranked = groups.join(keyed.select("row", F.struct(id_.isNull().alias("none"), id_.alias("id"), "row").alias("rank")), "row")
    kept = ranked.groupBy("component_id").agg(F.min("rank").alias("first")).select("first.row")
    return keyed.join(kept, "row", "left_semi").select("doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found (items of a null id count too)."""
    from quire.llm.decontaminate import found_items

    keyed, texts = _keyed(spark, docs, "clean")
    items = table(spark, sf_dir, "benchmark").select(F.monotonically_increasing_id().alias("item_id"), "text")
    found = found_items(texts, items).select(F.col("doc_id").alias("row")).distinct()
    return keyed.join(found, "row", "left_anti").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that source, language and topic meet their targets."""
    from quire.llm.mixing import sampled_documents

    return sampled_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and their index."""
    from quire.llm.queries import vocabulary
    from quire.llm.token_codes import token_index

    return token_index(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token ids", token_ids),
]

#: Trees, sketches and the tokenizer are not SQL; tests/llm/test_pipeline.py checks
#: the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = run_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return docs
