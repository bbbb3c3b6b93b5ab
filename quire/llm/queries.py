"""The registered queries of the llm operators: ``opN_<name>(spark, sf_dir)``.

Each applies its operator with production parameters to its whole table. The
tokenizer vocabulary's path is a parameter of the operators; here it comes from
the installed ``public_tokenizers`` package.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import oracles
from quire.llm.shared import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.quality_attention import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.quality_rules import fit, judge

    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op4_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.token_codes import token_index

    return token_index(table(spark, sf_dir, "documents"), vocabulary())


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.decontaminate import found_items

    return found_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.near_dedup import near_groups

    return near_groups(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"))


def op8_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.katz import katz_scores

    return katz_scores(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.chat import format_conversations

    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return format_conversations(given.unionByName(added))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.prefix_trie import ordered_turns, prefix_trie, rebuilt

    return prefix_trie(*rebuilt(ordered_turns(table(spark, sf_dir, "conversations"))))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.centroids import centroid_clusters

    return centroid_clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_attention": op1_quality_attention,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc": op3_warc,
    "op4_token_codes": op4_token_codes,
    "op5_decontaminate": op5_decontaminate,
    "op6_near_dedup": op6_near_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_katz_scores": op8_katz_scores,
    "op9_chat": op9_chat,
    "op10_mixing": op10_mixing,
    "op11_pii": op11_pii,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_centroids": op13_centroids,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": oracles.WARC,
    "op6_near_dedup": oracles.NEAR_DEDUP,
    "op7_line_dedup": oracles.LINE_DEDUP,
    "op9_chat": oracles.CHAT,
    "op10_mixing": oracles.mixing("documents"),
    "op12_prefix_trie": oracles.PREFIX_TRIE,
    "op13_centroids": oracles.centroids(),
}
