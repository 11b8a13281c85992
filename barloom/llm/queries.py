"""The queries of this subpackage over the given tables, with their SQL where one exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import (
    chat_parts, cotraining, decontamination, language_id, lexical_search, mixing, secret_ledger, simhash_bk, structure_repair, suffix_dedup, toxicity,
    warc_zip, winnowing,
)
from barloom.llm._common import table


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(table(spark, sf_dir, "pages"))


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.report(table(spark, sf_dir, "documents"))


def op3_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_parts.conversation_digests(table(spark, sf_dir, "conversations"))


def op5_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_bk.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_bk.fingerprint_hex().alias("fingerprint"), found.component.alias("component_id"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edit_report(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.report(structure_repair.damage(table(spark, sf_dir, "conversations")), copies="copies")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_zip, op2_secret_ledger, op3_mix_to_weights, op4_chat_parts, op5_cotraining_quality,
        op6_simhash_bk_trees, op7_winnowing, op8_benchmark_decontamination, op9_ordinal_toxicity, op10_suffix_dedup,
        op11_ranked_search, op12_structure_repair, op13_language_id,
    )
}
ORACLES = {"op2_secret_ledger": secret_ledger.ORACLE, "op3_mix_to_weights": mixing.ORACLE, "op11_ranked_search": lexical_search.ORACLE}
