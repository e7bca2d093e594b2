"""The operators as queries over the supplied tables, and the SQL that some of them must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagequarry.llm import (
    byte_pairs, chat, compression, decontaminate, fuzzy_lines, licences, merkle, mixing, quality_rules, ranked_search, simhash, toxicity, warc,
)
from pagequarry.llm.common import table


def op1_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity_query(table(spark, d, "documents"), table(spark, d, "labels"))


def op2_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(table(spark, d, "documents"))


def op3_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.rules_query(table(spark, d, "documents"))


def op4_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.simhash_query(table(spark, d, "documents"))


def op5_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op6_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    return compression.quality_query(table(spark, d, "documents"), table(spark, d, "labels"))


def op7_licences(spark: SparkSession, d: str) -> DataFrame:
    return licences.scan(table(spark, d, "documents"))


def op8_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.warc_query(table(spark, d, "pages"))


def op9_fuzzy_lines(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy_lines.lines_query(table(spark, d, "documents"))


def op10_chat(spark: SparkSession, d: str) -> DataFrame:
    return chat.chat_query(table(spark, d, "conversations"))


def op11_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    return merkle.merkle_query(table(spark, d, "documents"))


def op12_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    return byte_pairs.tokens_query(table(spark, d, "documents"), byte_pairs.public_vocabulary(spark))


def op13_ranked_search(spark: SparkSession, d: str) -> DataFrame:
    return ranked_search.search_query(table(spark, d, "documents"), table(spark, d, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_mixing, op3_quality_rules, op4_simhash, op5_decontamination, op6_quality_classifier, op7_licences, op8_warc,
    op9_fuzzy_lines, op10_chat, op11_merkle_manifest, op12_byte_bpe, op13_ranked_search,
)}
ORACLES = {
    "op2_mixing": mixing.ORACLE, "op3_quality_rules": quality_rules.ORACLE, "op8_warc": warc.ORACLE, "op10_chat": chat.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE, "op13_ranked_search": ranked_search.ORACLE,
}
