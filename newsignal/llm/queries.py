"""Registered queries of the corpus operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsignal.llm import conversation, decontaminate, language, mainmatter, mixture, negatives, packing, pii, quality, simhash, tokens, toxicity, vectors
from newsignal.sources.tables import read_table


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", ["doc_id", "text"])
    return quality.score(docs, quality.fit(docs, read_table(spark, folder, "labels", ["doc_id", "quality"])))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", ["doc_id", "text"])
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, folder, "labels", ["doc_id", "toxic"])))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(read_table(spark, folder, "documents", ["doc_id", "text"]),
                                read_table(spark, folder, "benchmark", ["item_id", "text"]))


def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages", ["page_id", "url", "html"])
    return mainmatter.extract(pages, mainmatter.fit(pages))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, folder, "documents", ["doc_id", "text"]))


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(read_table(spark, folder, "documents", ["doc_id", "text"]))


def op7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mixed_sizes(read_table(spark, folder, "documents", ["doc_id", "source", "text"]))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(read_table(spark, folder, "documents", ["doc_id", "text"]), tokens.read_vocabulary())


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", ["doc_id", "text", "lang"])
    return language.identify(docs, language.fit(docs))


def op10_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(read_table(spark, folder, "embeddings", ["vec_id", "embedding"]))


def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors_of = read_table(spark, folder, "embeddings", ["vec_id", "embedding", "label"])
    return negatives.report(negatives.mine(negatives.coded(vectors_of, relabel_every=7)))


def op12_conversation(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "conversations", ["conv_id", "turn", "role", "text"])
    return conversation.report(conversation.repair(conversation.damage(rows)))


def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.report(packing.pack(read_table(spark, folder, "documents", ["doc_id", "text"])))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": decontaminate.ORACLE, "op7_mixture": mixture.ORACLE,
            "op10_vectors": vectors.ORACLE, "op11_negatives": negatives.ORACLE,
            "op12_conversation": conversation.ORACLE}
