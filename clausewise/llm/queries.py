"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.llm import bm25, decontam, html, langid, mixing, negatives, quality, sharding, simhash, substring, tokens, toxicity, trie
from clausewise.llm.common import fold, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held_out(3, 1), "score", "predicted")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.quotas(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.scan(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25.search(docs, docs.where("doc_id % 100 = 0"), k=10)


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out(5, 0), "score", "predicted", F.size("spans").alias("n_spans"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold(F.col("doc_id"), 4) != 2)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(4, 2), "lang_pred", "score", "rejected")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"), "embedding")
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.branched(trie.turns(table(spark, sf_dir, "conversations"))))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def held_out(n: int, k: int):
    return (fold(F.col("doc_id"), n) == k).alias("held_out")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_simhash, op3_sharding, op4_mixing, op5_html, op6_decontamination, op7_bm25, op8_tokens, op9_toxicity, op10_language, op11_negatives, op12_trie, op13_substrings)}


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": decontam.ORACLE, "op11_negatives": negatives.ORACLE, "op12_trie": trie.ORACLE, "op13_substrings": substring.ORACLE}
