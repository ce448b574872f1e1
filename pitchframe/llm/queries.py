"""Registered queries of the numbered operators, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from pitchframe.llm import language_id, lexical_search, pii, quality_classifier, toxicity, va_search, whitening
from pitchframe.llm.bpe import bpe_digests
from pitchframe.llm.common import documents, embeddings, held_out, labels
from pitchframe.llm.decontaminate import leaks
from pitchframe.llm.license_scan import license_scan
from pitchframe.llm.minhash_dedup import near_duplicates
from pitchframe.llm.oracle import op5_sql, op7_sql, op9_sql, op12_sql, op13_sql
from pitchframe.llm.quality_rules import quality_rules
from pitchframe.llm.token_shards import token_shards


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, labels(spark, sf_dir), ~held_out("doc_id", 3, 1))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted", "n_hits")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                       public_tokenizers.PATTERN)


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    langs, matrix = language_id.fit(docs.filter(~held_out("doc_id", 4, 2)))
    scored = language_id.score(docs, langs, matrix)
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir)).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = quality_classifier.fit(docs, labels(spark, sf_dir), ~held_out("doc_id", 5, 0))
    scored = quality_classifier.score(docs, net)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir), components=32).withColumn("deviation", F.col("deviation").cast("long"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_search.search(embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0, k=5, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe": op2_bpe,
    "op3_token_shards": op3_token_shards,
    "op4_decontaminate": op4_decontaminate,
    "op5_license_scan": op5_license_scan,
    "op6_language_id": op6_language_id,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_pii": op8_pii,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_whitening": op11_whitening,
    "op12_lexical_search": op12_lexical_search,
    "op13_exact_search": op13_exact_search,
}

ORACLE_SQL: dict[str, str] = {
    "op5_license_scan": op5_sql(),
    "op7_minhash_near_dedup": op7_sql(width=3, percent=85),
    "op9_quality_rules": op9_sql(),
    "op12_lexical_search": op12_sql(),
    "op13_exact_search": op13_sql(),
}
