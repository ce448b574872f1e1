"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

1. ``quality``        documents the quality classifier rejects go;
2. ``near_dedup``     one document of each group of near copies stays (five-word shingles, 0.8);
3. ``decontaminate``  documents that copy a benchmark item go;
4. ``pii``            personal data is generalised, terms that reveal it are removed;
5. ``bpe``            texts become token ids (decoded again for their digest).

Stages 1 to 4 return the columns of ``documents``; ``n_chars`` follows a rewritten text. Null texts
count as empty and stay null while a document stays; near_dedup keeps one row of each group of copies,
whatever their ids (rows without words are no copies and all stay).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm import decontaminate as leak
from pitchframe.llm import pii, quality_classifier
from pitchframe.llm.bpe import bpe_digests
from pitchframe.llm.common import documents, held_out, labels, materialise
from pitchframe.llm.minhash_dedup import near_duplicates
from pitchframe.operators.relational import first_by_key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = quality_classifier.fit(docs, labels(spark, sf_dir), ~held_out("doc_id", 5, 0))
    return quality_classifier.keep(docs, net)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By row: of equal rows, of copies without an id and of the texts of one id, one row stays."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                   F.xxhash64(F.coalesce("text", F.lit(""))).alias("text"))
    rows = docs.select(key.alias("row"), "text", F.struct(*docs.columns).alias("doc"))
    found = materialise(near_duplicates(rows, width=5, percent=80, id_col="row"), "near")
    kept = found.filter("kept").groupBy(F.col("doc_id").alias("row")).agg(
        F.count("*").alias("n"), F.max("n_shingles").alias("size"))
    rows = rows.join(kept, "row")
    # a text without words is a copy of nothing
    again = (F.col("n") > 1) & (F.col("size") > 0)
    one = first_by_key(rows.filter(again).select("row", "doc"), ["row"])
    return rows.filter(~again).select("doc").unionAll(one.select("doc")).select("doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leak.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("pii", private), ("bpe", bpe)]

#: A trained classifier has no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
