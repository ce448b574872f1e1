"""Helpers the operators of this subpackage share: narrow input, shared intermediate tables."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only: whatever else the table holds cannot clash; a null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, as the contracts ask (other letters stay as they are)."""
    return F.translate(col, UPPER, UPPER.lower())


def held_out(id_col: str, mod: int, rest: int) -> Column:
    """True where crc32 of the id as text leaves ``rest``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == rest, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir`` of the session.

    Only a local (test) session that names none gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pitchframe-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read from there.

    Cuts the lineage: a lost executor costs the reread of a file, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(key: tuple, build: Callable[[], Any]) -> Any:
    """An object that a Python worker builds once and keeps between tasks (a tokenizer, its caches); of
    objects whose keys begin alike, the last one.

    Functions of this subpackage travel by value, so their module globals are new in every task; the
    object is held in a module of its own instead. What it holds must be bounded and rebuildable.
    """
    store = sys.modules.setdefault("_pitchframe_kept", types.ModuleType("_pitchframe_kept")).__dict__
    if key[0] not in store or store[key[0]][0] != key:
        store.pop(key[0], None)
        store[key[0]] = (key, build())
    return store[key[0]][1]
