"""Exact sets of integer ids as bitmaps: distinct counts and membership flags.

An id falls into a bucket of 32,768 neighbouring ids and sets one bit of the bucket's bitmap.
Building one is a partial aggregate: each task sends at most one 4 KB bitmap per (group, bucket), however
often an id stands, and bitmaps of one bucket merge by OR. A lookup set of a billion neighbouring ids
takes some 125 MB, a row per bucket. Meant for ids that lie close together, as the ids of matches and
events do; for ids scattered over 64 bits (a bitmap each) use the joins and counts of ``relational``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import col

#: Stands for null ids in a join (buckets of 64-bit ids lie within 2**48 of zero).
NULL_BUCKET = -(1 << 62)


def bucket(c: str | Column) -> Column:
    return F.bitmap_bucket_number(col(c).cast("bigint"))


def bits(c: str | Column) -> Column:
    """The aggregate that gathers the ids of one bucket (nulls set no bit)."""
    return F.bitmap_construct_agg(F.bitmap_bit_position(col(c).cast("bigint")))


def n_in_buckets(bucket_col: str, bits_col: str) -> Column:
    """``n_distinct`` over a group's buckets: the bits set, and one more for null ids (the null bucket)."""
    return F.sum(F.when(F.col(bucket_col).isNull(), F.lit(1)).otherwise(F.bitmap_count(F.col(bits_col))))


def distinct_ids(df: DataFrame, group: Sequence[str], c: str, out: str) -> DataFrame:
    """``n_distinct(id)`` per group (null counts as one more value), by bitmaps."""
    sets = df.groupBy(*group, bucket(c).alias("_bucket")).agg(bits(c).alias("_bits"))
    return sets.groupBy(*group).agg(n_in_buckets("_bucket", "_bits").alias(out))


def _holds(bitmap: Column, position: Column) -> Column:
    """The bit at ``position`` of a bitmap, as a condition."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) != 0


def _join_key(c: str) -> Column:
    """The bucket, null ids in one of their own that no id falls into. Never null, so that the join is a plain
    equality with one row per key on the lookup side, which Spark leaves out where nobody reads the flag."""
    return F.coalesce(bucket(c), F.lit(NULL_BUCKET))


def flag_in_bitmap(df: DataFrame, lookup: DataFrame, on: tuple[str, str] | str, flag: str,
                   null_safe: bool = False) -> DataFrame:
    """``x %in% lookup$y`` for an integer id, as a boolean column (never null).

    The join key is the bucket, so the lookup side is a row per bucket; ``null_safe`` lets a null id be a
    member when the lookup has one, as the original's membership test does.
    """
    left, right = (on, on) if isinstance(on, str) else on
    sets = lookup.groupBy(_join_key(right).alias("_bucket")).agg(bits(right).alias("_bits"))
    joined = df.withColumn("_own", _join_key(left)).join(sets, F.col("_own") == F.col("_bucket"), "left")
    member = _holds(F.col("_bits"), F.bitmap_bit_position(F.col(left).cast("bigint")))
    member = F.when(F.col(left).isNull(), F.col("_bits").isNotNull() & F.lit(null_safe)).otherwise(member)
    return joined.withColumn(flag, F.coalesce(member, F.lit(False))).drop("_own", "_bucket", "_bits")
