"""Relational building blocks shared by the analytics.

All of them are plain DataFrame compositions, chosen so that a hot key (one match,
team or event holding a large share of the rows) is reduced by a map-side partial
aggregate or split by adaptive skew handling instead of landing whole in one task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import asc_last, col


def first_row(df: DataFrame, columns: Sequence[str]) -> Column:
    """An aggregate: the smallest row in ``columns`` (each ascending, nulls last), as a struct of them."""
    nullable = {f.name: f.nullable for f in df.schema.fields}
    marks = {c: f"null {i}" for i, c in enumerate(columns) if nullable[c]}
    packed = F.struct(*[x for c in columns for x in
                        ([F.col(c).isNull().alias(marks[c])] if c in marks else []) + [F.col(c).alias(c)]])
    return F.min(packed)


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str] | None = None) -> DataFrame:
    """``distinct(key, .keep_all = TRUE)``: one row per key, the first in ``order``.

    The original keeps the first row in unspecified database order; here the order is
    explicit (default: every non-key column ascending, nulls last), so ties can only be
    between rows that are identical in every output column. In the default order the first
    row is the minimum of one packed key (``first_row``), a partial aggregate, so a key repeated
    in many rows sends at most one row per input partition across the network; another order
    takes ``row_number() == 1``, planned as a group limit before the shuffle.
    """
    keys = list(keys)
    if order is None:
        rest = [c for c in df.columns if c not in keys]
        if not rest:
            return df.distinct()
        return df.groupBy(*keys).agg(first_row(df, rest).alias("_first")) \
            .select(*[F.col("_first")[c].alias(c) if c in rest else F.col(c) for c in df.columns])
    order = [asc_last(o) if isinstance(o, str) else o for o in order]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def _key_condition(pairs, null_safe: bool) -> Column:
    eq = [(F.col(left).eqNullSafe(F.col(f"_k{i}")) if null_safe else F.col(left) == F.col(f"_k{i}"))
          for i, (left, _) in enumerate(pairs)]
    return reduce(lambda a, b: a & b, eq)


def flag_in(df: DataFrame, lookup: DataFrame, on: Sequence[tuple[str, str]] | Sequence[str],
            flag: str, null_safe: bool = False) -> DataFrame:
    """``x %in% lookup$y`` as a boolean column (never null).

    ``lookup`` is reduced to its distinct keys first, so the left join cannot fan out.
    ``on`` holds column names shared by both sides, or (left, right) name pairs.
    ``null_safe`` lets a null key match a null key (as the original's membership tests and joins do);
    it is still planned as a hash join on (is-null, value) keys.
    """
    pairs = [(c, c) if isinstance(c, str) else c for c in on]
    keys = lookup.select(*[F.col(r).alias(f"_k{i}") for i, (_, r) in enumerate(pairs)]).distinct() \
        .withColumn(flag, F.lit(True))
    joined = df.join(keys, on=_key_condition(pairs, null_safe), how="left")
    return joined.drop(*[f"_k{i}" for i in range(len(pairs))]) \
        .withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def semi_join(df: DataFrame, lookup: DataFrame, on: Sequence[tuple[str, str]] | Sequence[str],
              null_safe: bool = False) -> DataFrame:
    """Rows of ``df`` whose key appears in ``lookup`` (``filter(x %in% lookup$y)``)."""
    pairs = [(c, c) if isinstance(c, str) else c for c in on]
    keys = lookup.select(*[F.col(r).alias(f"_k{i}") for i, (_, r) in enumerate(pairs)])
    return df.join(keys, on=_key_condition(pairs, null_safe), how="left_semi")


def top_k(df: DataFrame, k: int, order: Sequence[Column], tiebreak: Sequence[str] = ()) -> DataFrame:
    """``arrange(...) |> slice_head(n = k)``: global top-k, ties broken by ``tiebreak``
    ascending (the original's stable sort over key-sorted group output). Planned as a
    take-ordered: each partition keeps k rows, one task merges k x partitions rows."""
    return df.orderBy(*order, *[asc_last(c) for c in tiebreak]).limit(k)


def in_rank_order(top: DataFrame, order: Sequence[Column], tiebreak: Sequence[str] = ()) -> DataFrame:
    """Put a top-k result (at most k rows, e.g. after joining names to it) back in rank
    order: the k rows are moved into one partition and sorted there. (A shuffle of k rows,
    not ``coalesce(1)``, which would also run the stage above it in a single task.)"""
    return top.repartition(1).sortWithinPartitions(*order, *[asc_last(c) for c in tiebreak])


def top_k_per_group(df: DataFrame, group: Sequence[str], k: int, order: Sequence[Column],
                    tiebreak: Sequence[str] = (), rank_col: str = "rank") -> DataFrame:
    """Top-k inside each group, numbered 1..k in ``rank_col``."""
    w = Window.partitionBy(*group).orderBy(*order, *[asc_last(c) for c in tiebreak])
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def share_of_group(value: str | Column, group: Sequence[str]) -> Column:
    """``x / sum(x) * 100`` within a group of already-aggregated rows."""
    return F.try_divide(col(value), F.sum(col(value)).over(Window.partitionBy(*group))) * F.lit(100.0)


def share_of_total(value: str | Column) -> Column:
    """``x / sum(x) * 100`` over all rows of an already-aggregated frame.

    Only used on aggregates whose row count is fixed by the domain (outcomes, bins,
    zones, lines), so the frame-wide window sees a handful of rows."""
    return F.try_divide(col(value), F.sum(col(value)).over(Window.partitionBy())) * F.lit(100.0)


def fraction_of_total(value: str | Column) -> Column:
    """``x / sum(x)`` over all rows of an already-aggregated, domain-bounded frame."""
    return F.try_divide(col(value), F.sum(col(value)).over(Window.partitionBy()))


def any_column_matches(df: DataFrame, prefix_regex: str, pattern: str) -> Column:
    """``if_any(columns matching prefix_regex, str_detect(.x, pattern))`` (Kleene OR)."""
    cols = [c for c in df.columns if re.search(prefix_regex, c)]
    if not cols:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.col(c).rlike(pattern) for c in cols])


def split_typed(c: str | Column, sep: str, names: Sequence[str], dtype: str = "int") -> list[Column]:
    """``separate(col, into = names, sep, convert = TRUE)``: missing pieces are null,
    extra pieces are dropped, pieces that do not parse as ``dtype`` are null."""
    parts = F.split(col(c), re.escape(sep))
    return [F.nullif(F.try_element_at(parts, F.lit(i + 1)), F.lit("")).try_cast(dtype).alias(n)
            for i, n in enumerate(names)]


def stack_rows(df: DataFrame, rows: Sequence[tuple[Column, ...]], names: Sequence[str]) -> DataFrame:
    """Turn one aggregated row into a literal-shaped long table (``tibble`` of scalars)."""
    structs = [F.struct(*[v.alias(n) for v, n in zip(r, names)]) for r in rows]
    return df.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")
