"""Column helpers for the null, tie and rounding rules of the original analysis.

Plain Spark SQL differs from the original in a handful of places (membership never
yields null, ``ifelse`` keeps null, strict sums, ``n_distinct`` counting null, nulls
sorted last in both directions, half-to-even rounding, "NA" in string concatenation,
division by zero giving null). Each rule is one small function so that every analytic
states which rule it relies on.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_set(c: str | Column, values: Iterable) -> Column:
    """``x %in% values``: true/false, never null (a null x is simply not a member)."""
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def not_in_set(c: str | Column, values: Iterable) -> Column:
    """``!x %in% values``: keeps rows whose x is null."""
    return ~in_set(c, values)


def if_else(cond: Column, yes, no) -> Column:
    """``ifelse(cond, yes, no)``: a null condition gives null, not ``no``."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond, yes).when(~cond, no)


def strict_sum(c: str | Column) -> Column:
    """``sum(x)`` without ``na.rm``: null as soon as one input is null."""
    return F.when(F.count(col(c)) == F.count(F.lit(1)), F.sum(col(c)))


def lenient_sum(c: str | Column) -> Column:
    """``sum(x, na.rm = TRUE)``: nulls skipped, empty sum is 0."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def count_true(cond: Column) -> Column:
    """``sum(cond, na.rm = TRUE)`` for a logical: rows where cond is true."""
    return F.count_if(F.coalesce(cond, F.lit(False)))


def n_distinct(c: str | Column) -> Column:
    """``n_distinct(x)``: distinct values with null counted as one more value."""
    return F.count_distinct(col(c)) + F.max(col(c).isNull().cast("bigint"))


def mean_flag(cond: Column) -> Column:
    """``mean(logical)``: share of true among non-null flags."""
    return F.avg(cond.cast("double"))


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` with a zero or null denominator giving null instead of an error."""
    return F.try_divide(num, den)


def pct(num: Column, den: Column) -> Column:
    """``num / den * 100``; null on a zero denominator."""
    return F.try_divide(num, den) * F.lit(100.0)


def round_half_even(c: str | Column, scale: int = 0) -> Column:
    """``round(x)``: IEC 60559 half-to-even rounding."""
    return F.bround(col(c), scale)


def to_text(c: str | Column) -> Column:
    """Value as text, with null written as "NA" (``paste0`` semantics)."""
    return F.coalesce(col(c).cast("string"), F.lit("NA"))


def paste0(*parts: str | Column) -> Column:
    """``paste0``: Python strings are literals; a null column part becomes "NA"."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else to_text(p) for p in parts])


def asc_last(c: str | Column) -> Column:
    return col(c).asc_nulls_last()


def desc_last(c: str | Column) -> Column:
    return col(c).desc_nulls_last()
