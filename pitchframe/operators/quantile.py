"""Exact median per group by radix selection, without gathering a group in one task.

``median(x, na.rm = TRUE)`` is the mean of the values at 0-based ranks
``(n - 1) div 2`` and ``n div 2`` of the sorted group (null for an empty group). A
built-in percentile keeps every distinct value of a group in one buffer on one task,
which does not survive a group holding a large share of the rows. Here:

1. count rows per (group, value): a partial aggregate, so repeated values collapse
   before any shuffle;
2. every value becomes a 64-bit whole number in the same order (``order_key``);
3. four rounds of 16 bits, from the highest: the counts of a group's next digit (at most 65,536, a
   partial aggregate over the rows that share the digits found so far) show which digit holds
   the wanted rank; after the fourth round one value is left.

No job runs while the plan is built, nothing is sampled, and no bound becomes a literal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, DIGIT_BITS = 4, 16
#: Layout of a 64-bit float: bits of the fraction, exponent offset, smallest power that has a full fraction.
FRACTION_BITS, OFFSET, SMALLEST = 52, 1023, 2.0 ** -1022


def order_key(name: str) -> Column:
    """A bigint that orders like the double column (its bit pattern, negated below zero; not for NaN)."""
    size, one = f"abs(`{name}`)", 1 << FRACTION_BITS
    a = f"CASE WHEN {size} < {SMALLEST!r}D THEN 1D ELSE {size} END"
    guess = f"CAST(floor(log2({a})) AS DOUBLE)"
    power = f"pow(2D, {guess})"  # exact: the power of two integers
    exponent = f"({guess} + CASE WHEN {a} < {power} THEN -1 WHEN {a} >= {power} * 2 THEN 1 ELSE 0 END)"
    full = f"(CAST({exponent} AS BIGINT) + {OFFSET}) * {one} + CAST((({a}) / pow(2D, {exponent}) - 1) * {one}D AS BIGINT)"
    tiny = f"CAST({size} * {2.0 ** 537!r}D * {2.0 ** 537!r}D AS BIGINT)"  # a multiple of 2**-1074
    bits = (f"CASE WHEN {size} < {SMALLEST!r}D THEN {tiny} WHEN {size} = double('Infinity') THEN {2047 * one} ELSE {full} END")
    return F.expr(f"CASE WHEN `{name}` < 0 THEN -1 ELSE 1 END * {bits}")


def value_counts(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Rows per (group, value): columns ``_v`` (double, null kept; -0.0 as 0.0) and ``_c``.

    ``_v`` is read back as an aggregate, not as the key: a reader's condition on it then stays above the
    aggregate, so all readers of the counts share one shuffle and the rows below it are computed once."""
    return df.select(*group, F.col(value).cast("double").alias("_key")).groupBy(*group, "_key") \
        .agg(F.expr("max(CASE WHEN _key = 0 THEN 0D ELSE _key END) AS _v"), F.count(F.lit(1)).alias("_c")) \
        .select(*group, "_v", "_c")


def median_of_counts(counts: DataFrame, group: Sequence[str], out: str) -> DataFrame:
    """One row per group having at least one value, with its exact median, from ``value_counts``."""
    g = [f"`{c}`" for c in group]
    held = "_start <= {0} AND {0} < _start + _n"

    def digits(rounds: int) -> str:
        return f"shiftright(_key, {64 - DIGIT_BITS * rounds})"

    def below(*keys: str) -> str:
        by = f"PARTITION BY {', '.join(keys)} " if keys else ""
        return f"coalesce(sum(_n) OVER ({by}ORDER BY _digits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"

    real = counts.filter("_v IS NOT NULL AND NOT isnan(_v)").withColumn("_key", order_key("_v"))
    # the first digit of every group; ``_which`` is 0 for the lower and 1 for the upper middle rank
    first = real.groupBy(*group, F.expr(digits(1)).alias("_digits")).agg(F.expr("sum(_c) AS _n"), F.expr("max(_v) AS _value"))
    total = f"sum(_n) OVER ({'PARTITION BY ' + ', '.join(g) if g else ''})"
    middles = ", ".join(f"CASE WHEN {held.format(r)} THEN named_struct('_which', {i}, '_rank', {r} - _start) END"
                        for i, r in enumerate(("_lower", "_upper")))
    found = (first.selectExpr(*g, "_digits", "_n", "_value", f"{below(*g)} AS _start", f"{total} AS _total")
             .selectExpr("*", "(_total - 1) div 2 AS _lower", "_total div 2 AS _upper")
             .selectExpr(*g, "_digits", "_value", f"inline(array_compact(array({middles})))"))
    for rounds in range(2, ROUNDS + 1):
        own = found.selectExpr(*[f"`{c}` AS `_g{i}`" for i, c in enumerate(group)], "_which", "_rank", "_digits AS _found")
        same = " AND ".join([f"`{c}` <=> `_g{i}`" for i, c in enumerate(group)] + [f"{digits(rounds - 1)} = _found"])
        counted = (real.join(own, F.expr(same)).groupBy(*group, "_which", "_rank", F.expr(digits(rounds)).alias("_digits"))
                   .agg(F.expr("sum(_c) AS _n"), F.expr("max(_v) AS _value")))
        found = (counted.selectExpr("*", f"{below(*g, '_which')} AS _start").filter(held.format("_rank"))
                 .selectExpr(*g, "_which", "_rank - _start AS _rank", "_digits", "_value"))
    return found.groupBy(*group).agg(F.expr(
        "(max(_value) FILTER (WHERE _which = 0) + max(_value) FILTER (WHERE _which = 1)) / 2").alias(out))


def exact_median(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """One row per group having at least one non-null value, with its exact median."""
    return median_of_counts(value_counts(df, group, value), group, out)
