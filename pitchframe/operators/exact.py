"""Sums and means of doubles that come out the same, bit for bit, in any order and partitioning.

Adding doubles rounds at every step, so a plain sum depends on how the rows are split. Here every value
is cut, without error, into whole numbers of five places of a base-2**24 fixed-point form (from 2**24
down to 2**-72, all with the sign of the value). Each place is an ordinary 64-bit sum, which is exact and
merges map-side in any order. The five totals carry over into one whole number of 2**-72, the exact
sum, which is turned into a double once.

Exact for values of magnitude from 2**-20 to 2**62 (smaller ones lose what lies below 2**-72, each
by itself, so the result still does not depend on the order); a place holds some 2**39 values. A group
with a NaN, an infinity or a larger value gets the plain sum.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of one place, and the magnitude from which a value is not cut.
BITS = 24
LARGEST = 2.0 ** 62


def _sum_text(name: str, where: str | None, times: str | None) -> str:
    """SQL text of the aggregate: one expression, parsed once."""
    place, chosen = 1 << BITS, f" FILTER (WHERE {where})" if where else ""
    x = f"CAST(`{name}` AS DOUBLE)"
    value = f"CASE WHEN abs({x}) < {LARGEST!r}D THEN {x} END"
    whole = f"CAST({value} AS BIGINT)"
    shifted = f"(({value}) - {whole}) * {place ** 2}D"
    fraction = f"CAST({shifted} AS BIGINT)"
    below = f"CAST(({shifted} - {fraction}) * {place}D AS BIGINT)"
    # from 2**-72 up; every part has the sign of the value
    places = [below, f"{fraction} % {place}", f"{fraction} div {place}", f"{whole} % {place}", f"{whole} div {place}"]
    n = f" * {times}" if times else ""
    totals = ", ".join(f"sum(({p}){n}){chosen}" for p in places)

    def carried(t: str) -> str:
        """Places from the lowest up, each in 0 .. 2**24 - 1 (``d``), and what is above them (``c``)."""
        return (f"aggregate({t}, named_struct('c', 0L, 'd', CAST(array() AS ARRAY<BIGINT>)), (a, x) -> "
                f"named_struct('c', shiftright(a.c + x, {BITS}), 'd', concat(a.d, array((a.c + x) & {place - 1}L))))")

    # the whole part and the fraction, each rounded at most once, added
    double = (f"CAST(n.c * {place} + n.d[4] AS DOUBLE) * {place}D + CAST(n.d[3] AS DOUBLE) "
              f"+ (CAST(n.d[2] * {place} + n.d[1] AS DOUBLE) / {place ** 2}D + CAST(n.d[0] AS DOUBLE) / {place ** 3}D)")
    exact = (f"transform(array(array({totals})), t -> transform(array(if({carried('t')}.c < 0, -1L, 1L)), s -> "
             f"s * transform(array({carried('transform(t, x -> x * s)')}), n -> {double})[0])[0])[0]")
    return f"CASE WHEN count({value}){chosen} = count({x}){chosen} THEN {exact} ELSE sum({x}{n}){chosen} END"


def exact_sum(name: str, where: str | None = None, times: str | None = None) -> Column:
    """``sum(x, na.rm = TRUE)`` of the double column ``name`` (null where no value is): an aggregate.

    ``where`` is SQL text of a condition on the rows; ``times`` names a column that counts how often
    each value stands."""
    return F.expr(_sum_text(name, where, times))


def exact_mean(name: str, where: str | None = None, times: str | None = None) -> Column:
    """``mean(x, na.rm = TRUE)``, as ``exact_sum``."""
    chosen = f" FILTER (WHERE {where})" if where else ""
    n = f"sum(CASE WHEN `{name}` IS NOT NULL THEN {times} END)" if times else f"count(`{name}`)"
    return F.expr(f"try_divide({_sum_text(name, where, times)}, {n}{chosen})")
