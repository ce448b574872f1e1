"""Right-closed interval bins (``cut``) and the pitch-zone grid.

A bin is two columns: ``<name>_idx`` (1-based position, the factor level order) and
``<name>`` (the interval label). Values outside the breaks, and nulls, get null in
both, which groups them into one trailing "NA" bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import col, round_half_even


def seq_breaks(start: float, stop: float, step: float) -> list[float]:
    """``seq(start, stop, by = step)``: breaks are ``start + i * step`` in float64,
    so 3 * 0.05 stays 0.15000000000000002 exactly as the original computes it."""
    n = int(round((stop - start) / step + 1e-10))
    return [start + i * step for i in range(n + 1)]


def _fmt(values: Sequence[float], digits: int) -> list[str]:
    return [("%." + str(digits) + "g") % v for v in values]


def format_breaks(breaks: Sequence[float], digits: int = 3) -> list[str]:
    """Break text with ``digits`` significant digits, widened until all texts differ."""
    for d in range(digits, max(12, digits) + 1):
        text = _fmt(breaks, d)
        if len(set(text)) == len(text):
            return text
    return _fmt(breaks, 15)


def interval_labels(breaks: Sequence[float], include_lowest: bool = True) -> list[str]:
    """Labels ``[a,b]`` for the first bin (when the lowest edge is closed), ``(a,b]`` otherwise."""
    text = format_breaks(breaks)
    labels = []
    for i in range(1, len(breaks)):
        left = "[" if (i == 1 and include_lowest) else "("
        labels.append(f"{left}{text[i - 1]},{text[i]}]")
    return labels


def _case(conds: Sequence[Column], values: Sequence) -> Column:
    out = None
    for cond, v in zip(conds, values):
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out


def cut(c: str | Column, breaks: Sequence[float], labels: Sequence[str] | None = None,
        include_lowest: bool = True) -> tuple[Column, Column]:
    """Right-closed bins over ``breaks``; returns (index column, label column)."""
    x = col(c)
    labels = list(labels) if labels is not None else interval_labels(breaks, include_lowest)
    conds = []
    for i in range(1, len(breaks)):
        lo, hi = float(breaks[i - 1]), float(breaks[i])
        lower = (x >= F.lit(lo)) if (i == 1 and include_lowest) else (x > F.lit(lo))
        conds.append(lower & (x <= F.lit(hi)))
    return _case(conds, range(1, len(breaks))), _case(conds, labels)


def upper_bound_bins(c: str | Column, breaks: Sequence[float]) -> tuple[Column, Column]:
    """Bins decided by ``x <= b1``, ``x <= b2``, ... in order and a final ``x > b[-2]``
    (a CASE chain with no lower guard, as the hand-written angle bins are)."""
    x = col(c)
    n = len(breaks) - 1
    conds = [(x > F.lit(float(breaks[i - 1]))) if i == n else (x <= F.lit(float(breaks[i])))
             for i in range(1, n + 1)]
    return _case(conds, range(1, n + 1)), _case(conds, interval_labels(breaks))


def zone(c: str | Column, step: float = 10.0) -> Column:
    """Nearest grid line: ``round(x / step) * step`` with half-to-even rounding, as an integer."""
    return (round_half_even(col(c) / F.lit(step)) * F.lit(step)).cast("bigint")
