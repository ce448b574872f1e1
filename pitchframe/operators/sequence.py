"""``lead`` over one globally ordered event log, without a single-task window.

The original sorts the whole event log by (match, event) and takes ``lead`` over it, so
the last event of a match is followed by the first event of the next match. A window
with no partition key would pull every row into one task, and a window partitioned by
match puts a whole (possibly huge) match into one task. Instead:

1. ``log_ranges`` range-partitions the log by the full sort key (a hot match is split, because
   the event id is part of the key) and writes the partition number into each row. The first row of
   a partition is written twice: once for its own range and, as a guest, for the range before;
2. ``successors`` takes an ordinary ``lead`` inside each range, where the guest follows the range's
   last row, and drops the guests.

Both are plans without a job of their own and without a literal bound, so the number of ranges is free.
Each row is read from one exchange only: no second branch has to see the same ranges. ``EventData`` can
store the ranges once (``prepare``) for any number of readers.

Spark takes its range bounds from keys of the log, and every bound lies in the range it ends; so only
the last range can be empty, and "the range before" is the number minus one. Rows equal in every sort
column share a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE, GUEST = "_range", "_guest"
#: Bits of ``monotonically_increasing_id`` below the partition number.
ROW_BITS = 33


def _sort_columns(order: Sequence[str], carry: Sequence[str]) -> list[str]:
    return [*order, *[c for c in carry if c not in order]]


def log_ranges(log: DataFrame, order: Sequence[str], carry: Sequence[str],
               num_partitions: int | None = None) -> DataFrame:
    """The log with its range number (``_range``) and the guests (``_guest`` is true), ranges by ``order``
    and then ``carry``, nulls last; ``spark.sql.shuffle.partitions`` ranges unless a number is given."""
    n = num_partitions or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [F.col(c).asc_nulls_last() for c in _sort_columns(order, carry)]
    place = F.monotonically_increasing_id()  # partition number and row number in it
    placed = log.repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("_place", place)
    own = F.shiftright("_place", ROW_BITS)
    first = F.col("_place") == F.shiftleft(own, ROW_BITS)
    stays = F.struct(own.alias("r"), F.lit(False).alias("g"))
    guest = F.struct((own - 1).alias("r"), F.lit(True).alias("g"))
    rows = placed.select(*log.columns, F.explode(F.when(first, F.array(stays, guest)).otherwise(F.array(stays))).alias("_at"))
    return rows.select(*log.columns, F.col("_at.r").alias(RANGE), F.col("_at.g").alias(GUEST))


def successors(ranges: DataFrame, order: Sequence[str], carry: Sequence[str], *, scope: str = "global",
               match_col: str = "MATCH_WYID", prefix: str = "next_") -> DataFrame:
    """The log of ``log_ranges`` with ``<prefix><c>`` for every ``c`` in ``carry``: the value in the
    following row, null in the last one.

    ``scope="global"`` is the original behaviour (the order runs across matches); ``scope="match"``
    keeps only successors inside the same match (``match_col`` must be among the log's columns)."""
    if scope not in ("global", "match"):
        raise ValueError("scope must be 'global' or 'match'")
    columns = [c for c in ranges.columns if c not in (RANGE, GUEST)]
    key = [F.col(c).asc_nulls_last() for c in _sort_columns(order, carry)]
    # of equal rows the guest comes last: it belongs to a later range, so all its equals do
    within = Window.partitionBy(RANGE).orderBy(F.col(GUEST), *key)
    wanted = [*carry, *([match_col] if scope == "match" and match_col not in carry else [])]
    follower = F.lead(F.struct(*[F.col(c).alias(c) for c in wanted])).over(within)
    rows = ranges.withColumn("_next", follower).filter(~F.col(GUEST))
    if scope == "match":
        same = F.col("_next")[match_col].eqNullSafe(F.col(match_col))
        rows = rows.withColumn("_next", F.when(same, F.col("_next")))
    return rows.select(*columns, *[F.col("_next")[c].alias(prefix + c) for c in carry])


def next_event(log: DataFrame, order: Sequence[str], carry: Sequence[str], *,
               scope: str = "global", match_col: str = "MATCH_WYID",
               num_partitions: int | None = None, prefix: str = "next_") -> DataFrame:
    """Add ``<prefix><c>`` for every ``c`` in ``carry``: the value in the following row
    of the log ordered by ``order`` (then by ``carry`` to break ties), nulls last."""
    ranges = log_ranges(log, order, carry, num_partitions)
    return successors(ranges, order, carry, scope=scope, match_col=match_col, prefix=prefix)
