"""Helpers of the operators on embedding vectors: clean rows, Arrow lists as matrices, tree sums."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partial results that one task or the driver adds up.
FAN_IN = 64


def finite_vectors(table: DataFrame, id_col: str, vector_col: str, entry: Callable[[Column], Column],
                   names: tuple[str, str]) -> DataFrame:
    """(id, vector) with ``entry`` applied to each component as double.

    Rows whose vector is null or empty, or holds a null or non-finite component, are dropped.
    """
    v = F.col(vector_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return table.filter(F.coalesce(ok & (F.size(v) > 0), F.lit(False))).select(
        F.col(id_col).alias(names[0]), F.transform(v, entry).alias(names[1]))


def common_length(table: DataFrame, vector_col: str) -> int:
    """The length most vectors have (of several such, the largest); 0 for an empty table."""
    sizes = table.groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    return next((r.d for r in sizes.collect()), 0)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """An Arrow list column without nulls, all lists ``d`` long, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def reduced(table: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray | None],
            join: Callable[[np.ndarray, np.ndarray], np.ndarray], dtype: type) -> np.ndarray | None:
    """``part`` of every Arrow batch, put together by ``join`` (flat arrays of one fixed size).

    A task sends one row; beyond ``FAN_IN`` partitions a middle layer of tasks joins them in groups
    of about the square root of their number, so neither a task nor the driver holds many.
    """
    def over(arrays: Iterator[np.ndarray | None]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in arrays:
            if x is not None:
                x = np.ascontiguousarray(x, dtype).ravel()
                total = x if total is None else join(total, x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return over(part(b) for b in batches if b.num_rows)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return over(np.frombuffer(x.as_py(), dtype) for b in batches for x in b.column(0))

    n = table.rdd.getNumPartitions()
    rows = table.mapInArrow(parts, "part binary")
    if n > FAN_IN:
        rows = rows.repartition(math.isqrt(n) + 1).mapInArrow(groups, "part binary")
    total = None
    for r in rows.collect():
        x = np.frombuffer(bytes(r.part), dtype)
        total = x if total is None else join(total, x)
    return total
