"""Exact top-k search by inner product over a vector-approximation file.

The file holds one row per distinct vector: a byte per dimension (the number of the cell its component
lies in), the exact integer vector, and the ``k + 1`` smallest ids that carry it. Vectors with more
copies lose nothing: of equal scores the smallest ids win, and only a query's own id is ever passed over.

Cells cut each dimension at quantiles of a bounded sample (``SAMPLE`` vectors by hash; only the
sharpness of the bounds depends on it); the outer cells end at the exact minimum and maximum. For a query
q, a cell [l, u] bounds a component's share of the score by max(q·l, q·u) and min(q·l, q·u).

Queries go in slices of about ``SLICE_BYTES``, chosen by a hash, each broadcast. For a slice:

1. scan of the cells alone: each task keeps the ``k + 1`` largest lower bounds of every query; joined in
   a tree, they give the score the last result reaches at least;
2. scan with vectors: those whose upper bound reaches that score are computed exactly, in falling order of
   the upper bound, until no bound left reaches the last of the best found in the task;
3. the few rows found are ranked per distinct query, and each query row takes its own id out.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, nor
do those not as long as most (of several such lengths, the largest); every row is a candidate, so
repeated ids stand beside each other, and a repeated query row repeats its result; a null id is no query
and ranks last among equal scores; other columns are ignored; an empty table or one without queries gives
no rows. A score that might not fit 64 bits stops the job with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import materialise
from pitchframe.llm.vectors import common_length, finite_vectors, matrix, reduced

TOP = 5
SAMPLE = 1 << 15
CELLS = 256
#: Bytes of one slice of distinct query vectors.
SLICE_BYTES = 1 << 24
#: Bounds (rows by queries) a task holds at once.
BLOCK = 1 << 21
#: Exact vectors read for a query before its bound is looked at again.
STEP = 8


class Cells:
    """Cell edges of each dimension: cell c holds the integers edge[c] .. edge[c + 1] - 1."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.d = low.size
        self.edges = []
        for j in range(self.d):
            inner = np.unique(np.quantile(sample[:, j], np.arange(1, CELLS) / CELLS, method="lower"))
            inner = inner[(inner > low[j]) & (inner <= high[j])].astype(np.int64)
            self.edges.append(np.concatenate([[low[j]], inner, [high[j] + 1]]))
        mid, half = np.zeros((CELLS, self.d)), np.zeros((CELLS, self.d))
        for j, e in enumerate(self.edges):
            mid[:e.size - 1, j], half[:e.size - 1, j] = (e[:-1] + e[1:] - 1) / 2, (e[1:] - 1 - e[:-1]) / 2
        self.mid, self.half = mid, half
        self.reach = np.maximum(np.abs(low), np.abs(high)).astype(np.float64)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e[1:-1], x[:, j], side="right") for j, e in enumerate(self.edges)],
                        axis=1).astype(np.uint8)

    def bounds(self, codes: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middle and half width of the score's range, rows by queries; the width covers rounding."""
        at = np.arange(self.d)
        width = self.half[codes, at] @ np.abs(q.T)
        return self.mid[codes, at] @ q.T, width + (np.abs(q) @ self.reach) * (self.d + 4) * 2.0 ** -52


def approximation_file(vectors: DataFrame, d: int, k: int) -> tuple[DataFrame, Cells]:
    """The stored file (codes, v, ids) and its cells, from rows (vec_id, v) of length ``d``."""
    def ends(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0), d)
        return np.concatenate([x.max(axis=0), ~x.min(axis=0)])

    top = reduced(vectors.select("v"), ends, np.maximum, np.int64)
    n = vectors.count()
    keep = F.lit(True) if n <= SAMPLE else F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int(SAMPLE / n * (1 << 30))
    cells = Cells(np.array([r.v for r in vectors.filter(keep).select("v").collect()] or [~top[d:]], np.int64),
                  ~top[d:], top[:d])
    first = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last())
    few = vectors.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= k + 1)
    # k + 1 ids a vector at most; sorted with nulls last
    ids = F.array_sort(F.collect_list(F.struct(F.col("vec_id").isNull().alias("no"), F.col("vec_id").alias("id"))))
    distinct = few.groupBy("v").agg(F.transform(ids, lambda s: s["id"]).alias("ids"))
    model = vectors.sparkSession.sparkContext.broadcast(cells)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = model.value.codes(matrix(b.column(0), d))
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), *b.columns],
                                             names=["codes", "v", "ids"])

    table = distinct.select("v", "ids").mapInArrow(code, f"codes binary, v array<bigint>, ids array<{kind}>")
    return materialise(table, "approximations"), cells


def _code_rows(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, d)


def _slice(table: DataFrame, cells: Cells, queries: np.ndarray, k: int, top: int) -> DataFrame:
    """(q, score, ids, same) of the vectors that may be among the best ``k`` of the slice's queries."""
    d, n = cells.d, len(queries)
    if ((np.abs(queries).astype(float) @ cells.reach).max() if n else 0) >= 2.0 ** 62:
        raise OverflowError("a score may not fit 64 bits")
    model = table.sparkSession.sparkContext.broadcast((cells, queries))

    def largest(x: np.ndarray) -> np.ndarray:
        return -np.partition(-x, k - 1, axis=0)[:k]

    def lower(batch: pa.RecordBatch) -> np.ndarray:
        cells, queries = model.value
        codes, step = _code_rows(batch.column(0), d), max(1, BLOCK // n)
        best = np.full((k, n), -np.inf)
        for at in range(0, len(codes), step):
            mid, width = cells.bounds(codes[at:at + step], queries.astype(float))
            best = largest(np.concatenate([best, mid - width]))
        return best

    floor = reduced(table.select("codes"), lower, lambda a, b: largest(
        np.concatenate([a.reshape(k, n), b.reshape(k, n)])).ravel(), np.float64)
    floor = table.sparkSession.sparkContext.broadcast(floor.reshape(k, n).min(axis=0))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, queries = model.value
        real, step = queries.astype(float), max(1, BLOCK // n)
        best = np.full((k, n), -np.inf)  # exact scores of this task's best, per query
        best[-1] = floor.value
        for b in batches:
            codes = _code_rows(b.column(0), d)
            for at in range(0, len(codes), step):
                mid, width = cells.bounds(codes[at:at + step], real)
                upper = mid + width
                row, q = np.nonzero(upper >= best.min(axis=0))
                if not row.size:
                    continue
                need, row = np.unique(row, return_inverse=True)
                v = matrix(b.column(1).take(pa.array(need + at)), d)
                upper = upper[need[row], q]
                order = np.lexsort((-upper, q))
                row, q, upper = row[order], q[order], upper[order]
                place = np.arange(q.size) - np.searchsorted(q, q)
                found = []
                for first in range(0, int(place.max()) + 1, STEP):  # in bound order, STEP vectors a query
                    now = np.flatnonzero((place >= first) & (place < first + STEP) & (upper >= best.min(axis=0)[q]))
                    if not now.size:
                        break
                    r, p = row[now], q[now]
                    scores = np.concatenate([np.einsum("ij,ij->i", v[r[s:s + BLOCK // d]], queries[p[s:s + BLOCK // d]])
                                             for s in range(0, r.size, max(1, BLOCK // d))])
                    found.append((r, p, scores))
                    fresh = np.full((STEP, n), -np.inf)
                    fresh[place[now] - first, p] = scores
                    best = largest(np.concatenate([best, fresh]))
                r, p, scores = (np.concatenate(x) for x in zip(*found))
                good = scores >= best.min(axis=0)[p]
                r, p, scores = r[good], p[good], scores[good]
                if r.size:
                    same = (v[r] == queries[p]).all(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(p.astype(np.int32)), pa.array(scores), b.column(2).take(pa.array(need[r] + at)),
                         pa.array(same), pa.array(queries[p].tolist(), pa.list_(pa.int64()))],
                        names=["q", "score", "ids", "same", "v"])

    kind = table.schema["ids"].dataType.simpleString()
    return table.select("codes", "v", "ids").mapInArrow(
        exact, f"q int, score bigint, ids {kind}, same boolean, v array<bigint>")


def _ranked(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Ranks per distinct query, then per query row without one occurrence of its own id."""
    rows = found.select("v", "score", "same", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("v").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), F.desc("same"))
    rows = rows.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= k + 1)
    lists = rows.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("_rn", "score", "vec_id", "same"))).alias("best"))

    def others(best: Column) -> Column:
        own = F.array_position(F.transform(best, lambda s: F.coalesce(s["same"] & (s["vec_id"] == F.col("query_id")),
                                                                     F.lit(False))), F.lit(True))
        return F.slice(F.filter(best, lambda s, i: i + 1 != own), 1, k)

    out = queries.join(lists, "v").select("query_id", F.posexplode(others(F.col("best"))).alias("_at", "_s"))
    return out.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_s.vec_id").alias("vec_id"),
                      F.col("_s.score").alias("score"))


def search(table: DataFrame, is_query: Column, k: int = TOP, scale: int = 256, slice_bytes: int = SLICE_BYTES,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``table`` where ``is_query`` (a condition on
    ``vec_id``) holds, the ``k`` other rows with the largest inner product of floor(``scale`` · x)."""
    spark, kind = table.sparkSession, table.schema[id_col].dataType.simpleString()
    vectors = materialise(finite_vectors(table, id_col, vector_col, lambda x: F.floor(scale * x).cast("long"),
                                         ("vec_id", "v")), "vectors")
    d = common_length(vectors, "v")
    vectors = vectors.filter(F.size("v") == d)
    queries = vectors.filter(is_query).select(F.col("vec_id").alias("query_id"), "v")
    n = queries.count()
    if not n:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    file, cells = approximation_file(vectors, d, k)
    slices = -(-n * d * 8 // slice_bytes)
    found = None
    for i in range(slices):
        own = queries.filter(F.pmod(F.xxhash64("v"), F.lit(slices)) == i).select("v").distinct()
        own = np.array([r.v for r in own.collect()], np.int64).reshape(-1, d)
        if len(own):
            part = _slice(file, cells, own, k + 1, k)
            found = part if found is None else found.unionAll(part)
    return _ranked(found, queries, k)
