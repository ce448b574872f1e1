"""Embedding whitening by a block Jacobi-Davidson method over matrix-free distributed products.

The covariance V is never formed. A product V·U of a block U of d-long vectors is one Spark pass:
each task centres its vectors, multiplies them by U and by their own transpose, and sends one small
matrix. On the driver stands only what is d long (dimensions) by at most ``MAX_BASIS`` wide:

1. Rayleigh-Ritz in the subspace gives Ritz pairs and, without another pass, their residuals;
2. leading pairs whose residuals reach double precision are locked, and the subspace is kept
   orthogonal to them;
3. for the next ``BLOCK`` pairs (θ, u) the correction equation
   (I - QQ')(V - θI)(I - QQ') t = -r, Q = [locked, u], is solved roughly by ``INNER`` steps of MINRES,
   all columns sharing each pass;
4. the corrections enter the subspace; a subspace over ``MAX_BASIS`` restarts from its best vectors.

When all wanted pairs are locked, a random block orthogonal to them goes through the same steps: a
pair that the subspace had missed shows up there and the search goes on.

Entries c become x = floor(64·c) + 1000000 (long); sums are exact integers, and centring takes the
integer part of the mean off first, so no digit is lost. ``deviation`` is exact (decimal).

Defined results: rows whose vector is null, empty or holds a null or non-finite entry have no part;
neither have rows whose vector is not as long as most (of several such lengths, the largest); a
repeated row counts and returns as often as it stands; a null id stays null; directions without
variance (an eigenvalue below 1e-13 of the trace) are no components, so equal vectors, a single row or
an empty table give no rows; among equal eigenvalues any orthonormal choice is a result, the same for
all rows; other columns are ignored. A number beyond its type stops the job with an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import materialise
from pitchframe.llm.vectors import common_length, finite_vectors, matrix, reduced

COMPONENTS = 32
#: Ritz pairs corrected together, MINRES steps for each, columns of the subspace.
BLOCK, INNER, MAX_BASIS = 16, 5, 160
#: A residual, over the largest eigenvalue, that counts as double precision.
TOLERANCE = 4e-15
#: Accepted from a space that cannot grow, and where three rounds and fresh products brought no more.
ROUNDING = 4e-14
MAX_ROUNDS = 400
#: Matrix entries a task handles at once.
CHUNK = 1 << 22


@dataclass
class Centred:
    """Stored vectors with their exact count and per-dimension sums."""

    rows: DataFrame
    d: int
    n: int
    sums: list[int]

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return lambda x: (x - whole) - rest

    def total(self, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """Sum over all vectors of ``part`` (of a block of centred vectors), divided by their number."""
        d, centre = self.d, self.centre()

        def run(batch: pa.RecordBatch) -> np.ndarray:
            x, step = matrix(batch.column(0), d), max(1, CHUNK // d)
            return sum(part(centre(x[at:at + step])).ravel() for at in range(0, len(x), step))

        return reduced(self.rows.select("x"), run, np.add, np.float64).reshape(shape) / self.n

    def product(self, u: np.ndarray) -> np.ndarray:
        """V·u for a block u."""
        return self.total(lambda c: c.T @ (c @ u), u.shape)


def prepare(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> Centred:
    """Store the integer vectors and take their exact sums."""
    rows = materialise(finite_vectors(table, id_col, vector_col,
                                      lambda c: F.floor(64 * c).cast("long") + 1_000_000, ("vec_id", "x")), "integers")
    d = common_length(rows, "x")
    rows = rows.filter(F.size("x") == d)

    def run(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0), d)
        high, low = x >> 32, x & 0xFFFFFFFF  # halves, whose sums cannot overflow
        return np.concatenate([[len(x)], high.sum(axis=0), low.sum(axis=0)])

    got = reduced(rows.select("x"), run, np.add, np.int64) if d else None
    if got is None:
        return Centred(rows, 0, 0, [])
    got = got.tolist()
    return Centred(rows, d, got[0], [(h << 32) + w for h, w in zip(got[1:d + 1], got[d + 1:])])


def minres(apply: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int) -> np.ndarray:
    """MINRES for a symmetric operator, each column a system of its own, one ``apply`` a step."""
    def safe(x: np.ndarray) -> np.ndarray:
        return np.where(x == 0, 1, x)

    eta = np.linalg.norm(rhs, axis=0)
    v, before, x = rhs / safe(eta), np.zeros_like(rhs), np.zeros_like(rhs)
    w, w_before = np.zeros_like(rhs), np.zeros_like(rhs)
    beta, cos, cos_before, sin, sin_before = (np.full(eta.shape, s) for s in (0.0, 1.0, 1.0, 0.0, 0.0))
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * before
        following = np.linalg.norm(p, axis=0)
        diagonal = cos * alpha - cos_before * sin * beta
        rho = np.hypot(diagonal, following)
        direction = (v - sin_before * beta * w_before - (sin * alpha + cos_before * cos * beta) * w) / safe(rho)
        cos_before, cos = cos, np.where(rho == 0, 0, diagonal / safe(rho))
        sin_before, sin = sin, np.where(rho == 0, 0, following / safe(rho))
        x = x + cos * eta * direction
        eta = -sin * eta
        w_before, w, before, v, beta = w, direction, v, p / safe(following), following
    return x


def _outside(t: np.ndarray, *spaces: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``t`` adds to the orthonormal ``spaces``."""
    t = t / np.maximum(np.linalg.norm(t, axis=0), 1e-300)
    for _ in range(2):
        for q in spaces:
            t = t - q @ (q.T @ t)
    u, s, _ = np.linalg.svd(t, full_matrices=False)
    u = u[:, s > 1e-10]
    for q in spaces:
        u = u - q @ (q.T @ u)
    return np.linalg.qr(u)[0]


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, inner: int = INNER,
               max_basis: int = MAX_BASIS, seed: int = 0) -> tuple[np.ndarray, np.ndarray, dict]:
    """The ``k`` largest eigenvalues (falling), their vectors, and {passes, residual, rounds}."""
    rng, k = np.random.default_rng(seed), min(k, d)
    passes = 0

    def applied(u: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return product(u)

    locked, values = np.zeros((d, 0)), np.zeros(0)
    basis = _outside(rng.standard_normal((d, min(d, k + block))))
    image = applied(basis)
    probed, last, idle, worst = False, np.inf, 0, 0.0
    for rounds in range(1, MAX_ROUNDS + 1):
        theta, y = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        basis, image = basis @ y, image @ y
        residual = image - basis * theta
        norm = np.linalg.norm(residual, axis=0) / max(theta.max(initial=0), values.max(initial=0), 1e-300)
        full = locked.shape[1] + basis.shape[1] >= d
        idle, last = (idle + 1 if norm[:1].sum() >= last / 2 else 0), norm[:1].sum()
        if idle == 3:  # rounding gathered by the combinations: products anew
            image = applied(basis)
            continue
        limit = ROUNDING if full or idle > 3 else TOLERANCE
        done = int(np.argmin(np.append(norm <= limit, False)))
        if probed and not (theta[:1] > values.min(initial=np.inf) * (1 + 1e-12)).any():
            done = 0  # the probe shows nothing above the locked pairs
            break
        done = min(done, max(k - locked.shape[1], 0)) if not probed else done
        if done:
            worst = max(worst, norm[:done].max())
            locked = np.hstack([locked, basis[:, :done]])
            values = np.append(values, theta[:done])
            basis, image = basis[:, done:], image[:, done:]
            theta, residual = theta[done:], residual[:, done:]
            last, idle = np.inf, 0
        if locked.shape[1] >= d or (full and locked.shape[1] >= k):
            break
        if locked.shape[1] >= k and not probed:  # look for a pair the subspace missed
            probed = True
            fresh = _outside(rng.standard_normal((d, block)), locked, basis)
        else:
            at = slice(0, block)
            u, shift, r = basis[:, at], theta[at], residual[:, at]

            def project(t: np.ndarray) -> np.ndarray:
                t = t - locked @ (locked.T @ t)
                return t - u * (u * t).sum(axis=0)

            fresh = _outside(minres(lambda t: project(applied(t) - t * shift), project(-r), inner), locked, basis)
        if not fresh.shape[1]:  # nothing new from the corrections: a random direction
            fresh = _outside(rng.standard_normal((d, block)), locked, basis)
        if fresh.shape[1]:
            basis, image = np.hstack([basis, fresh]), np.hstack([image, applied(fresh)])
        if basis.shape[1] > max_basis:
            keep = k + 2 * block
            theta, y = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
            basis, image = basis @ y[:, ::-1][:, :keep], image @ y[:, ::-1][:, :keep]
    else:
        raise ArithmeticError(f"{locked.shape[1]} of {k} eigenpairs after {MAX_ROUNDS} rounds")
    order = np.argsort(-values, kind="stable")[:k]
    return values[order], locked[:, order], {"passes": passes, "residual": float(worst), "rounds": rounds}


def whiten(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation decimal, whitened, explained, identity_error) per vector and component."""
    kind = table.schema[id_col].dataType
    data = prepare(table, id_col, vector_col)
    schema = (f"vec_id {kind.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, "
              "explained double, identity_error double")
    if not data.n:
        return table.sparkSession.createDataFrame([], schema)
    d, n, centre = data.d, data.n, data.centre()
    trace = float(data.total(lambda c: np.array([(c * c).sum()]), (1,))[0])
    if not trace:
        return table.sparkSession.createDataFrame([], schema)
    values, axes, _ = eigenpairs(data.product, d, components)
    real = values > 1e-13 * trace
    values, axes = values[real], axes[:, real]
    k = values.size
    scaled, explained = axes / np.sqrt(values), values / trace
    mean = data.total(lambda c: (c @ scaled).sum(axis=0), (k,))

    def spread(c: np.ndarray) -> np.ndarray:
        w = c @ scaled - mean
        return w.T @ w

    identity_error = float(np.abs(data.total(spread, (k, k)) - np.eye(k)).max())
    whole = np.array([s // n for s in data.sums], np.int64)
    rest = np.array([s % n for s in data.sums], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step := max(1, CHUNK // (d + k))):
                rows = batch.slice(at, step)
                x, m = matrix(rows.column(1), d), rows.num_rows
                off = x - whole
                far = n * np.abs(off).max(initial=0).item() + n
                if far * far * d < 1 << 63:
                    deviation = pa.array(((n * off - rest) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
                else:
                    exact = ((n * off.astype(object) - rest.astype(object)) ** 2).sum(axis=1)
                    deviation = pa.array([str(e) for e in exact]).cast(pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, n)), deviation.take(each), pa.array((centre(x) @ scaled).ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return data.rows.select("vec_id", "x").mapInArrow(run, schema)
