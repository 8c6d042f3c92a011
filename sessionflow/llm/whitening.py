"""Embedding whitening by Chebyshev-filtered subspace iteration.

The covariance matrix is never formed: a pass over the fit list (each distinct
scaled vector once, written in the shared folder) returns Xc'(Xc Q) for a
block Q, with every vector centred before it is multiplied. A filter of
Chebyshev polynomials, one pass a degree, damps what lies between the lower
end of the spectrum and the block's least Ritz value; QR and Rayleigh-Ritz
follow. Rounds go on until the residual norms of the wanted pairs certify them
to double precision, and until a fresh random block, kept orthogonal to what
was found, shows nothing above the least wanted eigenvalue.

A task holds an Arrow batch and one block; what a pass returns (dimensions
times block, summed by Spark per cell) is all that reaches the driver. The
lower end comes from one more column of the block, which follows the smallest
eigenvalue by powers of (top - V). With no more dimensions than block columns
the block spans the space and one pass is exact.

Defined cases: null vectors and vectors that hold a null or a non-finite entry
are dropped; shorter vectors count as padded with zeros to the longest, empty
ones too; an entry is held to +-2**53 after scaling; rows with a null or a
repeated id are rows of their own; components of a zero eigenvalue have no
rows, so a table of one distinct vector has none; a deviation beyond a long is
null; an empty table gives an empty result. Equal eigenvalues leave their
vectors free within the space that they share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

COMPONENTS, SCALE = 4, 256
#: Block columns beyond the wanted ones, degree of a filter, rounds at most (then it raises), residual allowed relative to the top eigenvalue.
GUARD, DEGREE, ROUNDS, TOLERANCE = 28, 8, 60, 2e-15
#: Residuals that no longer fall are accepted below this: the rounding of the passes themselves.
FLOOR = 1e-12
#: Rows of a batch that are multiplied at once.
ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """A fit: ``vectors`` are unit columns by falling ``values``; ``sums`` are the exact per-dimension sums S."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int


def scaled(rows: DataFrame, vector_col: str = "embedding", scale: int = SCALE) -> Column:
    """floor(scale * entry) as longs; null for a vector that takes no part."""
    v = F.col(vector_col).cast("array<double>")
    ok = v.isNotNull() & F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(c, F.lit(0.0))))
    held = lambda c: F.greatest(F.lit(-(2.0**53)), F.least(F.lit(2.0**53), c * F.lit(float(scale))))
    return F.when(ok, F.transform(v, lambda c: F.floor(held(c)).cast("long")))


def padded(x: Column, width: int) -> Column:
    return F.when(F.size(x) < width, F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(x)))).otherwise(x)


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)


def _exact(x: np.ndarray, bound: int) -> np.ndarray:
    """``x`` as int64 where sums below ``bound`` are sure to fit, else as Python integers."""
    return x if bound < 1 << 62 else x.astype(object)


def exact_moments(fit: DataFrame, width: int) -> tuple[int, list[int], list[int]]:
    """(n, per-dimension sums, per-dimension sums of squares) as exact integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, [0] * width, [0] * width
        for _, x in _matrices(batches, width):
            top = int(np.abs(x).max(initial=0))
            x = _exact(x, top * top * len(x))
            n, s, ss = n + len(x), [a + int(b) for a, b in zip(s, x.sum(0))], [a + int(b) for a, b in zip(ss, (x * x).sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(list(map(str, s))), pa.array(list(map(str, ss)))], ["dim", "n", "s", "ss"])

    rows = fit.select("x").mapInArrow(run, "dim int, n long, s string, ss string").groupBy("dim").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("s", "ss"))).collect()
    by_dim = sorted(rows, key=lambda r: r["dim"])
    return by_dim[0]["n"], [int(r["s"]) for r in by_dim], [int(r["ss"]) for r in by_dim]


def _summed(fit: DataFrame, width: int, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over the fit list of ``part`` (a matrix of ``shape``) of its slices; added up by Spark per cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in _matrices(batches, width):
            total += part(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "v"])

    out = np.zeros(shape[0] * shape[1])
    for r in fit.select("x").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r["cell"]] = r["v"]
    return out.reshape(shape)


class _Covariance:
    """V @ block by one pass over the fit list."""

    def __init__(self, fit: DataFrame, mean: np.ndarray, n: int):
        self.fit, self.mean, self.n, self.passes = fit, mean, n, 0

    def __matmul__(self, block: np.ndarray) -> np.ndarray:
        mean, self.passes = self.mean, self.passes + 1

        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ block)

        return _summed(self.fit, len(mean), block.shape, part) / self.n


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values by falling size, vectors, V @ vectors) of the Rayleigh-Ritz step on orthonormal ``q``."""
    h = q.T @ vq
    values, w = np.linalg.eigh((h + h.T) / 2)
    return values[::-1], q @ w[:, ::-1], vq @ w[:, ::-1]


def top_pairs(v: object, width: int, wanted: int, guard: int = GUARD, degree: int = DEGREE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues and unit eigenvectors of a symmetric positive ``v``, which is only multiplied."""
    wanted = min(wanted, width)
    block, rng = min(width, wanted + guard), np.random.default_rng(0)
    if block == width:
        values, u, _ = _ritz(np.eye(width), v @ np.eye(width))
        return values[:wanted], u[:, :wanted]
    q, low = np.linalg.qr(rng.standard_normal((width, block)))[0], rng.standard_normal((width, 1))
    low /= np.linalg.norm(low)
    floor, least = 0.0, np.inf
    for _ in range(rounds):
        product = v @ np.hstack([q, low])
        values, u, vu = _ritz(q, product[:, :block])
        top = max(values[0], np.finfo(float).tiny)
        residual = np.linalg.norm(vu[:, :wanted] - u[:, :wanted] * values[:wanted], axis=0).max() / top
        if residual <= TOLERANCE or (residual <= FLOOR and residual > least / 2):  # certified, or down to the rounding of a pass
            fresh = rng.standard_normal((width, min(block, width - block)))
            for _ in range(3):  # nothing above the wanted ones outside of the block
                fresh = np.linalg.qr(fresh - u @ (u.T @ fresh))[0]
                seen = v @ fresh
                seen -= u @ (u.T @ seen)
                found, w, _ = _ritz(fresh, seen)
                fresh = seen
            if found[0] <= values[wanted - 1] * (1 + 1e-9):
                return values[:wanted], u[:, :wanted]
            q, least = np.linalg.qr(np.hstack([u[:, : block - 2], w[:, :2]]))[0], np.inf
            continue
        least = min(least, residual)
        # The lower end: Rayleigh quotient less residual of the column that follows it.
        at = float(low[:, 0] @ product[:, block])
        floor = max(0.0, at - float(np.linalg.norm(product[:, block] - at * low[:, 0])))
        upper = max(values[-1], 1e-2 * top)
        centre, half = (upper + floor) / 2, max((upper - floor) / 2, 1e-3 * top)
        before, now = u, (vu - centre * u) / half
        step = top * low - product[:, block:]
        for _ in range(degree - 1):
            low = step / max(np.linalg.norm(step), np.finfo(float).tiny)
            product = v @ np.hstack([now, low])
            before, now = now, 2 * (product[:, :block] - centre * now) / half - before
            step = top * low - product[:, block:]
        low = step / max(np.linalg.norm(step), np.finfo(float).tiny)
        q = np.linalg.qr(now)[0]
    raise ArithmeticError(f"no {wanted} certified eigenvectors after {rounds} rounds")


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of a table of vectors, fitted on each distinct scaled vector once."""
    x = vectors.select(scaled(vectors, vector_col).alias("x")).where("x is not null")
    width = x.agg(F.max(F.size("x")).alias("d")).first()["d"] or 0
    none = Whitening(0, (0,) * width, np.zeros((width, 0)), np.zeros(0), 0.0, 0.0, 0)
    if not width:
        return none
    rows = materialize(x.select(padded(F.col("x"), width).alias("x")).distinct())
    n, s, ss = exact_moments(rows, width)
    trace = sum(n * b - a * a for a, b in zip(s, ss))
    if not trace:
        return Whitening(n, tuple(s), none.vectors, none.values, 0.0, 0.0, 0)
    v = _Covariance(rows, np.array([a / n for a in s]), n)
    values, u = top_pairs(v, width, components)
    trace = trace / n**2
    real = values > 1e-12 * trace
    values, u = values[real], u[:, real]
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, tuple(s), u, values, trace, _identity_error(v, u, values), v.passes)


def _identity_error(v: _Covariance, u: np.ndarray, values: np.ndarray) -> float:
    """How far the covariance of the whitened fit list is from the identity; measured by a pass of its own."""
    mean, axes, k = v.mean, u / np.sqrt(values), len(values)

    def part(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ axes
        return np.vstack([w.T @ w, w.sum(0)])

    total = _summed(v.fit, len(mean), (k + 1, k), part) / v.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def transform(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per remaining vector and component."""
    width, k = len(model.sums), len(model.values)
    mean, axes = np.array([s / model.n for s in model.sums]) if model.n else np.zeros(width), model.vectors / np.sqrt(model.values)
    n, sums, explained, error = model.n, model.sums, model.values / model.trace if k else model.values, model.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, width):
            top = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
            off = _exact(x, top * top * width) * n - np.array(sums, dtype=np.int64 if top * top * width < 1 << 62 else object)
            deviation = [d if d < 1 << 63 else None for d in map(int, (off * off).sum(1))]
            w = (x - mean) @ axes
            each = np.repeat(np.arange(len(x)), k)
            columns = [part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n)), pa.array(deviation, pa.int64()).take(pa.array(each)), pa.array(w.ravel())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error))], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    spark = vectors.sparkSession
    if not k:
        return spark.createDataFrame([], WHITENED)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(vectors, vector_col).alias("x")).where("x is not null")
    return rows.select("vec_id", padded(F.col("x"), width).alias("x")).mapInArrow(run, WHITENED)


def op11_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return transform(vectors, fit(vectors))


QUERIES = {"op11_chebyshev_whitening": op11_chebyshev_whitening}
SQL: dict[str, str] = {}
