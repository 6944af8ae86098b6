"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become whole numbers, so means and deviations are exact. The leading eigenvectors of the covariance
come from a block of directions: each pass over the distinct vectors computes centred X'(XQ) in tasks and
sums it in Spark, a Chebyshev recurrence of such passes damps everything below the block's smallest Ritz
value, QR and Rayleigh-Ritz follow, until the residual of every wanted pair is at rounding level. The
driver holds d x block numbers, never vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.session import land

SCALE, SHIFT = 64.0, 1_000_000
LIMIT = float(1 << 52)
TOLERANCE, ENOUGH = 1e-13, 1e-10
SMALLEST = 1e-12


@dataclass
class Whitening:
    """What was fitted: size of the fit list, sums per dimension, components (columns), eigenvalues, trace, error."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers and fractions, so that x - mean loses no digits."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite entries."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector.cast("array<double>"), entry), F.lit(False))


def quantised(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) of the usable rows; x holds floor(64 c) + 1000000, shorter vectors are filled up with c = 0."""
    whole = lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-LIMIT)), F.lit(LIMIT))) + F.lit(SHIFT)
    x = F.transform(F.col(vector_col).cast("array<double>"), whole)
    out = land(rows.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), x.alias("x")), "whole_vectors")
    width = out.agg(F.max(F.size("x"))).first()[0] or 0
    return out.withColumn("x", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size("x"))))


def _blocks(batches, at: int):
    """(batch, whole numbers as rows x d) of Arrow batches."""
    for b in batches:
        if b.num_rows:
            yield b, b.column(at).flatten().to_numpy().reshape(b.num_rows, -1)


def _summed(fit: DataFrame, shape: tuple[int, ...], part) -> np.ndarray:
    """Sum over all tasks of `part(block)`; a task sends its own sum once, Spark adds them up per entry."""
    size = int(np.prod(shape))

    def run(batches):
        total = None
        for _, x in _blocks(batches, 0):
            here = part(x)
            total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total.reshape(-1).astype(float), pa.float64())], names=["at", "v"])

    out = np.zeros(size)
    for r in fit.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # d x block rows
        out[r["at"]] = r["v"]
    return out.reshape(shape)


def _totals(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension, in two halves so that 64 bits do not overflow."""
    def run(batches):
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for b, x in _blocks(batches, 0):
            n, high, low = n + b.num_rows, high + (x >> 26).sum(0), low + (x & ((1 << 26) - 1)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(high), pa.array(low), pa.array([n] * width, pa.int64())], names=["at", "high", "low", "n"])

    got = fit.mapInArrow(run, "at int, high long, low long, n long").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("high", "low", "n")]).orderBy("at").collect()  # d rows
    return (got[0]["n"] if got else 0), [(r["high"] << 26) + r["low"] for r in got]


def fit_components(fit: DataFrame, components: int = 16, degree: int = 12, rounds: int = 60, seed: int = 7) -> Whitening:
    """Mean and leading components of the column `x` (equally long arrays of long, each row counted once).

    Components with an eigenvalue of at most 1e-12 of the largest are left out, so fewer may come back. Raises
    RuntimeError if the residuals do not reach 1e-10 of the largest eigenvalue within `rounds`.
    """
    row = fit.first()
    width = len(row["x"]) if row else 0
    n, sums = _totals(fit, width) if width else (0, [])
    model = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0)
    if not n:
        return model
    whole, part = model.centre()
    centred = lambda x: (x - whole) - part
    model.trace = float(_summed(fit, (1,), lambda x: np.array([np.square(centred(x)).sum()]))[0] / n)
    if not model.trace:
        return model

    def times(q: np.ndarray) -> np.ndarray:
        def here(x):
            c = centred(x)
            return c.T @ (c @ q)

        return _summed(fit, q.shape, here) / n

    block = min(width, 2 * components + 8)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, block)))[0]
    best, floor = np.inf, None
    for turn in range(rounds):
        vq = times(q)
        small = q.T @ vq
        theta, u = np.linalg.eigh((small + small.T) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        k = min(components, int((theta > SMALLEST * theta[0]).sum()))
        residual = float(np.linalg.norm(vq - q * theta, axis=0)[:k].max() / theta[0])
        if residual < best:
            best, floor = residual, (q[:, :k].copy(), theta[:k].copy())
        if best <= TOLERANCE or block == width or (best <= ENOUGH and residual > best / 2 and turn and residual >= before / 2):
            break
        before = residual
        # Chebyshev polynomial of the operator mapped so that [0, cut] becomes [-1, 1].
        half = max(theta[-1], SMALLEST * theta[0]) / 2
        old, now = q, (vq - half * q) / half
        for _ in range(degree - 1):
            old, now = now, 2 / half * (times(now) - half * now) - old
        q = np.linalg.qr(now / np.abs(now).max(0))[0]
    else:
        if best > ENOUGH:
            raise RuntimeError(f"residual {best} after {rounds} rounds")
    model.vectors, model.values = floor
    return model


def measure(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    whole, part = model.centre()
    weights = model.vectors / np.sqrt(model.values)

    def here(x):
        w = ((x - whole) - part) @ weights
        return np.concatenate([(w.T @ w).reshape(-1), w.sum(0)])

    got = _summed(fit, (k * k + k,), here) / model.n
    mean = got[k * k :]
    return float(np.abs(got[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n x - S)^2 per row; None beyond 64 bits."""
    span = max(max(abs(n * int(lo) - s), abs(n * int(hi) - s)) for lo, hi, s in zip(x.min(0), x.max(0), sums))
    if span * span * len(sums) < 1 << 63 and n * int(np.abs(x).max()) < 1 << 63:
        return np.square(n * x - np.array(sums, np.int64)).sum(1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(r, sums)) for r in x.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def apply_whitening(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    k = len(model.values)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    whole, part = model.centre()
    weights = model.vectors / np.sqrt(model.values)
    share = model.values / model.trace

    def run(batches):
        for b, x in _blocks(batches, 1):
            m = b.num_rows
            white = ((x - whole) - part) @ weights
            each = pa.array(np.repeat(np.arange(m), k))
            far = pa.array(_deviations(x, model.n, model.sums), pa.int64())
            columns = [b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)), far.take(each), pa.array(white.reshape(-1)), pa.array(np.tile(share, m)), pa.array(np.full(m * k, model.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select("vec_id", "x").mapInArrow(run, schema)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """Rows of `apply_whitening` for every usable row, fitted on the distinct whole-number vectors of all of them.

    Rows whose vector is null or holds null or non-finite entries drop out. Vectors shorter than the longest one
    count as filled up with zeros; entries beyond 2**52 / 64 count as that. Repeated vectors are fitted once and
    each returned; null or repeated ids stay. A deviation beyond 64 bits is null. Without two different vectors
    there is no component, and no row; nor has an empty table one. Other columns are ignored.
    """
    x = quantised(rows, id_col, vector_col)
    fit = land(x.select("x").distinct(), "fit_vectors")
    model = fit_components(fit, components)
    model.identity_error = measure(fit, model)
    return apply_whitening(x, model)
