"""Embedding whitening: leading components of the covariance by matrix-free block subspace iteration.

No covariance matrix is built. Each Spark pass multiplies one block, Xᵀ(XQ), over the centred distinct rows; the
driver orthogonalises the product against the directions it has (QR) and takes the Ritz values and vectors of all of them,
until the residuals certify all components. Directions of earlier passes stay in the search space up to ``SPACE``
columns (then the best Ritz vectors start it anew): spectra of embeddings are nearly flat, and without them
the block would need hundreds of passes. The last pass multiplies the Ritz vectors themselves.

Vectors that take part are those of ``vectors.integers``. The covariance counts each distinct vector once. Components
whose eigenvalue is zero (to 1e-12 of the largest) have no whitening and give no rows, so a table of one distinct vector gives
none, as does an empty one. Repeated rows and null ids are kept; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.text import map_arrow
from lodestrata.llm.vectors import integers, matrix, products
from lodestrata.session import discard, materialise

#: Columns of a block for each component, and columns of the search space for each.
GUARD, SPACE = 4, 64
#: Residuals, relative to the largest eigenvalue: where the iteration ends, and where it may end if it gains no more.
FINE, COARSE = 1e-13, 1e-10
#: Rounds after which the iteration gives up.
PASSES = 1000
#: Largest sum that stays in 64 bits.
WHOLE = 1 << 62


def _ritz(basis: np.ndarray, images: np.ndarray, block: int, k: int) -> tuple:
    """(Ritz values, vectors, residuals of the first ``block``, and the largest of the first k relative to the largest value)."""
    h = basis.T @ images
    theta, u = np.linalg.eigh((h + h.T) / 2)
    theta, u = theta[::-1][:block], u[:, ::-1][:, :block]
    ritz = basis @ u
    residual = images @ u - ritz * theta
    return theta, ritz, residual, np.linalg.norm(residual[:, :k], axis=0).max() / max(abs(theta[0]), np.finfo(float).tiny)


def leading(multiply: Callable[[np.ndarray], np.ndarray], width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns) of a symmetric operator that is known by its products alone."""
    k = min(k, width)
    block, space = min(width, GUARD * k), min(width, SPACE * k)
    basis, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((width, block)))
    images, last = multiply(basis), np.inf
    for _ in range(PASSES):
        theta, ritz, residual, worst = _ritz(basis, images, block, k)
        if worst <= COARSE or basis.shape[1] + block > space:  # certify, or start anew, with products of the Ritz vectors themselves
            basis, _ = np.linalg.qr(ritz)
            images = multiply(basis)
            theta, ritz, residual, worst = _ritz(basis, images, block, k)
            if worst <= FINE or last / 2 <= worst <= COARSE:
                return theta[:k], ritz[:, :k]
            last = worst
        new = residual[:, np.linalg.norm(residual, axis=0) > 0]
        for _ in range(2):
            new, _ = np.linalg.qr(new - basis @ (basis.T @ new))
        new = new[:, : width - basis.shape[1]]
        if new.shape[1]:
            basis, images = np.hstack([basis, new]), np.hstack([images, multiply(new)])
    raise RuntimeError(f"no {k} components certified in {PASSES} passes")


@dataclass
class Whitening:
    """What the passes found: distinct rows, exact sums, eigenvalues falling, components as columns, all variance, and the check."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float


def _moments(fit: DataFrame, width: int) -> tuple[int, list[int], list[int]]:
    """(n, sums, sums of squares) of each dimension, exact."""

    def part(batches):
        n, sums, squares = 0, [0] * width, [0] * width
        for batch in batches:
            x = matrix(batch.column(0), width)
            small = not len(x) or int(np.abs(x).max()) ** 2 * len(x) < WHOLE
            x = x if small else x.astype(object)
            n += len(x)
            sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0), strict=True)]
            squares = [a + int(b) for a, b in zip(squares, (x * x).sum(axis=0), strict=True)]
        exact = pa.decimal128(38, 0)
        columns = [pa.array([n] * width, pa.int64()), pa.array(range(width), pa.int32()), pa.array(map(Decimal, sums), exact), pa.array(map(Decimal, squares), exact)]
        yield pa.RecordBatch.from_arrays(columns, names=["n", "i", "s", "q"])

    got = map_arrow(fit.select("x"), part, "n long, i int, s decimal(38,0), q decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("i").collect()
    return got[0]["n"], [int(r["s"]) for r in got], [int(r["q"]) for r in got]


def fit_whitening(fit: DataFrame, width: int, k: int) -> Whitening | None:
    """Fits over a table of distinct ``x``; None if it is empty or its rows don't vary."""
    n, sums, squares = _moments(fit, width) if width else (0, [], [])
    if not n:
        return None
    trace = float(sum(n * q - s * s for s, q in zip(sums, squares, strict=True))) / n / n
    if trace == 0:
        return None
    mean = np.array([s / n for s in sums])
    values, components = leading(lambda q: products(fit, width, mean, q) / n, width, k)
    kept = values > 1e-12 * values[0]
    values, components = values[kept], components[:, kept]
    white = components / np.sqrt(values)

    def part(batches):
        total = np.zeros((white.shape[1], white.shape[1]))
        for batch in batches:
            y = (matrix(batch.column(0), width) - mean) @ white
            total += y.T @ y
        at = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].ravel(), pa.int32()), pa.array(at[1].ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    cells = map_arrow(fit.select("x"), part, "i int, j int, v double").groupBy("i", "j").agg((F.sum("v") / n).alias("v")).collect()
    error = max(abs(r["v"] - (r["i"] == r["j"])) for r in cells)
    return Whitening(n, sums, values, components, trace, error)


def whiten(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 4, scale: int = 256) -> DataFrame:
    """(id, component, n, deviation decimal, whitened, explained, identity_error), a row for each vector and component."""
    found, width = integers(df, id_column, vector_column, scale)
    kind = found.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = materialise(found, "vectors")
    fit = materialise(rows.select("x").distinct(), "distinct-vectors")
    model = fit_whitening(fit, width, k)
    discard(fit)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    n, mean, white = model.n, np.array([s / model.n for s in model.sums]), model.components / np.sqrt(model.values)
    parts, squares = white.shape[1], sum(s * s for s in model.sums)
    widest = max(map(abs, model.sums))

    def project(batches):
        for batch in batches:
            x = matrix(batch.column(1), width)
            if not len(x):
                continue
            small = int(np.abs(x).max()) * max(widest, int(np.abs(x).max())) * width < WHOLE
            y = x if small else x.astype(object)
            own, cross = (y * y).sum(axis=1), y @ np.array(model.sums, dtype=y.dtype)
            far = [n * n * int(a) - 2 * n * int(b) + squares for a, b in zip(own, cross, strict=True)]
            each = np.repeat(np.arange(len(x)), parts)
            exact = pa.array([Decimal(v) if v < 10**38 else None for v in far], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, parts + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n)), exact.take(pa.array(each)),
                 pa.array(((x - mean) @ white).ravel()), pa.array(np.tile(model.values / model.trace, len(x))), pa.array(np.full(len(each), model.identity_error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return map_arrow(rows.select("id", "x"), project, schema)
