"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance V = XᵀX/n of the centred rows is never built or held: a pass over
the rows gives V Q for a block Q of a few orthonormal columns, as sums of
Xᵀ(XQ).  Between passes QR and Rayleigh-Ritz on the small block give components,
their eigenvalues and the residual of each.  It ends when the residuals certify
every component: residual over gap bounds the angle to the eigenvector.

A block of twice the components is enough where eigenvalues fall off.  Where they
hardly do, passes gain little, so a block whose residuals shrink too slowly is
widened to twice its columns, as far as there are dimensions.

Entries are whole numbers, so rows are centred exactly: n x - S in integers,
divided by n last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.common import Scratch, arrow_map, gather_sums

#: Bound on the angle between a component and the eigenvector, as residual over gap.
ANGLE = 1e-10
#: Below this part of the largest eigenvalue a residual, or a gap, is noise of the arithmetic.
FLOOR = 1e-13
#: Passes that a block may need by its present rate before it is widened.
PATIENCE = 8
MAX_PASSES = 200


def vectors(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, x array<long>) of the rows that take part: x = floor(1024 c) + 100000 of each entry c, as double.

    Rows leave whose vector is null, empty, holds a null or an entry that isn't
    finite.  Of vectors of several lengths those of the most frequent length stay
    (of two equally frequent the longer).  1024 c beyond 2^52 counts as 2^52.
    """
    v = F.transform(F.col(column), lambda c: c.cast("double"))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # What is beyond 2^52 is set to it: doubles tell no whole numbers apart from there on.
    far = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * 1024, F.lit(2.0**52)), F.lit(-(2.0**52)))).cast("long") + 100000)
    whole = rows.select(F.col(key).alias("key"), F.col(column)).where(F.col(column).isNotNull() & (F.size(column) > 0) & ~bad).select("key", far.alias("x"))
    lengths = whole.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return whole.where(F.size("x") == (lengths[0]["size"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """The int64 rows of an array column of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64, copy=False)


def moments(x: DataFrame) -> tuple[int, list[int]]:
    """n and the sum of each dimension, exact: low and high halves are summed apart."""
    low = (1 << 26) - 1

    def part(b: pa.RecordBatch) -> list[np.ndarray]:
        m = _matrix(b["x"])
        return [np.array([len(m)]), (m & low).sum(0), (m >> 26).sum(0)]

    found = gather_sums(x.select("x"), part)
    if found is None:
        return 0, []
    return int(found[0][0]), [(int(h) << 26) + int(a) for a, h in zip(found[1], found[2], strict=True)]


def _centre(m: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S of int64 rows: exact, in Python's integers where 64 bits might not do."""
    s = np.array(sums, object)
    if max(int(np.abs(m).max(initial=0)) * n, max(map(abs, sums))) < 1 << 62:
        return n * m - s.astype(np.int64)
    return n * m.astype(object) - s


def _deviation(c: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; None where it has no place in a long."""
    if float(np.abs(c.astype(float)).max(initial=0)) ** 2 * c.shape[1] >= 2.0**62:
        c = c.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (c * c).sum(1)]


class Components:
    """``k`` unit eigenvectors (columns of ``axes``) with falling eigenvalues, and how they were found."""

    def __init__(self, axes: np.ndarray, values: np.ndarray, trace: float, passes: int, width: int, residuals: np.ndarray):
        self.axes, self.values, self.trace = axes, values, trace
        self.passes, self.width, self.residuals = passes, width, residuals


def multiply(x: DataFrame, n: int, sums: list[int], q: np.ndarray) -> tuple[np.ndarray, float]:
    """V q and the trace of V, by one pass over the rows."""

    def part(b: pa.RecordBatch) -> list[np.ndarray]:
        y = _centre(_matrix(b["x"]), n, sums).astype(float) / n
        return [(y.T @ (y @ q)).ravel(), np.array([(y * y).sum()])]

    got = gather_sums(x.select("x"), part)
    return got[0].reshape(q.shape) / n, float(got[1][0]) / n


def fit(x: DataFrame, n: int, sums: list[int], k: int, width: int | None = None) -> Components:
    """The first ``k`` components, or as many as there are dimensions."""
    d = len(sums)
    k = min(k, d)
    width = min(d, width or 2 * k)
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    before = None
    for passes in range(1, MAX_PASSES + 1):
        w, trace = multiply(x, n, sums, q)
        h = q.T @ w
        values, u = np.linalg.eigh((h + h.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        ritz, image = q @ u, w @ u
        residuals = np.linalg.norm(image - ritz * values, axis=0)
        top = max(float(values[0]), 0.0)
        floor = FLOOR * top * np.sqrt(d)
        gaps = np.array([min([abs(values[i] - values[j]) for j in (i - 1, i + 1) if 0 <= j < len(values)], default=top) for i in range(k)])
        need = np.maximum(ANGLE * gaps, floor)
        if (residuals[:k] <= need).all() or width == d and passes > 1 and (residuals[:k] <= 100 * floor).all():
            break
        # Passes to go, if residuals shrink as they did; a new width has no rate yet.
        worst = float((residuals[:k] / np.maximum(need, 1e-300)).max())
        slow = before is not None and (worst >= before or np.log(worst) / np.log(before / worst) > PATIENCE)
        before = worst
        q = np.linalg.qr(image)[0] if np.abs(image).max() > 0 else ritz
        if slow and width < d:
            width, before = min(d, 2 * width), None
            q = np.linalg.qr(np.hstack([q, rng.standard_normal((d, width - q.shape[1]))]))[0]
    else:
        raise RuntimeError(f"residuals {residuals[:k]} after {MAX_PASSES} passes, wanted {need}")
    return Components(ritz[:, :k], values[:k], trace, passes, width, residuals[:k])


def _used(found: Components) -> np.ndarray:
    """Which components have any variance."""
    return found.values > FLOOR * 10 * max(float(found.values[0]), 0.0) if len(found.values) else np.zeros(0, bool)


def whitened(m: np.ndarray, n: int, sums: list[int], found: Components) -> tuple[np.ndarray, np.ndarray]:
    """Centred rows (n x - S) and their projections over the roots of the eigenvalues, NaN where there is no variance."""
    c = _centre(m, n, sums)
    used = _used(found)
    scale = np.where(used, 1 / np.sqrt(np.where(used, found.values, 1.0)), np.nan)
    return c, (c.astype(float) / n) @ found.axes * scale


def identity_error(x: DataFrame, n: int, sums: list[int], found: Components) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity; None if no component has variance."""
    used = _used(found)
    if not used.any():
        return None

    def part(b: pa.RecordBatch) -> list[np.ndarray]:
        z = whitened(_matrix(b["x"]), n, sums, found)[1][:, used]
        return [z.sum(0), (z.T @ z).ravel()]

    mean, square = gather_sums(x.select("x"), part)
    size = int(used.sum())
    cov = square.reshape(size, size) / n - np.outer(mean / n, mean / n)
    return float(np.abs(cov - np.eye(size)).max())


def whiten(rows: DataFrame, key: str, column: str, k: int = 8) -> DataFrame:
    """A row for each vector that takes part and each component from 1 to ``k``.

    key, component, n, deviation (sum over dimensions of (n x - S)²; null where it
    is beyond a long), whitened, explained (eigenvalue over trace) and
    identity_error.  Which rows take part: ``vectors``.  With fewer dimensions than
    ``k`` there are as many components; one of no variance (equal rows, one row)
    has null for whitened, and explained 0, or null if nothing varies at all.
    Repeated rows and null keys are rows like others; other columns are left
    behind; an empty table gives none.  Of equal eigenvalues any basis of their
    space may come.
    """
    schema = f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = Scratch(rows.sparkSession, "whiten").keep(vectors(rows, key, column), "x")
    n, sums = moments(x)
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    found = fit(x, n, sums, k)
    error = identity_error(x, n, sums, found)
    explained = [float(v) / found.trace if found.trace > 0 else None for v in np.maximum(found.values, 0)]
    size = len(found.values)

    def rows_of(b: pa.RecordBatch) -> pa.RecordBatch:
        c, z = whitened(_matrix(b["x"]), n, sums, found)
        at = np.repeat(np.arange(len(c)), size)
        return pa.RecordBatch.from_arrays(
            [
                b["key"].take(pa.array(at)),
                pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(c))),
                pa.array(np.full(len(at), n)),
                pa.array(_deviation(c), pa.int64()).take(pa.array(at)),
                pa.array(z.ravel(), from_pandas=True),
                pa.array(explained * len(c), pa.float64()),
                pa.array([error] * len(at), pa.float64()),
            ],
            [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )

    return arrow_map(x.withColumn("key", F.col("key").cast("long")), rows_of, schema)
