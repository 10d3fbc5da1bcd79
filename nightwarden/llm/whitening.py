"""Whitening of embeddings by eigenvectors in mixed precision.

The covariance is summed in tasks: sums of the whole numbers first, then products of the centred rows, one small matrix
per task. The driver holds matrices of the dimensions only. Their eigenvectors come from a float32 solver and are then
corrected by matrix products in higher precision (Ogita and Aishima's iteration, quadratic convergence): with
R = I - X'X and S = X'AX, eigenvalues are S_ii / (1 - R_ii), and X goes to X + XE with E_ij = (S_ij + l_j R_ij) / (l_j - l_i).
Where eigenvalues are too close for that quotient, E_ij = R_ij / 2, which only makes the vectors orthogonal; each such cluster is
then solved by itself, as a small eigenproblem of A minus the cluster's centre in the space that its vectors span, and
the iteration goes on from the rotated vectors.

Entries are taken as floor(scale * c) + shift. Vectors that are null, empty, of another length than most, or hold null or
non-finite entries take no part; rows without an id do, and so does each of repeated rows. Directions without variance
can't be scaled and have no component, so one row, equal rows or an empty table give no result rows. A deviation of 2**63 or
more, which a long can't hold, is null; entries too large to be exact (beyond 2**52) raise OverflowError. Other columns are not read, whatever their
names; there is no text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .vectors import finite, matrix, of_common_width

HIGH = np.longdouble
STEPS = 12
CLOSE = 1e-10  # eigenvalues that differ by less, relative to the norm, are one cluster
SIGN_PLACES = 9


def summed(rows: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all rows of the matrix or vector that `part` makes of some of them; each task sends one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                mine = part(matrix(b.column(0), width))
                total = mine if total is None else total + mine
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "x"])

    sums = rows.select("vector").mapInArrow(run, f"i bigint, x {kind}").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i")
    return np.array([r["x"] for r in sums.collect()])


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One correction of approximate eigenvectors: (eigenvalues, vectors, cluster of each, in the order of eigenvalues)."""
    n = len(a)
    r, s = np.eye(n, dtype=HIGH) - x.T @ x, x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # divided by a small gap, rounding must not differ between the halves
    values = np.diag(s) / (1 - np.diag(r))
    order = np.argsort(-values, kind="stable")
    values, x, r, s = values[order], x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)]
    size = np.linalg.norm(a.astype(float))
    close = 2 * (np.linalg.norm((s - np.diag(np.diag(s))).astype(float)) + size * np.linalg.norm(r.astype(float)))
    close = max(close, CLOSE * size)
    gap = values[None, :] - values[:, None]
    far = np.abs(gap) > close
    e = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
    return values, x + x @ e, np.r_[0, np.cumsum(np.abs(np.diff(values)) > close)]


def solve_cluster(a: np.ndarray, x: np.ndarray, middle: float) -> np.ndarray:
    """The vectors turned within their space so that they are eigenvectors of a - middle there, the largest first."""
    inner = x.T @ (a @ x - middle * x)  # the differences within the cluster are not lost beside its centre
    _, turn = np.linalg.eigh((inner + inner.T).astype(float) / 2)
    return x @ turn[:, ::-1].astype(HIGH)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues by falling size, unit eigenvectors as columns) of a symmetric matrix, to double precision."""
    scale = float(np.abs(a).max()) or 1.0
    a = a.astype(HIGH) / scale
    _, x = np.linalg.eigh(a.astype(np.float32))
    x, last = x.astype(HIGH), np.inf
    for _ in range(STEPS):
        values, x, cluster = refine(a, x)
        for c in np.flatnonzero(np.bincount(cluster) > 1):
            at = np.flatnonzero(cluster == c)
            x[:, at] = solve_cluster(a, x[:, at], values[at].mean())
        values = (x * (a @ x)).sum(0) / (x * x).sum(0)
        wrong = max(float(np.abs(a @ x - x * values).max()), float(np.abs(x.T @ x - np.eye(len(a))).max()))
        if last / 2 <= wrong < 1e-12:
            break
        last = min(last, wrong)
    order = np.argsort(-values, kind="stable")
    return (values[order] * scale).astype(float), (x / np.sqrt((x * x).sum(0)))[:, order].astype(float)


def facing(x: np.ndarray) -> np.ndarray:
    """The columns turned so that the first of their largest entries is positive."""
    top = np.abs(np.round(x, SIGN_PLACES)).argmax(0)
    return x * np.where(x[top, np.arange(x.shape[1])] < 0, -1.0, 1.0)


def whiten(vectors: DataFrame, components: int = 32, id: str = "vec_id", vector: str = "vector", scale: int = 64,
           shift: int = 1_000_000) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each row and component up to `components`."""
    schema = f"`{id}` bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col(id).cast("long").alias("id"), finite(F.col(vector)).alias("vector")).where("vector IS NOT NULL")
    rows, width = of_common_width(rows)
    rows = cut_lineage(rows.select("vector", "id"))
    n = rows.count()
    nothing = vectors.sparkSession.createDataFrame([], schema)
    if not n:
        return nothing

    def whole(c: np.ndarray) -> np.ndarray:
        if np.abs(c).max(initial=0) * scale + abs(shift) >= 2**52:
            raise OverflowError("entries beyond 2**52")
        return (np.floor(scale * c) + shift).astype(np.int64)

    def exact_sum(c: np.ndarray) -> np.ndarray:
        x = whole(c)
        if np.abs(x).max(initial=0) * len(x) >= 2**62:
            raise OverflowError("sums beyond 2**62")
        return x.sum(0)

    totals = [int(x) for x in summed(rows, width, exact_sum, "bigint")]
    floors = np.array([t // n for t in totals])
    rest = np.array([t % n for t in totals])

    def centred(c: np.ndarray) -> np.ndarray:
        return (whole(c) - floors) - rest / n  # the difference of whole numbers is exact

    covariance = summed(rows, width, lambda c: (d := centred(c)).T @ d).reshape(width, width) / n
    covariance = (covariance + covariance.T) / 2
    values, axes = eigen(covariance)
    known = int((values > values[0] * width * 2.0**-50).sum()) if values[0] > 0 else 0
    k = min(components, known)
    if not k:
        return nothing
    axes = facing(axes[:, :k])
    root = np.sqrt(values[:k])

    def project(c: np.ndarray) -> np.ndarray:
        return centred(c) @ axes / root

    middle = summed(rows, width, lambda c: project(c).sum(0)) / n
    again = summed(rows, width, lambda c: (w := project(c) - middle).T @ w).reshape(k, k) / n
    error = float(np.abs(again - np.eye(k)).max())
    explained = values[:k] / np.trace(covariance)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for low in range(0, whole_batch.num_rows, 4096):
                b = whole_batch.slice(low, 4096)
                c, m = matrix(b.column(0), width), b.num_rows
                away = whole(c) - floors
                if (n * float(np.abs(away).max() + 1)) ** 2 * width >= 2**63:
                    away = away.astype(object)
                deviation = [x if x < 2**63 else None for x in ((n * away - rest) ** 2).sum(1).tolist()]
                deviation = pa.array(deviation, pa.int64())
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    b.column(1).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, n)), deviation.take(each), pa.array(project(c).ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    [id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, schema)
