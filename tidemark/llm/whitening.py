"""Whitening of embeddings by a cyclic Jacobi eigensolver.

Executors sum a vector of exact integers, then the scatter of the centred vectors; the
driver diagonalises the small covariance by Jacobi rotations, which find small eigenvalues
as accurately as large ones, and sends the whitening matrix out again.  What reaches the
driver is one matrix of the vectors' dimension.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: An entry c of an embedding becomes the integer floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries must be below this in size, so that their integers are exact in doubles.
LARGEST = 2.0**40
#: Rotations end when no entry off the diagonal is larger than this part of its diagonal entries' geometric mean, or after SWEEPS.
TOLERANCE, SWEEPS = 1e-15, 60
#: Components whose eigenvalue is below this part of the largest have no scale to whiten by.
LEAST = 1e-12


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    Each sweep turns every pair of axes once; a round-robin deals the pairs into rounds
    that share no axis, so a round's rotations are applied together.  A vector's largest
    entry is positive.
    """
    a = np.array(matrix, np.float64)
    n = len(a)
    vectors = np.eye(n)
    ring = list(range(n + n % 2))
    for _ in range(SWEEPS if n > 1 else 0):
        turned = False
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(min(p, q), max(p, q)) for p, q in zip(ring[:half], ring[:half - 1 : -1], strict=True) if max(p, q) < n]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = np.array(pairs).T
            off, dp, dq = a[p, q], a[p, p], a[q, q]
            large = np.abs(off) > TOLERANCE * np.sqrt(np.abs(dp) * np.abs(dq))
            if not large.any():
                continue
            turned = True
            p, q, off, dp, dq = (v[large] for v in (p, q, off, dp, dq))
            # The smaller of the two angles that bring the entry to 0.
            with np.errstate(over="ignore"):
                theta = (dq - dp) / (2 * off)
                t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            rows_p, rows_q = a[p], a[q]
            a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            cols_p, cols_q = a[:, p], a[:, q]
            a[:, p], a[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = dp - t * off, dq + t * off
            v_p, v_q = vectors[:, p], vectors[:, q]
            vectors[:, p], vectors[:, q] = c * v_p - s * v_q, s * v_p + c * v_q
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    values, vectors = np.diag(a)[order], vectors[:, order]
    heads = vectors[np.abs(vectors).argmax(axis=0), np.arange(n)] if n else np.zeros(0)
    return values, vectors * np.where(heads < 0, -1.0, 1.0)


@dataclass
class Whitening:
    """n vectors of the fit list, their sums, the mean, and for each component its row of the whitening matrix and its share of the variance."""

    n: int
    sums: list[int]
    mean: np.ndarray
    matrix: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Rows of whitened components of rows of integers."""
        return (x - self.mean) @ self.matrix.T


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, x array<long> of the rows whose vector holds finite numbers only; others go.

    Null ids and repeated rows stay.  An entry of LARGEST or more in size is an error.
    """
    v = F.col(column)
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    kept = vectors.select(F.col("vec_id").cast("long"), v).filter(F.coalesce(finite, F.lit(False)))
    small = F.forall(v, lambda c: F.abs(c) < LARGEST)
    x = F.transform(v, lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long"))
    return kept.select("vec_id", F.when(small, x).otherwise(F.raise_error(F.lit("an entry is too large to whiten"))).alias("x"))


def _rows(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(name))
    sizes = lists.value_lengths().to_numpy()
    if len(sizes) and sizes.min() != sizes.max():
        raise ValueError("vectors of several lengths")
    return lists.flatten().to_numpy().reshape(len(sizes), int(sizes[0]) if len(sizes) else 0)


def _summed(table: DataFrame, of: Callable[[np.ndarray], np.ndarray], kind: str) -> list:
    """Element-wise sums over all rows of what `of` makes of a block of rows; [] for no rows.

    One row leaves each task; the sums are merged element by element before the driver
    gets them.
    """

    def run(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = of(_rows(batch.slice(at, 4096)))
                if total is None:
                    total = part
                elif len(part) != len(total):
                    raise ValueError("vectors of several lengths")
                else:
                    total = total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["sums"])

    parts = table.select("x").mapInArrow(run, f"sums array<{kind}>")
    summed = parts.select(F.posexplode("sums").alias("at", "part")).groupBy("at").agg(F.sum("part").alias("sum"), F.count("*").alias("parts"))
    rows = sorted(tuple(r) for r in summed.collect())
    if len({parts for *_, parts in rows}) > 1:
        raise ValueError("vectors of several lengths")
    return [s for _, s, _ in rows]


def fit(table: DataFrame, components: int) -> Whitening | None:
    """The whitening of table(x): up to `components` of the largest eigenvalues; None for no rows.

    Components without variance (below LEAST of the largest) are left out: one vector, or
    equal ones, have none.
    """
    sums = _summed(table, lambda x: np.append(len(x), x.sum(axis=0)), "long")
    if not sums:
        return None
    n, sums = sums[0], sums[1:]
    d = len(sums)
    mean = np.array([s / n for s in sums])
    upper = np.triu_indices(d)
    # Whole parts of the means are taken off exactly, then the rest.
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])

    def scatter(x: np.ndarray) -> np.ndarray:
        centred = (x - whole) - rest
        return (centred.T @ centred)[upper]

    covariance = np.zeros((d, d))
    covariance[upper] = np.array(_summed(table, scatter, "double")) / n
    covariance = np.triu(covariance) + np.triu(covariance, 1).T
    values, vectors = jacobi(covariance)
    kept = int((values[:components] > LEAST * max(values.max(initial=0.0), 0.0)).sum())
    return Whitening(n, sums, mean, (vectors[:, :kept] / np.sqrt(values[:kept])).T, values[:kept] / np.trace(covariance) if kept else np.zeros(0))


def identity_error(table: DataFrame, model: Whitening) -> float:
    """Largest entry, in size, of the covariance of whitened table(x) minus the identity, from the whitened rows themselves."""
    k = len(model.explained)

    def moments(x: np.ndarray) -> np.ndarray:
        w = model.apply(x)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    sums = np.array(_summed(table, moments, "double")) / model.n
    mean, square = sums[:k], sums[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums over dimensions of (n * x - sum)**2 of each row."""
    s = np.array(sums, object)
    bound = max((abs(n * int(v) - int(t)) for extreme in (x.max(axis=0), x.min(axis=0)) for v, t in zip(extreme, s, strict=True)), default=0) if len(x) else 0
    if bound * bound * max(len(sums), 1) < 1 << 63:
        off = n * x - s.astype(np.int64)
        return (off * off).sum(axis=1).tolist()
    off = n * x.astype(object) - s
    return (off * off).sum(axis=1).tolist()


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation decimal(38, 0), whitened, explained, identity_error of vectors(vec_id, embedding).

    A row for each vector and component.  Vectors that are null or hold a null or an entry
    that is not finite are dropped; null ids, ties and repeated rows are kept and counted
    as they are.  All vectors must have one length.  An empty table, and a fit list
    without variance, give no rows; other columns are ignored.
    """
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    table = stash(integers(vectors), "integers")
    model = fit(table, components)
    if model is None or not len(model.explained):
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(table, model)
    k = len(model.explained)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        import decimal

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _rows(part)
                m = len(x)
                far = [decimal.Decimal(v) for v in deviations(x, model.n, model.sums)]
                take = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(take)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n, np.int64)),
                        pa.array(far, pa.decimal128(38, 0)).take(pa.array(take)),
                        pa.array(model.apply(x).ravel()),
                        pa.array(np.tile(model.explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=names,
                )

    return table.select("vec_id", "x").mapInArrow(run, schema)
