"""Whitening of embeddings by shifted Cholesky QR.

The centred rows are never gathered: every pass sends back one Gram matrix, dimensions by dimensions, summed over Spark's partitions.
The first pass factors the Gram matrix with a small shift on its diagonal, so the factor exists for any condition; each later pass
solves the rows through the triangular factors so far, and factors the Gram matrix of what comes out, until it is the identity to
half the digits of a double, after which one more factor makes it the identity to all of them. The product of the factors, R, has the
singular values and right singular vectors of the centred rows, without the squared condition number of their covariance.

Directions in which the rows do not vary never become orthonormal. Once only they are left, the last factor is the square root of
the Gram matrix instead, which gives them the eigenvalue they have, zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.session import cut_lineage

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
PASSES = 12
NEAR = 1e-8  # a Gram matrix this near the identity is one pass from it
ROWS = 4096  # rows solved at a time inside a task


@dataclass(frozen=True)
class Whitening:
    """Component i (a column of ``vectors``) has eigenvalue ``values[i]``; ``trace`` is that of the covariance."""

    centre: "Centre"
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int

    @property
    def usable(self) -> int:
        """Components whose eigenvalue is more than rounding."""
        if not len(self.values) or self.values[0] <= 0:
            return 0
        return int(np.sum(self.values > self.values[0] * len(self.values) * np.finfo(float).eps))


def whole_rows(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) with x the whole numbers floor(64 c) + 1000000 of every row whose vector is there and finite throughout.

    Of vectors with different lengths, those of the most frequent length stay (of equally frequent ones, the longest); empty ones go, and
    so do vectors with an entry of 2^50 or more, whose sums would not be whole numbers of 64 bits. The rows are written once for the
    passes that follow.
    """
    entry = F.col(vector_col).cast("array<double>")
    sound = ~F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(1 << 50)))
    rows = cut_lineage(embeddings.filter(F.coalesce((F.size(vector_col) > 0) & sound, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(entry, lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x")
    ))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == (sizes.d if sizes else 0))


@dataclass(frozen=True)
class Centre:
    """The mean S/n, dimension by dimension, as a whole number and a remainder: S = whole n + rest."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def numerators(self, x: np.ndarray) -> np.ndarray | None:
        """n x - S as whole numbers, or None where they might pass 62 bits."""
        z = x - self.whole
        return z * self.n - self.rest if (int(np.abs(z).max(initial=0)) + 1) * self.n < 1 << 62 else None

    def off(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; rounded once, unless the numerators are too long."""
        y = self.numerators(x)
        return y / self.n if y is not None else (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list:
        """Sums over the dimensions of (n x - S)^2; None beyond 64 bits."""
        y = self.numerators(x)
        if y is not None and int(np.abs(y).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return (y * y).sum(axis=1).tolist()
        rest = self.rest.tolist()
        sums = [sum((z * self.n - r) ** 2 for z, r in zip(row, rest)) for row in (x - self.whole).tolist()]
        return [v if v < 1 << 63 else None for v in sums]


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, np.asarray(part["x"].flatten()).reshape(-1, d)


def _solved(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """y R^-1 for an upper triangular R, by substitution column after column."""
    out = np.asfortranarray(y)
    for j in range(len(r)):
        out[:, j] = (out[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """Sums of partial arrays, place by place; one row a place comes back."""
    told = parts.select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in told:
        out[r.i] = r.v
    return out


def gram(rows: DataFrame, centre: Centre, factors: list[np.ndarray]) -> np.ndarray:
    """Gram matrix of the centred rows solved through the factors, first one first: one partial matrix a task."""
    d = len(centre.whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((d, d)), False
        for _, x in _blocks(batches, d):
            y = centre.off(x)
            for r in factors:
                y = _solved(y, r)
            total, seen = total + y.T @ y, True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["part"])

    out = _summed(rows.select("x").mapInArrow(run, "part array<double>"), d * d).reshape(d, d)
    return (out + out.T) / 2


def fit(rows: DataFrame) -> Whitening:
    """Components of ``rows`` (x). No rows, or rows that never vary, have no component with an eigenvalue."""
    told = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).orderBy("i").collect()
    d, n = len(told), told[0].n if told else 0
    halves = [divmod(int(r.s), n) for r in told]
    centre = Centre(n, np.array([w for w, _ in halves], dtype=np.int64), np.array([r for _, r in halves], dtype=np.int64))
    g = gram(rows, centre, []) if d else np.zeros((0, 0))
    trace = float(np.trace(g)) / max(1, n)
    if trace <= 0:
        return Whitening(centre, np.eye(d), np.zeros(d), 0.0, 1)
    factors: list[np.ndarray] = []
    whole, before = np.eye(d), np.inf
    while True:
        off = float(np.abs(g - np.eye(d)).max()) if factors else np.inf
        if (off > NEAR and off > before / 2 and len(factors) > 2) or len(factors) == PASSES:
            # what is left does not vary: the square root of the Gram matrix ends the product
            values, turn = np.linalg.eigh(g)
            whole = np.sqrt(np.maximum(values, 0))[:, None] * (turn.T @ whole)
            break
        norm = float(np.linalg.norm(g, 2))
        r = _factor(g, norm, 0.0 if factors else min(11 * (n * d + d * (d + 1)) * np.finfo(float).eps, 1e-3) * norm)
        whole = r @ whole
        factors.append(r)
        if off <= NEAR:
            break
        before, g = off, gram(rows, centre, factors)
    _, singular, rights = np.linalg.svd(whole)
    return Whitening(centre, rights.T, singular**2 / n, trace, len(factors))


def _factor(g: np.ndarray, norm: float, shift: float) -> np.ndarray:
    """Upper triangular R with R'R = g + shift I; the shift grows until there is one."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(4 * shift, len(g) * np.finfo(float).eps * norm)


def whiten(rows: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): every row of ``rows`` on each of the first components.

    ``deviation`` is the exact sum of (n x - S)^2, NULL where that passes 64 bits. ``whitened`` is NULL for a component whose
    eigenvalue is zero but for rounding; ``explained`` is 0 if nothing varies. ``identity_error`` is the largest entry by which the
    covariance of the whitened rows, measured in a pass of its own, departs from the identity; NULL if no component varies. NULL ids,
    repeated ids and repeated rows stay, each with its own results.
    """
    centre, d = model.centre, len(model.centre.whole)
    k, usable = min(components, d), min(components, model.usable)
    scaled = model.vectors[:, :usable] / np.sqrt(model.values[:usable])
    explained = (model.values[:k] / model.trace).tolist() if model.trace > 0 else [0.0] * k
    error = _identity_error(rows, centre, scaled) if usable else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, d):
            values = np.full((len(x), k), np.nan)
            values[:, :usable] = centre.off(x) @ scaled
            flat, each = values.ravel(), pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [part["vec_id"].take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(flat), centre.n, dtype=np.int64)),
                 pa.array(centre.deviations(x), pa.int64()).take(each), pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(explained, len(x))),
                 pa.array([error] * len(flat), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _identity_error(rows: DataFrame, centre: Centre, scaled: np.ndarray) -> float:
    """The covariance of the whitened rows against the identity. Rows are centred, so their mean is rounding; it is taken off all the same."""
    d, k = scaled.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, total, seen = np.zeros((k, k)), np.zeros(k), False
        for _, x in _blocks(batches, d):
            w = centre.off(x) @ scaled
            square, total, seen = square + w.T @ w, total + w.sum(axis=0), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((square.ravel(), total))], pa.list_(pa.float64()))], ["part"])

    told = _summed(rows.select("x").mapInArrow(run, "part array<double>"), k * k + k)
    mean = told[k * k :] / centre.n
    return float(np.abs(told[: k * k].reshape(k, k) / centre.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """The fit over all sound rows of ``embeddings`` (vec_id, embedding) and their whitened form; other columns are ignored."""
    rows = whole_rows(embeddings)
    return whiten(rows, fit(rows), components)
