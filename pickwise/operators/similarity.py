"""Similarity of candidates to a reference set, as a map-only scan of the candidates.

References travel in blocks of bounded size. One block is the usual case (a pending or chosen batch);
a larger reference set means further scans, never pairs and never a bigger broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwise.operators.scale import blocks

REFERENCE_BLOCK = 8192
_CHUNK = 2048


def _rows_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row number of every list element, and the elements."""
    lengths = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy(zero_copy_only=False)


def _bit_matrix(rows: np.ndarray, bits: np.ndarray, n: int, n_bits: int) -> np.ndarray:
    m = np.zeros((n, n_bits), dtype=np.float32)
    m[rows, bits] = 1.0
    return m


def _best(x: np.ndarray, px: np.ndarray, refs: np.ndarray, pr: np.ndarray) -> np.ndarray:
    """Largest Tanimoto per row of ``x``. References come in popcount order: blocks whose popcount
    ratio cannot beat what every row already has are skipped."""
    best = np.zeros(len(x))
    for s in range(0, len(refs), _CHUNK):
        r, p = refs[s : s + _CHUNK], pr[s : s + _CHUNK].astype(np.float64)
        low, high = p[0], p[-1]
        bound = np.where(px < low, px / max(low, 1.0), np.where(px > high, high / np.maximum(px, 1.0), 1.0))
        rows = np.flatnonzero(bound > best)
        if len(rows) == 0:
            continue
        inter = (x[rows] @ r.T).astype(np.float64)
        union = px[rows, None] + p[None, :] - inter
        best[rows] = np.maximum(best[rows], (inter / np.where(union > 0, union, 1.0)).max(axis=1))
    return best


def _bit_similarity(spark, block: list, n_bits: int):
    sizes = np.array([len(b[0] or ()) for b in block])
    order = np.argsort(sizes, kind="stable")
    rows = np.repeat(np.arange(len(block)), sizes[order])
    bits = np.concatenate([np.asarray(block[i][0] or (), dtype=np.int64) for i in order]) if len(block) else np.zeros(0, int)
    shared = spark.sparkContext.broadcast((rows, bits, sizes[order]))

    @F.arrow_udf("double")
    def similarity(fp: pa.Array) -> pa.Array:
        r_rows, r_bits, r_sizes = shared.value
        refs = _bit_matrix(r_rows, r_bits, len(r_sizes), n_bits)
        out = np.zeros(len(fp))
        for s in range(0, len(fp), _CHUNK):
            part = fp.slice(s, _CHUNK)
            at, on = _rows_of(part)
            x = _bit_matrix(at, on, len(part), n_bits)
            out[s : s + _CHUNK] = _best(x, x.sum(axis=1, dtype=np.float64), refs, r_sizes)
        return pa.array(out)

    return similarity


def _dense_similarity(spark, block: list):
    shared = spark.sparkContext.broadcast(np.array([b[0] for b in block], dtype=np.float64))

    @F.arrow_udf("double")
    def similarity(vec: pa.Array) -> pa.Array:
        refs = shared.value
        out = np.zeros(len(vec))
        for s in range(0, len(vec), _CHUNK):
            part = vec.slice(s, _CHUNK)
            x = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
            best = np.zeros(len(part))
            for r in range(0, len(refs), _CHUNK):
                some = refs[r : r + _CHUNK]
                inter = x @ some.T
                union = x.sum(axis=1)[:, None] + some.sum(axis=1)[None, :] - inter
                best = np.maximum(best, (inter / np.where(union > 0, union, 1.0)).max(axis=1))
            out[s : s + _CHUNK] = best
        return pa.array(out)

    return similarity


def max_tanimoto(
    candidates: DataFrame, refs: DataFrame, fp: str = "fp", n_bits: int = 2048, name: str = "max_sim",
    dense: bool = False, block: int = REFERENCE_BLOCK,
) -> DataFrame:
    """Largest Tanimoto similarity of each candidate to any reference; 0 with no references.

    ``dense`` takes numeric vectors instead of on-bit lists: sum(ab) / (sum(a) + sum(b) - sum(ab)).
    """
    spark = candidates.sparkSession
    best: Column = F.lit(0.0)
    terms = []
    for rows in blocks(refs.select(fp), block):
        udf = _dense_similarity(spark, rows) if dense else _bit_similarity(spark, rows, n_bits)
        terms.append(udf(F.col(fp)))
    if terms:
        best = F.greatest(F.lit(0.0), *terms)
    return candidates.withColumn(name, best)


def pending_penalty(
    scored: DataFrame, pending: DataFrame | None, lam: float = 0.5, score: str = "score", **kw
) -> DataFrame:
    """``score - lam * similarity`` to what is already being evaluated; unchanged when there is nothing."""
    if pending is None or lam <= 0:
        return scored
    return (
        max_tanimoto(scored, pending, name="_sim", **kw)
        .withColumn(score, F.col(score) - F.lit(float(lam)) * F.col("_sim"))
        .drop("_sim")
    )


def gather(candidates: DataFrame, ids: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns of the listed candidates; repeated ids keep their multiplicity."""
    return ids.select("pool_idx").join(candidates.select("pool_idx", *columns), "pool_idx")
