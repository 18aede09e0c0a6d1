"""Diversity re-ordering of a selected batch: high score, low similarity to what is already taken."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.operators.scale import top_k_per


def _greedy(scores: np.ndarray, bits: np.ndarray, k: int, lam: float) -> list[int]:
    span = scores.max() - scores.min()
    gain = (scores - scores.min()) / span if span > 1e-12 else np.zeros(len(scores))
    counts = bits.sum(axis=1)
    sim = np.zeros(len(scores))
    value, taken = gain.copy(), []
    while len(taken) < min(k, len(scores)):
        pick = int(np.argmax(value))
        taken.append(pick)
        inter = bits @ bits[pick]
        union = counts + counts[pick] - inter
        sim = np.maximum(sim, inter / np.where(union > 0, union, 1.0))
        value = (1 - lam) * gain - lam * sim
        value[taken] = -np.inf
    return taken


def diversify(
    selection: DataFrame, batch_keys: Sequence[str], k: int, lam: float = 0.4, n_bits: int = 2048,
    fp: str = "fp", oversample: int = 1,
) -> DataFrame:
    """Re-order each batch's best ``k * oversample`` rows and keep ``k``; all batches run in parallel.

    The batch is bounded before it is grouped, so no task sees more than ``k * oversample`` rows.
    """
    keys = list(batch_keys)
    pool = top_k_per(selection, keys, [F.desc("score"), F.asc("pool_idx")], k * oversample, "_rank")
    types = dict(selection.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in keys], "pool_idx BIGINT", "score DOUBLE", "div_rank INT"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank").reset_index(drop=True)
        bits = np.zeros((len(pdf), n_bits))
        for i, on in enumerate(pdf[fp]):
            bits[i, np.asarray(on, dtype=int)] = 1.0
        order = _greedy(pdf["score"].to_numpy(dtype=float), bits, k, lam)
        out = pdf.loc[order, [*keys, "pool_idx", "score"]].reset_index(drop=True)
        out["div_rank"] = np.arange(1, len(out) + 1)
        return out

    return pool.select(*keys, "pool_idx", "score", fp, "_rank").groupBy(*keys).applyInPandas(run, schema)
