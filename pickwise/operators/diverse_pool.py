"""Diverse picks out of a whole library, by lazy greedy selection.

Every pick takes the row with the largest ``(1 - lam) * gain - lam * similarity to the picks so far``. That value only falls as picks are
added, so a value computed once stays an upper bound. Rows lie in tiers, tables below the shared folder, each with the bounds its rows
had when it was written; a row moves to a newer tier only when its bound reaches the best value known, and is then held against the
picks it has not seen. The best rows of the newest tier are held by the driver, a bounded number of them, and give picks as long as
none outside can be better. Ties go to the lower ``pool_idx``, so the picks are those of the plain greedy rule, whatever the partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwise.functions.fingerprints import packed_words
from pickwise.session import cut_lineage

ACTIVE_ROWS = 2048


@dataclass
class _Tier:
    """Rows with their bounds after ``seen`` picks; those from ``cut`` on have moved to a newer tier."""

    rows: DataFrame
    seen: int
    cut: float = float("inf")


def _similarity(words: np.ndarray, size: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Largest Tanimoto of every row to any pick."""
    best = np.zeros(len(words))
    for p in picks:
        shared = np.bitwise_count(words & p).sum(axis=1, dtype=np.int64)
        union = size + int(np.bitwise_count(p).sum()) - shared
        best = np.maximum(best, shared / np.where(union > 0, union, 1))
    return best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).view(np.uint64).reshape(-1, width)


def _nearest(words: Column, picks: np.ndarray) -> Column:
    """Similarity to picks that travel with the plan: a bounded number of rows of a few hundred bytes."""
    if not len(picks):
        return F.lit(0.0)

    @F.arrow_udf("double")
    def similarity(column: pa.Array) -> pa.Array:
        x = _matrix(column, picks.shape[1])
        return pa.array(_similarity(x, np.bitwise_count(x).sum(axis=1, dtype=np.int64), picks))

    return similarity(words)


class _Active:
    """The rows the driver holds, with values that are exact after ``seen`` picks and bounds later."""

    def __init__(self, rows: pa.Table, width: int, picks: int):
        self.ids, self.row, self.score, self.gain = (np.asarray(rows[c]) for c in ("pool_idx", "row", "score", "gain"))
        self.words = _matrix(rows["words"].combine_chunks(), width) if rows.num_rows else np.zeros((0, width), dtype=np.uint64)
        self.size = np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)
        self.near, self.value = (np.asarray(rows[c]).copy() for c in ("near", "bound"))
        self.seen = np.full(len(self.ids), picks)

    def best(self, picks: np.ndarray, lam: float) -> int | None:
        """The row of largest value after all picks: the leading bound is brought up to date until it is exact."""
        while len(self.ids):
            lead = np.flatnonzero(self.value == self.value.max())
            at = int(lead[np.argmin(self.ids[lead])])
            if self.value[at] == -np.inf:
                return None
            stale = lead[self.seen[lead] < len(picks)]
            if not len(stale):
                return at
            for i in stale:
                self.near[i] = max(self.near[i], _similarity(self.words[i : i + 1], self.size[i : i + 1], picks[self.seen[i] :])[0])
                self.value[i], self.seen[i] = (1 - lam) * self.gain[i] - lam * self.near[i], len(picks)
        return None

    def take(self, at: int) -> None:
        self.value[at] = -np.inf


def _top(tier: _Tier, active: int, width: int) -> tuple[_Active, float]:
    """The first ``active`` rows of a tier whose bounds are exact, and a value that none of its other rows passes."""
    order = [F.desc("bound"), *([] if tier.seen else [F.desc("gain")]), F.asc("pool_idx"), F.asc("row")]
    rows = tier.rows.orderBy(*order).limit(active + 1).toArrow()
    rest = rows["bound"][active].as_py() if rows.num_rows > active else float("-inf")
    return _Active(rows.slice(0, active), width, tier.seen), rest


def _refresh(tiers: list[_Tier], picks: np.ndarray, taken: list[int], floor: float, lam: float) -> _Tier:
    """A new tier of all rows whose bound reaches ``floor``, brought up to date; the rest stay where they are."""
    moved = None
    for tier in tiers:
        lead = tier.rows.filter((F.col("bound") < F.lit(tier.cut)) & (F.col("bound") >= F.lit(floor)) & ~F.col("row").isin(taken))
        lead = lead.withColumn("near", F.greatest("near", _nearest(F.col("words"), picks[tier.seen :])))
        lead = lead.withColumn("bound", F.lit(1 - lam) * F.col("gain") - F.lit(lam) * F.col("near"))
        moved = lead if moved is None else moved.unionByName(lead)
        tier.cut = min(tier.cut, floor)
    tiers[:] = [t for t in tiers if t.cut > float("-inf")]
    tiers.append(_Tier(cut_lineage(moved), len(picks)))
    return tiers[-1]


def diversify_pool(
    pool: DataFrame, k: int, lam: float = 0.4, n_bits: int = 2048, fp: str = "fp", score: str = "score", active: int = ACTIVE_ROWS,
) -> DataFrame:
    """(div_rank, pool_idx, score): ``k`` diverse rows of the whole ``pool`` (pool_idx, score, on-bits ``fp``), best first.

    The first pick has the largest score; gains are scores scaled to 0..1 over the pool (0 where all are equal). Rows with a NULL or NaN
    score or a NULL id take no part; a NULL ``fp`` counts as one without bits. A repeated id may be picked once per row. A pool of fewer
    rows gives them all. ``active`` changes the number of scans, never the picks. Other columns are ignored.
    """
    width = max(1, -(-n_bits // 64))
    bits = F.coalesce(F.col(fp).cast("array<int>"), F.array().cast("array<int>"))
    value = F.col(score).cast("double")
    whole = pool.filter(F.col("pool_idx").isNotNull() & value.isNotNull() & ~F.isnan(value))
    low, high = whole.agg(F.min(value), F.max(value)).first()
    out: list[tuple[int, int, float]] = []
    if low is not None and k > 0:
        gain = (value - F.lit(low)) / F.lit(high - low) if high - low > 1e-12 else F.lit(0.0)
        rows = whole.select(F.col("pool_idx").cast("long").alias("pool_idx"), value.alias("score"), gain.alias("gain"), packed_words(bits, 64 * width).alias("words"))
        # equal rows are told apart by a number, which no longer changes once it is written
        rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("near", F.lit(0.0)).withColumn("bound", F.lit(1 - lam) * F.col("gain"))
        tiers = [_Tier(cut_lineage(rows), 0)]
        picks, taken, floor = np.zeros((0, width), dtype=np.uint64), [], float("-inf")
        held, rest = _top(tiers[0], active, width)
        at: int | None = 0
        while len(out) < k:
            if out:
                at = held.best(picks, lam)
                # other rows of the held tier are at ``rest`` or lower, rows of older tiers lower than ``floor``
                if at is None or held.value[at] <= rest or held.value[at] < floor:
                    floor = float(held.value[at]) if at is not None else float("-inf")
                    held, rest = _top(_refresh(tiers, picks, taken, floor, lam), active, width)
                    at = held.best(picks, lam)
                if at is None:
                    break
            out.append((len(out) + 1, int(held.ids[at]), float(held.score[at])))
            taken.append(int(held.row[at]))
            picks = np.vstack([picks, held.words[at : at + 1]])
            held.take(at)
    return pool.sparkSession.createDataFrame(out, "div_rank int, pool_idx long, score double")
