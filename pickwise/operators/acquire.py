"""Acquisition strategies: score feasible candidates and take the best batch.

Every strategy is ``f(predictions, k, params) -> selection(rank, pool_idx, score, strategy)``.
``predictions`` holds ``pool_idx`` and ``mean_i`` / ``std_i`` per objective; ties go to the lower id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pickwise.functions.hashing import hash32, seeded_uniform
from pickwise.operators.pareto import _volume, front_points
from pickwise.operators.regions import greedy_gains, regions
from pickwise.operators.scale import TOP_LIMIT, global_index, top_k
from pickwise.operators.similarity import pending_penalty
from pickwise.session import cut_lineage

SPAN_FLOOR = 1e-9
CANDIDATE_CAP = 400
VOLUME_ROUNDING = 1e-9
RANK_LIMIT = 100_000
WIDE_LIMIT = 1_000


@dataclass(frozen=True)
class Params:
    n_objectives: int = 1
    beta: float = 1.0
    weights: tuple[float, ...] | None = None
    seed: int = 0
    labels: DataFrame | None = None  # agg_i columns of the current labels
    ref_point: tuple[float, ...] | None = None
    pending: DataFrame | None = None  # fingerprints under evaluation
    pending_lambda: float = 0.5
    similarity: dict = field(default_factory=dict)  # fp, n_bits, dense
    candidate_cap: int = CANDIDATE_CAP
    keep: tuple[str, ...] = ()  # columns the selection takes along, so they need no second scan


Strategy = Callable[[DataFrame, int, Params], DataFrame]


def normalized(value: Column, lo: float | None, hi: float | None) -> Column:
    """Min-max scaling; a span of practically zero divides by one."""
    lo, hi = lo or 0.0, hi or 0.0
    span = hi - lo if hi - lo > SPAN_FLOOR else 1.0
    return (value - F.lit(float(lo))) / F.lit(float(span))


def ranked(selection: DataFrame, k: int, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rank 1..k by falling score; a batch too long for one sort is numbered by range."""
    cols = ["rank", "pool_idx", "score", "strategy", *keep]
    out = selection.withColumn("strategy", F.lit(name))
    order = [F.desc("score"), F.asc("pool_idx")]
    if k <= RANK_LIMIT:
        return out.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(*cols)
    return global_index(out, order, "_p").withColumn("rank", F.col("_p") + 1).select(*cols)


def objective_ranges(predictions: DataFrame, p: Params) -> list[tuple[float, float]]:
    """(lowest, highest) per objective: the labels' range, or the raw predicted means' when nothing is labelled."""
    def ends(df: DataFrame, prefix: str) -> list[tuple[float, float]]:
        row = df.agg(*[f(f"{prefix}{i}") for i in range(p.n_objectives) for f in (F.min, F.max)]).first()
        return [(row[2 * i], row[2 * i + 1]) for i in range(p.n_objectives)]

    known = ends(p.labels, "agg") if p.labels is not None else [(None, None)]
    return known if known[0][0] is not None else ends(predictions, "mean")


def weighted_score(predictions: DataFrame, p: Params, beta: float, weights: Sequence[float]) -> DataFrame:
    """Weighted sum of normalised ``mean + beta * std``, less the pending penalty."""
    r = objective_ranges(predictions, p)
    score = None
    for i in range(p.n_objectives):
        value = F.col(f"mean{i}") + F.lit(float(beta)) * F.col(f"std{i}") if beta else F.col(f"mean{i}")
        term = normalized(value, *r[i]) * F.lit(float(weights[i]))
        score = term if score is None else score + term
    return pending_penalty(predictions.withColumn("score", score), p.pending, p.pending_lambda, **p.similarity)


def _weights(p: Params) -> tuple[float, ...]:
    return p.weights or (1.0 / p.n_objectives,) * p.n_objectives


def random_batch(predictions: DataFrame, k: int, p: Params) -> DataFrame:
    """A sample without replacement: the k largest seeded hashes.

    A longer list that takes columns along is cut by its hashes first; Spark's top-k would send k whole rows of every partition to one task.
    """
    drawn = predictions.select("pool_idx", *p.keep, seeded_uniform(p.seed, F.col("pool_idx")).alias("score"))
    return ranked(top_k(drawn, "score", k, limit=WIDE_LIMIT if p.keep else TOP_LIMIT), k, "random", p.keep)


def greedy_batch(predictions: DataFrame, k: int, p: Params) -> DataFrame:
    return ranked(top_k(weighted_score(predictions, p, 0.0, _weights(p)), "score", k), k, "greedy", p.keep)


def simplex_weights(spark, n: int, seed: int) -> tuple[float, ...]:
    """Random weights that sum to one, from the seeded hash of the objective number."""
    raw = spark.range(n).orderBy("id").select(seeded_uniform(seed, F.lit("w"), F.col("id"))).collect()
    total = sum(r[0] for r in raw)
    return tuple(r[0] / total for r in raw)


def weighted_batch(predictions: DataFrame, k: int, p: Params) -> DataFrame:
    w = simplex_weights(predictions.sparkSession, p.n_objectives, p.seed)
    return ranked(top_k(weighted_score(predictions, p, 0.0, w), "score", k), k, "weighted", p.keep)


def ucb_batch(predictions: DataFrame, k: int, p: Params) -> DataFrame:
    return ranked(top_k(weighted_score(predictions, p, p.beta, _weights(p)), "score", k), k, "ucb", p.keep)


def optimistic(predictions: DataFrame, p: Params) -> DataFrame:
    cols = [(F.col(f"mean{i}") + F.lit(float(p.beta)) * F.col(f"std{i}")).alias(f"o{i}") for i in range(p.n_objectives)]
    extra = [c for c in (*p.keep, p.similarity.get("fp", "fp")) if c in predictions.columns]
    return predictions.select("pool_idx", *cols, *dict.fromkeys(extra))


def pareto_batch(predictions: DataFrame, k: int, p: Params) -> DataFrame:
    """Greedy hypervolume gain over optimistic values.

    The best ``candidate_cap`` rows by penalised sum go on; the pending penalty only decides which. Gains are measured cell by cell against
    the labels' front, which stays on the cluster; the driver holds the capped rows alone.
    """
    if p.ref_point is None:
        raise ValueError("the pareto strategy needs a reference point")
    spark, names = predictions.sparkSession, [f"o{i}" for i in range(p.n_objectives)]
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    rated = pending_penalty(optimistic(predictions, p).withColumn("score", total), p.pending, p.pending_lambda, **p.similarity)
    capped = cut_lineage(top_k(rated, "score", p.candidate_cap))
    some = capped.select("pool_idx", *names).toArrow()
    rows = np.stack([np.asarray(some[n]) for n in names], axis=1) if some.num_rows else np.zeros((0, len(names)))
    front = spark.createDataFrame([], ", ".join(f"{n} double" for n in names))
    if p.labels is not None:
        front = cut_lineage(front_points(p.labels.select(*[F.col(f"agg{i}").alias(n) for i, n in enumerate(names)]), names))
    ref = np.array(p.ref_point, dtype=np.float64)
    highest = front.agg(*[F.max(n) for n in names]).first()
    top = np.max([ref + 1e-9, *rows, *([list(highest)] if highest[0] is not None else [])], axis=0)
    picks = greedy_gains(regions(front, names, ref, top), np.asarray(some["pool_idx"]), rows, k, _volume, VOLUME_ROUNDING)
    picked = spark.createDataFrame(picks, "rank INT, pool_idx BIGINT, score DOUBLE")
    if p.keep:
        picked = picked.join(capped.select("pool_idx", *p.keep), "pool_idx")
    return picked.select("rank", "pool_idx", "score", F.lit("pareto").alias("strategy"), *p.keep)


STRATEGIES: dict[str, Strategy] = {
    "random": random_batch,
    "greedy": greedy_batch,
    "weighted": weighted_batch,
    "ucb": ucb_batch,
    "pareto": pareto_batch,
}


def register_strategy(name: str, strategy: Strategy) -> None:
    STRATEGIES[name.lower()] = strategy


def strategy(name: str | Strategy) -> Strategy:
    """A strategy by name; a callable is taken as it is."""
    if callable(name):
        return name
    try:
        return STRATEGIES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown acquisition: {name}") from None


def initial_batch(
    available: DataFrame, n_library: int, fraction: float, seed: int, plate_limit: int | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Random first batch of ``max(1, int(fraction * n))`` available candidates, within one plate."""
    k = max(1, int(fraction * n_library))
    if plate_limit is not None:
        k = min(k, plate_limit)
    return random_batch(available, k, Params(seed=seed, keep=keep))


def sample_order(seed: int, *parts: Column) -> Column:
    """Sort key for sampling without replacement."""
    return hash32(F.concat_ws(":", *[c.cast("string") for c in parts], F.lit(str(seed))))
