"""Pareto fronts and dominated hypervolume, larger being better on every objective."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pickwise.operators.dominance import undominated
from pickwise.operators.regions import CELLS, dominated, regions
from pickwise.operators.scale import BLOCK_ROWS
from pickwise.session import cut_lineage

BUCKETS = 64


def dominated_by(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which points some other point beats: at least equal everywhere and better somewhere."""
    out = np.zeros(len(points), dtype=bool)
    for s in range(0, len(points), 256):
        p = points[s : s + 256]
        ge = (others[None, :, :] >= p[:, None, :]).all(axis=2)
        gt = (others[None, :, :] > p[:, None, :]).any(axis=2)
        out[s : s + 256] = (ge & gt).any(axis=1)
    return out


def _skyline(points: np.ndarray) -> np.ndarray:
    """Distinct rows of the front. By falling sum a later row beats an earlier one only when rounding
    makes their sums equal; such a row stays for the caller's full comparison."""
    points = np.unique(points, axis=0)
    points = points[np.argsort(-points.sum(axis=1), kind="stable")]
    front = points[:0]
    for s in range(0, len(points), 512):
        part = points[s : s + 512]
        part = part[~dominated_by(part, front)] if len(front) else part
        part = part[~dominated_by(part, part)]
        front = np.vstack([front, part])
    return front


def _local_skyline(names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        front = np.zeros((0, len(names)))
        for pdf in batches:
            front = _skyline(np.vstack([front, pdf[names].to_numpy(dtype=np.float64)]))
        yield pd.DataFrame(front, columns=names)

    return run


def local_fronts(df: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """Every partition's own skyline, pinned: one pass that drops nearly all rows and never a front row."""
    names = list(objectives)
    schema = ", ".join(f"{n} DOUBLE" for n in names)
    clean = df.select(*[F.col(n).cast("double").alias(n) for n in names]).dropna()
    return cut_lineage(clean.mapInPandas(_local_skyline(names), schema).distinct())


def front_points(df: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """Distinct objective vectors of the front.

    One pass keeps each partition's own skyline; the survivors are compared cell by cell, so a front of any size needs neither one big
    task nor the driver.
    """
    return undominated(local_fronts(df, objectives), objectives)


def pareto_front(df: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """Rows no other row dominates; equal rows all stay."""
    front = front_points(df, objectives)
    renamed = front.select(*[F.col(n).alias(f"_{n}") for n in objectives])
    same = [F.col(n).cast("double") == F.col(f"_{n}") for n in objectives]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return df.join(renamed, cond, "left_semi")


def reference_point(df: DataFrame, objectives: Sequence[str], margin: float = 0.05) -> DataFrame:
    """``lo - margin * (hi - lo)`` per objective; zeros when there are no rows."""
    def one(n: str):
        lo, hi = F.min(n), F.max(n)
        return F.coalesce(lo - F.lit(float(margin)) * (hi - lo), F.lit(0.0)).alias(n)

    return df.agg(*[one(n) for n in objectives])


def hypervolume_2d(
    df: DataFrame, x: str, y: str, ref: tuple[float, float], buckets: int = BUCKETS,
    one_bucket: int = BLOCK_ROWS,
) -> DataFrame:
    """Area dominated by the points above ``ref``.

    The area is the integral over x of the best y at or beyond x. A first pass keeps each partition's
    skyline. Where many points are left, x is cut into buckets; each bucket integrates alone, given
    the best y of the buckets beyond it, so no global sort is needed.
    """
    rx, ry = (float(r) for r in ref)
    inside = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(
        (F.col("x") > rx) & (F.col("y") > ry)
    )
    pts = local_fronts(inside, ["x", "y"]).groupBy("x").agg(F.max("y").alias("y"))
    edges = []
    if pts.count() > one_bucket:
        edges = pts.agg(F.percentile_approx("x", [i / buckets for i in range(1, buckets)], 10_000)).first()[0]
    edges = sorted(set(edges))
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + (F.col("x") >= F.lit(e)).cast("int")
    cut = pts.withColumn("b", bucket)
    # one row per bucket: windows over it stay tiny
    beyond = Window.orderBy(F.desc("b"))
    info = cut.groupBy("b").agg(F.max("y").alias("top"), F.max("x").alias("right")).select(
        "b",
        F.max("top").over(beyond.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"),
        F.lead("right").over(beyond).alias("below"),
    )
    w = Window.partitionBy("b").orderBy(F.desc("x"))
    height = F.greatest(F.col("carry"), F.max("y").over(w))
    left = F.coalesce(F.lead("x").over(w), F.col("below"), F.lit(rx))
    strips = cut.join(F.broadcast(info), "b").select(((F.col("x") - left) * (height - F.lit(ry))).alias("area"))
    return strips.agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("hypervolume"))


def _volume(points: np.ndarray, ref: np.ndarray) -> float:
    """Dominated volume by slicing along the last objective, for a handful of points."""
    points = points[(points > ref).all(axis=1)]
    if len(points) == 0:
        return 0.0
    if points.shape[1] == 1:
        return float(points[:, 0].max() - ref[0])
    if points.shape[1] == 2:
        p = points[np.lexsort((-points[:, 1], -points[:, 0]))]
        best = np.maximum.accumulate(p[:, 1])
        left = np.append(p[1:, 0], ref[0])
        return float(((p[:, 0] - left) * (best - ref[1])).sum())
    z = np.unique(points[:, -1])[::-1]
    total = 0.0
    for top, low in zip(z, np.append(z[1:], ref[-1])):
        beyond = points[points[:, -1] >= top][:, :-1]
        total += (top - low) * _volume(_skyline(beyond), ref[:-1])
    return total


def hypervolume(df: DataFrame, objectives: Sequence[str], ref: Sequence[float], cells: int = CELLS) -> DataFrame:
    """Dominated hypervolume for any number of objectives.

    One objective is a maximum, two the bucketed area. Above that space is cut into cells, and every cell that the front runs through is
    measured in its own group.
    """
    names, ref = list(objectives), [float(r) for r in ref]
    if len(names) == 1:
        return df.agg(F.greatest(F.coalesce(F.max(names[0]) - F.lit(ref[0]), F.lit(0.0)), F.lit(0.0)).alias("hypervolume"))
    if len(names) == 2:
        return hypervolume_2d(df, names[0], names[1], (ref[0], ref[1]))
    inside = df
    for n, r in zip(names, ref):
        inside = inside.filter(F.col(n) > r)
    front = cut_lineage(front_points(inside, names))
    top = front.agg(*[F.max(n) for n in names]).first()
    value = dominated(regions(front, names, ref, top, cells), _volume) if top[0] is not None else 0.0
    return df.sparkSession.createDataFrame([(float(value),)], "hypervolume double")


def grouped_hypervolume(df: DataFrame, by: Sequence[str], objectives: Sequence[str], ref: Sequence[float]) -> DataFrame:
    """Dominated hypervolume per group, for any number of groups in one job.

    Each partition first keeps its skyline per group, so a group brings its front and not its rows
    to one task. A group whose front is still too long for one task is integrated on its own.
    """
    by, names, corner = list(by), list(objectives), np.array([float(r) for r in ref])
    types = dict(df.dtypes)
    keys = ", ".join(f"`{c}` {types[c]}" for c in by)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(by, dropna=False, sort=False):
                pts = part[names].to_numpy(dtype=np.float64)
                pts = pts[(pts > corner).all(axis=1)]
                held[key] = _skyline(np.vstack([held[key], pts]) if key in held else pts)
        for key, pts in held.items():
            yield pd.DataFrame(pts, columns=names).assign(**dict(zip(by, key)))[[*by, *names]]

    def volume(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, _volume(_skyline(pdf[names].to_numpy(dtype=np.float64)), corner))], columns=[*by, "hypervolume"])

    values = ", ".join(f"{n} DOUBLE" for n in names)
    clean = df.select(*by, *[F.col(n).cast("double").alias(n) for n in names]).dropna(subset=names)
    fronts = cut_lineage(clean.mapInPandas(local, f"{keys}, {values}"))
    sizes = fronts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    long = sizes.filter(F.col("_n") > BLOCK_ROWS).drop("_n")
    short = fronts.join(long, by, "left_anti") if not long.isEmpty() else fronts
    out = short.groupBy(*by).applyInPandas(volume, f"{keys}, hypervolume DOUBLE")
    for g in long.collect():
        cond = F.lit(True)
        for c in by:
            cond = cond & F.col(c).eqNullSafe(F.lit(g[c]))
        one = hypervolume(fronts.filter(cond), names, ref)
        out = out.unionByName(one.select(*[F.lit(g[c]).cast(types[c]).alias(c) for c in by], "hypervolume"))
    return out
