"""Points that no other point dominates, by a grid of cells.

Every objective is cut at a few quantiles, so points fall into a bounded number of cells. A cell that lies strictly above another in every
objective dominates all of its points, which go without being looked at. What is left of a cell is compared only with cells that are at
least equal in every objective: no other point can dominate it. Cells with many points are split, so a task compares a bounded part
of one cell. The driver sees one count per cell; only points that fit one part altogether are compared there at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwise.session import cut_lineage

CELLS = 4096
MOST_CUTS = 32
PART_ROWS = 2000


@dataclass(frozen=True)
class Grid:
    """``cells``: coordinates of the cells that no cell dominates; ``counts`` their points; ``above[i]`` the cells that can dominate points of cell i."""

    cells: np.ndarray
    counts: np.ndarray
    above: list[np.ndarray]

    @property
    def work(self) -> int:
        """Pairs of points that are compared."""
        return int(sum(n * self.counts[a].sum() for n, a in zip(self.counts.tolist(), self.above)))


def _place(name: str, cuts: Sequence[float]) -> Column:
    """How many cuts a value reaches."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(name)))


def _cut_points(points: DataFrame, names: Sequence[str], cells: int) -> list[list[float]]:
    """Per objective the cuts between its bins: quantiles, so that bins hold alike many points. With very many objectives only the
    first ones are cut."""
    bins = max(2, min(MOST_CUTS, int(cells ** (1 / len(names)) + 1e-9)))
    cut = names[: max(1, int(np.log(cells) / np.log(bins) + 1e-9))]
    shares = [i / bins for i in range(1, bins)]
    told = points.agg(*[F.percentile_approx(n, shares, 1000).alias(f"q{i}") for i, n in enumerate(cut)]).first()
    return [sorted(set(q or [])) for q in told] + [[] for _ in names[len(cut) :]]


def grid_of(cells: np.ndarray, counts: np.ndarray) -> Grid:
    """The cells that survive, and for each the survivors that can dominate its points."""
    alive = np.array([not (cells > c).all(axis=1).any() for c in cells], dtype=bool)
    cells, counts = cells[alive], counts[alive]
    return Grid(cells, counts, [np.flatnonzero((cells >= c).all(axis=1)) for c in cells])


def undominated(points: DataFrame, objectives: Sequence[str], cells: int = CELLS, part_rows: int = PART_ROWS) -> DataFrame:
    """The distinct rows of ``points`` (objectives as DOUBLE, no NULL or NaN) that no other row dominates: at least equal in every
    objective and larger in one. Ties are kept once. ``cells`` and ``part_rows`` change the work, never the result."""
    spark, names = points.sparkSession, [f"o{i}" for i in range(len(objectives))]
    back = [F.col(k).alias(n) for k, n in zip(names, objectives)]
    rows = cut_lineage(points.select(*[F.col(n).alias(k) for k, n in zip(names, objectives)]).distinct())
    few = rows.limit(part_rows + 1).collect()
    if len(few) <= part_rows:  # one part of one cell: nothing to spread
        y = np.array(few, dtype=np.float64).reshape(len(few), len(names))
        front = [tuple(r) for r, p in zip(few, y) if not ((y >= p).all(axis=1) & (y > p).any(axis=1)).any()]
        return spark.createDataFrame(front, rows.schema).select(*back)
    cuts = _cut_points(rows, names, cells)
    coords = [f"c{i}" for i in range(len(names))]
    placed = rows.select(*names, *[_place(n, c).alias(k) for n, c, k in zip(names, cuts, coords)])
    told = placed.groupBy(*coords).agg(F.count(F.lit(1)).alias("n")).collect()
    if not told:
        return rows.select(*back)
    grid = grid_of(np.array([[r[k] for k in coords] for r in told]), np.array([r.n for r in told]))
    parts = [-(-int(n) // part_rows) for n in grid.counts]
    # one row a cell, at most ``cells`` of them: its own number and parts, and the numbers and parts of the cells above it
    near = [([*map(int, c)], i, parts[i], [(int(a), p) for a in above for p in range(parts[a])]) for i, (c, above) in enumerate(zip(grid.cells, grid.above))]
    table = spark.createDataFrame(near, "at array<int>, cell int, parts int, above array<struct<cell:int,part:int>>")
    table = table.select(*[F.col("at")[i].alias(k) for i, k in enumerate(coords)], "cell", "parts", "above")
    kept = cut_lineage(placed.join(F.broadcast(table.drop("above")), coords).select(*names, "cell", "parts", F.monotonically_increasing_id().alias("id")))
    asked = kept.join(F.broadcast(table.select("cell", "above")), "cell").select("id", *names, F.explode("above").alias("a")).select("id", *names, "a.cell", "a.part")
    others = kept.select("cell", F.pmod(F.xxhash64(*names), F.col("parts")).cast("int").alias("part"), *[F.col(n).alias(f"x_{n}") for n in names])
    least, more = F.lit(True), F.lit(False)
    for n in names:
        least, more = least & (F.col(f"x_{n}") >= F.col(n)), more | (F.col(f"x_{n}") > F.col(n))
    beaten = asked.join(others, ["cell", "part"]).filter(least & more).select("id").distinct()
    return kept.join(beaten, "id", "left_anti").select(*back)
