"""The grid of cells against comparing all pairs."""

import numpy as np
import pytest

from pickwise.operators import dominance as dm
from pickwise.operators import pareto as pa


def frame(spark, y, names):
    rows = [tuple(float(v) for v in r) for r in y]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` DOUBLE" for n in names)).repartition(5)


def plain(y):
    y = np.unique(y, axis=0)
    return sorted(tuple(p) for p in y if not ((y >= p).all(axis=1) & (y > p).any(axis=1)).any())


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("dim,values,cells", [(1, 50, 4096), (2, 9, 16), (3, 1000, 4096), (4, 6, 64), (5, 1000, 32), (14, 4, 4096)])
def test_equals_all_pairs(spark, dim, values, cells):
    y = np.random.default_rng(dim).integers(0, values, (300, dim)).astype(float)
    names = [f"v{i}" for i in range(dim)]
    assert got(dm.undominated(frame(spark, y, names), names, cells, part_rows=7)) == plain(y)


def test_everything_is_on_the_front(spark):
    x = np.random.default_rng(1).permutation(900).astype(float)
    y = np.column_stack([x, -x])
    assert got(dm.undominated(frame(spark, y, ["a", "b"]), ["a", "b"], 100)) == plain(y)


def test_names_that_the_grid_uses_itself(spark):
    y = np.random.default_rng(2).integers(0, 9, (80, 4)).astype(float)
    names = ["cell", "part", "id", "o1"]
    assert got(dm.undominated(frame(spark, y, names), names)) == plain(y)


def test_infinities_ties_and_no_rows(spark):
    y = np.array([[1, 2], [1, 2], [np.inf, 0], [-np.inf, 9], [0, -np.inf], [1, 1]], dtype=float)
    assert got(dm.undominated(frame(spark, y, ["a", "b"]), ["a", "b"])) == plain(y)
    assert got(dm.undominated(frame(spark, y[:0], ["a", "b"]), ["a", "b"])) == []


def test_a_third_of_all_rows_in_one_cell(spark):
    rng = np.random.default_rng(3)
    y = np.vstack([np.repeat([[5.0, 5.0, 5.0]], 300, axis=0), rng.random((300, 3)) * 1e-9 + 5, rng.random((300, 3)) * 10])
    names = ["a", "b", "c"]
    assert got(dm.undominated(frame(spark, y, names), names, 64, part_rows=20)) == plain(y)
    assert got(pa.front_points(frame(spark, y, names), names)) == plain(y)


def test_far_fewer_pairs_than_all(spark):
    """Twenty thousand points of which most are beaten by whole cells, and ten thousand that are all on the front."""
    rng = np.random.default_rng(4)
    for y in (rng.random((20_000, 4)), np.abs(v := rng.normal(size=(10_000, 4))) / np.linalg.norm(v, axis=1)[:, None]):
        cuts = np.quantile(y, np.arange(1, 8) / 8, axis=0)
        cells, counts = np.unique(np.stack([(y[:, i, None] >= cuts[:, i]).sum(axis=1) for i in range(4)], axis=1), axis=0, return_counts=True)
        assert dm.grid_of(cells, counts).work < len(y) ** 2 / 10
