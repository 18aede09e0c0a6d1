"""Volumes and gains by cells against measuring everything at once."""

import numpy as np
import pytest

from pickwise.operators import regions as rg
from pickwise.operators.pareto import _skyline, _volume, hypervolume


def frame(spark, y, names):
    return spark.createDataFrame([tuple(map(float, r)) for r in y], ", ".join(f"`{n}` double" for n in names)).repartition(6)


def sphere(seed, n, d):
    v = np.abs(np.random.default_rng(seed).normal(size=(n, d)))
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.mark.parametrize("d,n", [(3, 300), (4, 120)])
@pytest.mark.parametrize("made", ["front", "ties"])
def test_volume_of_many_cells(spark, monkeypatch, d, n, made):
    monkeypatch.setattr(rg, "CELL_POINTS", 1)
    y = sphere(d, n, d) if made == "front" else np.random.default_rng(n).integers(-1, 5, (n, d)).astype(float)
    names = ["cell", "at", "v", "low"][:d]  # names that the cells use themselves
    want = pytest.approx(_volume(_skyline(y), np.zeros(d)), rel=1e-9)
    assert hypervolume(frame(spark, y, names), names, [0.0] * d).first()[0] == want
    assert hypervolume(frame(spark, y, names), names, [0.0] * d, cells=1).first()[0] == want


def test_nothing_above_the_reference(spark):
    y = np.full((5, 3), -1.0)
    assert hypervolume(frame(spark, y, "abc"), list("abc"), [0.0] * 3).first()[0] == 0.0


def test_cells_of_a_long_front_stay_small(spark):
    """No group sees more than a few hundredths of a front of twenty thousand points."""
    y = sphere(1, 20_000, 3)
    found = rg.regions(frame(spark, y, "abc"), list("abc"), [0.0] * 3, [1.0] * 3)
    sizes = found.points.groupBy("cell").count().agg({"count": "max"}).first()[0]
    assert sizes < len(y) / 25


def plain_gains(front, ids, rows, ref, k, rounding):
    held, left, out = front, sorted(range(len(ids)), key=lambda i: ids[i]), []
    base = _volume(_skyline(held), ref) if len(held) else 0.0
    while left and len(out) < k:
        gain = [_volume(_skyline(np.vstack([held, rows[j : j + 1]])), ref) - base for j in left]
        at = next(i for i, g in enumerate(gain) if g >= max(gain) - rounding * max(1.0, abs(base)))
        j = left.pop(at)
        held = np.vstack([held, rows[j : j + 1]])
        out.append((ids[j], gain[at]))
        base = _volume(_skyline(held), ref)
    return out


@pytest.mark.parametrize("d,known", [(2, 60), (2, 0), (3, 40)])
def test_lazy_gains_are_the_greedy_ones(spark, monkeypatch, d, known):
    monkeypatch.setattr(rg, "CELL_POINTS", 2)
    rng = np.random.default_rng(d + known)
    front, rows, ref = sphere(7, known, d), np.round(rng.random((40, d)) * 1.1, 1), np.full(d, 0.05)
    ids = rng.permutation(40).astype(np.int64)
    found = rg.regions(frame(spark, front, "abc"[:d]), list("abc"[:d]), ref, np.maximum(rows.max(axis=0), 1.0))
    got = rg.greedy_gains(found, ids, rows, 8, _volume, 1e-9, batch=3)
    want = plain_gains(front, ids.tolist(), rows, ref, 8, 1e-9)
    assert [g[0] for g in got] == list(range(1, 9)) and [g[1] for g in got] == [w[0] for w in want]
    assert np.allclose([g[2] for g in got], [w[1] for w in want], atol=1e-9)
