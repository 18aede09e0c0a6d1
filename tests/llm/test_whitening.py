"""Whitening against the eigenvectors of the covariance, computed plainly."""

import numpy as np
import pytest

from pickwise.llm import queries, whitening

ROWS = "vec_id long, embedding array<double>, n string, component string, x int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "clash", "clash", 0) for i, v in vectors], ROWS)


def plain(vectors, components=32):
    """vec_id -> (deviation, whitened per component up to sign), eigenvalue shares, by one eigendecomposition."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    top = x * n - s
    deviation = (top * top).sum(axis=1)
    y = top.astype(float) / n
    values, turn = np.linalg.eigh(y.T @ y / n)
    values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
    return deviation, y @ turn / np.sqrt(np.maximum(values, 1e-300)), values / np.trace(y.T @ y / n)


def check(got, vectors, components=32):
    deviation, white, share = plain(vectors, components)
    k = min(components, len(vectors[0][1]))
    table = {}
    for r in got:
        table.setdefault(r.vec_id, {})[r.component] = r
    assert len(table) == len(vectors) and all(sorted(t) == list(range(1, k + 1)) for t in table.values())
    mine = np.array([[table[i][c].whitened for c in range(1, k + 1)] for i, _ in vectors])
    for c in range(k):
        sign = np.sign(mine[:, c] @ white[:, c])
        assert np.abs(sign * mine[:, c] - white[:, c]).max() < 1e-6
    for (i, _), d in zip(vectors, deviation):
        r = table[i][1]
        assert (r.n, r.deviation) == (len(vectors), d if d < 1 << 63 else None) and r.identity_error < 1e-9
    assert np.allclose([table[vectors[0][0]][c].explained for c in range(1, k + 1)], share, rtol=1e-8)


def test_query_against_the_eigenvectors(spark):
    sf = "/root/testdata/sf0.001"
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    check(queries.QUERIES["op13_embedding_whitening"](spark, sf).collect(), vectors)


def test_ill_conditioned_rows(spark):
    """Dimensions that vary up to a million times less than others."""
    rng = np.random.default_rng(3)
    raw = rng.normal(size=(400, 6)) * np.array([1e6, 1e5, 1e4, 30, 3, 1])
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(raw)]
    got = whitening.whitened(frame(spark, vectors).repartition(5)).collect()
    check(got, vectors)


def test_directions_that_do_not_vary(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(200, 3))
    vectors = [(i, [*map(float, b), float(b[0]), 2.5]) for i, b in enumerate(base)]
    got = whitening.whitened(frame(spark, vectors), 5).collect()
    by = {c: [r for r in got if r.component == c] for c in range(1, 6)}
    assert all(r.whitened is not None for c in (1, 2, 3) for r in by[c])
    assert all(r.whitened is None and r.explained < 1e-12 for c in (4, 5) for r in by[c])
    assert got[0].identity_error < 1e-9
    _, white, _ = plain(vectors, 3)
    mine = np.array([r.whitened for r in sorted(by[1], key=lambda r: r.vec_id)])
    assert min(np.abs(mine - white[:, 0]).max(), np.abs(mine + white[:, 0]).max()) < 1e-6


def test_nulls_repeats_and_lengths(spark):
    good = [(1, [0.5, 1.0]), (2, [1.5, -1.0]), (2, [1.5, -1.0]), (None, [0.0, 3.0])]
    bad = [(3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0]), (9, [1e30, 0.0])]
    got = whitening.whitened(frame(spark, good + bad)).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), c) for i, _ in good for c in (1, 2))
    assert {r.n for r in got} == {4} and got[0].identity_error < 1e-9


@pytest.mark.parametrize("vectors", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_varies(spark, vectors):
    got = whitening.whitened(frame(spark, vectors)).collect()
    assert len(got) == 2 * len(vectors)
    assert all((r.whitened, r.explained, r.identity_error, r.deviation) == (None, 0.0, None, 0) for r in got)


def test_long_numerators():
    centre = whitening.Centre(1 << 40, np.array([5]), np.array([3]))
    x = np.array([[5], [5 + (1 << 23)]])
    assert centre.deviations(x) == [9, None]
    assert np.allclose(centre.off(x).ravel(), [0, 1 << 23])
