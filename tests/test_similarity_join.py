"""The join on rare bits against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from pickwise.operators.similarity_join import best_similarity

ROWS = "pool_idx long, fp array<int>, packed string, facts string, words string"


def frame(spark, rows):
    return spark.createDataFrame([(i, fp, "x", "y", "z") for i, fp in rows], ROWS)


def plain(rows, refs, apart):
    out = []
    for i, fp in rows:
        a, best = set(fp or ()), 0.0
        for j, other in refs:
            b = set(other or ())
            if (a | b) and not (apart and i == j):
                best = max(best, len(a & b) / len(a | b))
        out.append((i, round(best, 12)))
    return sorted(out, key=str)


def made(seed, n, n_bits, sizes):
    rng = random.Random(seed)
    centres = [rng.sample(range(n_bits), max(sizes)) for _ in range(5)]
    rows = []
    for i in range(n):
        size = rng.choice(sizes)
        rows.append((i, sorted({*rng.sample(rng.choice(centres), size // 2 + 1), *rng.sample(range(n_bits), size // 3), 7})))  # bit 7 is in all
    return rows + [(n, []), (n + 1, None), (n + 2, [3]), (n + 3, rows[0][1]), (n + 3, rows[0][1])]


def got(df):
    return sorted(((r.pool_idx, round(r.max_sim, 12)) for r in df.collect()), key=str)


@pytest.mark.parametrize("n_bits,sizes,list_rows", [(64, [3, 9, 30], 4), (256, [12, 60], 1000), (100, [1, 2, 50], 7)])
def test_equals_all_pairs(spark, n_bits, sizes, list_rows):
    rows, refs = made(1, 70, n_bits, sizes), made(2, 60, n_bits, sizes)
    out = best_similarity(frame(spark, rows).repartition(4), frame(spark, refs).repartition(3), n_bits=n_bits, list_rows=list_rows)
    assert out.columns == [*frame(spark, []).columns, "max_sim"]
    assert got(out) == plain(rows, refs, False)


def test_library_against_itself(spark):
    rows = made(3, 80, 128, [5, 20, 40])
    df = frame(spark, rows)
    assert got(best_similarity(df, df, n_bits=128, apart=True, list_rows=10)) == plain(rows, rows, True)


@pytest.mark.parametrize("levels", [(0.0,), (0.9, 0.1, 0.0)])
def test_levels_do_not_matter(spark, levels):
    rows, refs = made(4, 40, 64, [4, 12]), made(5, 40, 64, [4, 12])
    assert got(best_similarity(frame(spark, rows), frame(spark, refs), n_bits=64, levels=levels)) == plain(rows, refs, False)


def test_levels_must_end_at_zero(spark):
    df = frame(spark, [(1, [1])])
    with pytest.raises(ValueError, match="fall to 0"):
        best_similarity(df, df, levels=(0.5,))


def test_no_rows_and_no_references(spark):
    some, none = frame(spark, [(1, [1, 2]), (2, [])]), frame(spark, [])
    assert got(best_similarity(some, none, n_bits=64)) == [(1, 0.0), (2, 0.0)]
    assert got(best_similarity(none, some, n_bits=64)) == []


def test_many_copies_are_one_kind(spark):
    """A third of all rows are one fingerprint, and one bit is in every row."""
    rows = [(i, [7, 8, 9, 10]) for i in range(60)] + made(6, 100, 64, [6, 10])[:100]
    rows = [(k, fp) for k, (_, fp) in enumerate(rows)]
    df = frame(spark, rows).repartition(12)
    assert got(best_similarity(df, df, n_bits=64, apart=True, list_rows=5)) == plain(rows, rows, True)


def test_plan_has_no_python(spark):
    df = frame(spark, made(8, 30, 64, [4, 9]))
    plan = best_similarity(df, df.filter(F.col("pool_idx") < 10), n_bits=64)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("scan_rows", [8, 1000])
def test_dense_fingerprints_are_scanned_once(spark, monkeypatch, scan_rows):
    """Half of all bits are set: lists would hold every pair many times, so all pairs are looked at, block by block."""
    from pickwise.operators import similarity_join as sj

    scans, scan = [], sj._scan
    monkeypatch.setattr(sj, "SCAN_ROWS", scan_rows)
    monkeypatch.setattr(sj, "_scan", lambda *a: scans.append(1) or scan(*a))
    rng = random.Random(12)
    rows = [(i, sorted(rng.sample(range(128), rng.choice([1, 60, 64, 70])))) for i in range(90)] + [(90, []), (91, None)]
    df = frame(spark, rows)
    assert got(best_similarity(df, df, n_bits=128, apart=True)) == plain(rows, rows, True)
    assert got(best_similarity(df, df.filter("pool_idx < 3"), n_bits=128)) == plain(rows, rows[:3], False)
    assert scans
