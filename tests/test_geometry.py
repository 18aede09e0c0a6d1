import numpy as np
import pytest

from pickwise.operators import pareto as pa
from pickwise.operators import similarity as si


def points(spark, y):
    names = [f"o{i}" for i in range(y.shape[1])]
    rows = [(i, *[float(v) for v in r]) for i, r in enumerate(y)]
    return spark.createDataFrame(rows, "id BIGINT, " + ", ".join(f"{n} DOUBLE" for n in names)).repartition(4), names


def brute_front(y):
    return {i for i, p in enumerate(y) if not any((q >= p).all() and (q > p).any() for q in y)}


@pytest.mark.parametrize("dim,values", [(2, 6), (2, 1000), (3, 5), (4, 1000)])
def test_front(spark, dim, values):
    y = np.random.default_rng(dim + values).integers(0, values, (150, dim)).astype(float)
    df, names = points(spark, y)
    assert {r.id for r in pa.pareto_front(df, names).collect()} == brute_front(y)


def test_equal_rows_all_stay(spark):
    df, names = points(spark, np.array([[1.0, 2.0], [1.0, 2.0], [0.0, 1.0]]))
    assert {r.id for r in pa.pareto_front(df, names).collect()} == {0, 1}


def test_two_parallel_fronts(spark):
    x = np.arange(40.0)
    y = np.vstack([np.column_stack([x, 40 - x]), np.column_stack([x, 30 - x])])
    df, names = points(spark, y)
    assert {r.id for r in pa.pareto_front(df, names).collect()} == brute_front(y)


def grid_volume(y, ref):
    """Volume by unit cells of an integer grid."""
    cells = np.indices([int(m) for m in y.max(axis=0) - ref]).reshape(y.shape[1], -1).T + ref
    return sum(((y > c) .all(axis=1)).any() for c in cells)


@pytest.mark.parametrize("dim", [1, 2, 3, 4])
def test_hypervolume_equals_the_grid(spark, dim):
    y = np.random.default_rng(dim).integers(-2, 7, (25, dim)).astype(float)
    df, names = points(spark, y)
    assert pa.hypervolume(df, names, [0.0] * dim).first()[0] == pytest.approx(grid_volume(y, np.zeros(dim)))


def test_hypervolume_many_buckets(spark):
    y = np.random.default_rng(9).random((500, 2))
    df, names = points(spark, y)
    whole = pytest.approx(pa._volume(y, np.zeros(2)))
    assert pa.hypervolume(df, names, [0.0, 0.0]).first()[0] == whole
    wide = np.column_stack([np.arange(300.0), 300 - np.arange(300.0)]) + 1  # every point is on the front
    df2, _ = points(spark, wide)
    assert pa.hypervolume_2d(df2, "o0", "o1", (0.0, 0.0), one_bucket=0).first()[0] == pytest.approx(pa._volume(wide, np.zeros(2)))
    assert pa.hypervolume(df.filter("o0 > 5"), names, [0.0, 0.0]).first()[0] == 0.0


def test_reference_point(spark):
    df, names = points(spark, np.array([[0.0, 10.0], [2.0, 30.0]]))
    assert tuple(pa.reference_point(df, names).first()) == pytest.approx((-0.1, 9.0))
    assert tuple(pa.reference_point(df.limit(0), names).first()) == (0.0, 0.0)


def fps(spark, sets):
    return spark.createDataFrame([(i, sorted(s), 10.0) for i, s in enumerate(sets)], "pool_idx BIGINT, fp ARRAY<INT>, score DOUBLE")


def test_penalty_literal_case(spark):
    cands, pending = fps(spark, [{0, 1}, {2, 3}]), fps(spark, [{0, 1}])
    assert [r.score for r in si.pending_penalty(cands, pending, 1.0, n_bits=4).orderBy("pool_idx").collect()] == [9.0, 10.0]
    assert si.pending_penalty(cands, None, 1.0) is cands and si.pending_penalty(cands, pending, 0.0) is cands


@pytest.mark.parametrize("block", [3, 1000])
def test_max_tanimoto_equals_brute_force(spark, block):
    rng = np.random.default_rng(7)
    sets = [set(rng.choice(32, rng.integers(0, 20), replace=False).tolist()) for _ in range(60)]
    refs = [set(rng.choice(32, rng.integers(0, 30), replace=False).tolist()) for _ in range(17)]
    got = {r.pool_idx: r.max_sim for r in si.max_tanimoto(fps(spark, sets), fps(spark, refs), n_bits=32, block=block).collect()}
    for i, a in enumerate(sets):
        assert got[i] == pytest.approx(max(len(a & b) / (len(a | b) or 1) for b in refs))


def test_no_references_means_no_similarity(spark):
    out = si.max_tanimoto(fps(spark, [{1}]), fps(spark, [{1}]).limit(0), n_bits=8).first()
    assert out.max_sim == 0.0


def test_dense_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, 0.0])], "pool_idx BIGINT, fp ARRAY<DOUBLE>")
    got = {r.pool_idx: r.max_sim for r in si.max_tanimoto(df, df.filter("pool_idx = 0"), dense=True).collect()}
    assert got == {0: pytest.approx(5 / (3 + 3 - 5)), 1: 0.0}


def test_grouped_hypervolume(spark, monkeypatch):
    y = np.random.default_rng(11).random((120, 3))
    df, names = points(spark, y)
    df = df.withColumn("g", df.id % 3)
    want = {g: pytest.approx(pa._volume(y[[i for i in range(120) if i % 3 == g]], np.zeros(3))) for g in range(3)}
    assert {r.g: r.hypervolume for r in pa.grouped_hypervolume(df, ["g"], names, [0.0] * 3).collect()} == want
    monkeypatch.setattr(pa, "BLOCK_ROWS", 5)  # fronts too long for one task
    assert {r.g: r.hypervolume for r in pa.grouped_hypervolume(df, ["g"], names, [0.0] * 3).collect()} == want


def test_pair_fingerprints_equal_plain_pairs(spark):
    """Bits in the order of their first pair; odd white space, texts without a pair, repeats, and texts over several pieces."""
    import hashlib
    import pyarrow
    import re

    from pyspark.sql import functions as F

    from pickwise.functions import fingerprints as fpf

    rng = np.random.default_rng(8)
    texts = [None, "", " \t\n", "one", " one ", "a b", "\x0ba\r\nb\x0c a ", "a a a a a a", "\u00e4\u00a0b \u2003 c", "x" * 300 + " y"]
    texts += [" ".join(f"w{i}" for i in rng.integers(0, 60, n)) + "\n" * (n % 3) for n in rng.integers(1, 400, 60)]

    def plain(text, n_bits):
        h = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % n_bits for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
        return list(dict.fromkeys((h[i] * 1031 + h[i + k] * 733 + k * 379) % n_bits for k in (1, 2, 3) for i in range(len(h) - k))) if len(h) > 1 else None

    for n_bits, part in ((2048, 4), (1_000_000, 1)):
        rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(part)
        got = {r.id: r for r in fpf.fingerprint(rows, n_bits=n_bits).collect()}
        for i, text in enumerate(texts):
            want = plain(text, n_bits)
            assert (got[i].fp, got[i].popcount, got[i].valid) == (want, want and len(want), want is not None), i
    both = fpf.fingerprint(rows.filter("id > 1"), n_bits=2048, packed=True)
    assert both.filter(~F.col("packed").eqNullSafe(fpf.packed_bytes(F.col("fp")))).count() == 0 and both.filter("packed is not null").count() == 65
    sizes = [len(p) for p in fpf.pieces(pyarrow.array(["a" * 5, None, "b" * 50, "c", "d"]), 10, 2)]
    assert sizes == [2, 1, 2]
