import numpy as np
import pytest
from pyspark.sql import functions as F

from pickwise.operators import scale as sc


def numbers(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id BIGINT, v DOUBLE").repartition(5)


@pytest.mark.parametrize("kind", ["uniform", "ties", "wide", "one"])
def test_order_statistics(spark, kind):
    rng = np.random.default_rng(1)
    values = {
        "uniform": rng.normal(size=700), "ties": rng.integers(-3, 3, 500).astype(float),
        "wide": np.concatenate([rng.normal(size=200), [1e300, -1e300, 1e-300]]), "one": np.full(9, 4.0),
    }[kind]
    ranks = [1, 2, len(values) // 2, len(values)]
    got = sc.order_statistics(numbers(spark, values), "v", ranks)
    assert got == {r: np.sort(values)[r - 1] for r in ranks}


def test_quantiles_by_bins_equal_the_builtin(spark):
    values = np.random.default_rng(2).exponential(size=501)
    df = numbers(spark, values)
    qs = [0.0, 0.1, 0.5, 0.99, 1.0]
    assert sc.quantiles(df, "v", qs, small=0) == pytest.approx(list(np.quantile(values, qs)))
    assert sc.quantiles(df, "v", qs) == pytest.approx(list(np.quantile(values, qs)))


@pytest.mark.parametrize("k", [1, 7, 60, 300, 400])
def test_long_top_list_equals_short(spark, k):
    values = np.random.default_rng(3).integers(0, 9, 300)  # a third of all rows may share a score
    df = numbers(spark, values)
    short = {r.id for r in sc.top_k(df, "v", k, "id").collect()}
    assert {r.id for r in sc.top_k(df, "v", k, "id", limit=0).collect()} == short
    assert len(short) == min(k, 300)


def test_global_index_is_dense_and_ordered(spark):
    values = np.random.default_rng(4).integers(0, 4, 500)
    rows = sc.global_index(numbers(spark, values), ["v", "id"], "pos").collect()
    rows.sort(key=lambda r: (r.v, r.id))
    assert [r.pos for r in rows] == list(range(500))


def test_grouped_index_with_a_hot_key(spark):
    df = spark.range(900).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    rows = sc.grouped_index(df, ["k"], ["id"], "n").collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.id):
        assert r.n == by.get(r.k, 0)
        by[r.k] = r.n + 1


def test_blocks_cover_every_row_once(spark):
    seen = [r.id for b in sc.blocks(spark.range(105), 20) for r in b]
    assert sorted(seen) == list(range(105))


def test_same_result_on_any_partitioning(spark):
    df = numbers(spark, np.random.default_rng(5).normal(size=200))
    one = sc.global_index(df.coalesce(1), ["v"], "pos").orderBy("id").collect()
    assert one == sc.global_index(df.repartition(8), ["v"], "pos").orderBy("id").collect()


ODD = [float("nan"), None, float("inf"), float("-inf"), 3.0, 3.0, -1.5, float("nan"), float("inf"), 0.0, None, 1e308, -1e308]


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 9, 10, 12, 13, 20])
def test_top_list_with_odd_scores(spark, k):
    rows = [((1 << 53) + 3 * (len(ODD) - i) if i else None, v) for i, v in enumerate(ODD)]
    df = spark.createDataFrame(rows, "id BIGINT, v DOUBLE").repartition(3)
    value = lambda v: v is not None and v == v
    want = sorted(rows, key=lambda r: (not value(r[1]), -r[1] if value(r[1]) else 0, -1 if r[0] is None else r[0]))[:k]
    for limit in (0, 100):
        assert sorted(r.id or 0 for r in sc.top_k(df, "v", k, "id", limit=limit).collect()) == sorted(r[0] or 0 for r in want)


def test_large_whole_numbers_keep_their_digits(spark):
    values = [(1 << 62) + i for i in range(40)] + [-(1 << 62) - i for i in range(40)] + [(1 << 63) - 1, -(1 << 63)]
    df = spark.createDataFrame([(v,) for v in values], "v BIGINT")
    assert sc.order_statistics(df, "v", [1, 2, 40, 60, 82]) == {r: sorted(values)[r - 1] for r in (1, 2, 40, 60, 82)}


def test_quantiles_with_odd_values(spark):
    df = spark.createDataFrame([(v,) for v in ODD], "v DOUBLE")
    inner = sorted(v for v in ODD if v is not None and v == v)
    for small in (0, 100):
        got = sc.quantiles(df, "v", [0.0, 0.5, 1.0], small=small)
        assert got == [inner[0], (inner[4]), inner[-1]]


def test_long_lists_per_key_equal_short_ones(spark, monkeypatch):
    df = spark.range(400).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 5).alias("k"), F.col("id")).repartition(7)
    short = sc.top_k_per(df, ["k"], [F.desc("id")], 60).collect()
    monkeypatch.setattr(sc, "WINDOW_LIMIT", 10)
    assert sorted(sc.top_k_per(df, ["k"], [F.desc("id")], 60).collect()) == sorted(short)


def test_the_smallest_neighbours(spark):
    tiny = 5e-324
    values = [0.0, tiny, 2 * tiny, tiny, -tiny, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    assert sc.order_statistics(df, "v", [1, 2, 3, 4, 5, 6]) == {r: sorted(values)[r - 1] for r in range(1, 7)}
    two = spark.createDataFrame([(0.0,), (tiny,)], "v DOUBLE")
    assert sc.order_statistics(two, "v", [1, 2]) == {1: 0.0, 2: tiny}
