"""Lazy diverse picks against the plain greedy rule over all rows."""

import random

import pytest

from pickwise.operators import diverse_pool as dp

ROWS = "pool_idx long, score double, fp array<int>, near string, row string, bound string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], ROWS)


def plain(rows, k, lam):
    """Every value of every row computed anew for every pick."""
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[1] == r[1]]
    low, high = min(r[1] for r in rows), max(r[1] for r in rows)
    gain = [(r[1] - low) / (high - low) if high - low > 1e-12 else 0.0 for r in rows]
    sets, near, left, out = [set(r[2] or ()) for r in rows], [0.0] * len(rows), set(range(len(rows))), []
    while left and len(out) < k:
        at = min(left, key=lambda i: (-(((1 - lam) * gain[i] - lam * near[i]) if out else gain[i]), rows[i][0]))
        left.discard(at)
        out.append(rows[at][0])
        for i in left:
            union = len(sets[i] | sets[at])
            near[i] = max(near[i], len(sets[i] & sets[at]) / union if union else 0.0)
    return out


def picks(df):
    return [r.pool_idx for r in df.orderBy("div_rank").collect()]


def made(seed, n=300, values=1000):
    rng = random.Random(seed)
    centres = [rng.sample(range(128), 20) for _ in range(6)]
    return [(i, rng.randrange(values) / values, sorted(set(rng.sample(rng.choice(centres), 15) + rng.sample(range(128), 3)))) for i in range(n)]


@pytest.mark.parametrize("active", [1, 3, 40, 1000])
@pytest.mark.parametrize("lam", [0.0, 0.4, 1.0])
def test_picks_of_the_plain_rule(spark, active, lam):
    rows = made(active)
    k = 4 if active == 1 else 10
    assert picks(dp.diversify_pool(frame(spark, rows).repartition(5), k, lam, 128, active=active)) == plain(rows, k, lam)


def test_ties_go_to_the_lower_id(spark):
    rows = made(7, 80, values=2)
    assert picks(dp.diversify_pool(frame(spark, rows), 12, 0.5, 128, active=5)) == plain(rows, 12, 0.5)


def test_nulls_repeats_and_short_pools(spark):
    rows = [(1, 0.5, [1, 2]), (2, None, [1]), (3, float("nan"), [1]), (None, 1.0, [5]), (4, 0.9, None), (5, 0.9, []), (6, 0.1, [3]), (6, 0.1, [3])]
    assert picks(dp.diversify_pool(frame(spark, rows), 9, 0.4, 64, active=2)) == plain(rows, 9, 0.4)
    assert picks(dp.diversify_pool(frame(spark, []), 3, 0.4, 64)) == []
    assert picks(dp.diversify_pool(frame(spark, rows), 0, 0.4, 64)) == []
    same = [(i, 2.0, [i % 3]) for i in range(20)]
    assert picks(dp.diversify_pool(frame(spark, same), 6, 0.4, 64, active=4)) == plain(same, 6, 0.4)


def test_a_pool_of_copies(spark):
    """A third of the rows share one fingerprint and the best score."""
    rows = [(i, 1.0, [1, 2, 3]) for i in range(100)] + made(9, 200)[100:]
    assert picks(dp.diversify_pool(frame(spark, rows).repartition(9), 8, 0.6, 128, active=10)) == plain(rows, 8, 0.6)


def test_only_leading_rows_move(spark, monkeypatch):
    """Rows whose bound cannot lead are neither rewritten nor held against the picks."""
    moved = []
    refresh = dp._refresh

    def counted(*a):
        tier = refresh(*a)
        moved.append(tier.rows.count())
        return tier

    monkeypatch.setattr(dp, "_refresh", counted)
    rows = made(11, 2000)
    assert picks(dp.diversify_pool(frame(spark, rows), 12, 0.2, 128, active=20)) == plain(rows, 12, 0.2)
    assert sum(moved) < len(rows)
