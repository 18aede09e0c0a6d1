import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from pickwise.functions.states import contributes, usable
from pickwise.operators import observations as ob

SCHEMA = (
    "item_id STRING, pool_idx BIGINT, values ARRAY<DOUBLE>, state STRING, qc_passed BOOLEAN, kind STRING, "
    "ts INT, smiles STRING, compound_id STRING"
)


def obs(spark, rows):
    full = [(i, p, v, s, q, k, n, f"s{p}", f"c{p}") for n, (i, p, v, s, q, k) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def done(item, pool, value, kind="experimental"):
    return (item, pool, [value], "COMPLETED", True, kind)


def test_replicate_mean(spark):
    o = obs(spark, [done("a", 0, 1.0), done("b", 0, 1.05, "replicate")])
    row = ob.labels_from(o, 1, ["ts"], max_std=0.2).first()
    assert row.agg0 == pytest.approx(1.025) and row.n == 2 and row.item_id == "agg:0:n2" and row.smiles == "s0"


def test_disagreeing_replicates_are_rejected(spark):
    o = obs(spark, [done("a", 0, 0.0), done("b", 0, 5.0, "replicate"), done("c", 1, 2.0)])
    good, bad = ob.split_labels(ob.replicate_stats(ob.dedupe(o, ["ts"]), 1, ["ts"]), 0.1)
    assert [r.pool_idx for r in good.collect()] == [1]
    assert [r.pool_idx for r in bad.collect()] == [0]
    assert ob.split_labels(ob.replicate_stats(o, 1, ["ts"]), None)[1].count() == 0


def test_predicates(spark):
    o = obs(spark, [
        done("a", 0, 1.0), done("b", 1, 1.0, "replicate"), done("c", -1, 1.0), done("d", 2, 1.0, "positive"),
        ("e", 3, None, "COMPLETED", True, "experimental"), ("f", 4, [1.0], "FAILED", True, "experimental"),
        ("g", 5, [1.0], "COMPLETED", None, "experimental"),
    ])
    assert [r.item_id for r in o.filter(usable()).collect()] == ["a"]
    assert [r.item_id for r in o.filter(contributes()).collect()] == ["a", "b"]
    assert o.filter(~contributes()).count() == 5


def test_duplicate_item_counts_once_and_first_wins(spark):
    o = obs(spark, [done("a", 0, 1.0), done("a", 0, 9.0), done("", 1, 2.0), done("", 1, 3.0)])
    rows = {r.pool_idx: r for r in ob.labels_from(o, 1, ["ts"]).collect()}
    assert rows[0].n == 1 and rows[0].agg0 == 1.0
    assert rows[1].n == 1 and rows[1].agg0 == 2.0


@pytest.mark.parametrize("seed", range(3))
def test_grouped_median_of_hot_and_small_keys(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(0, float(v)) for v in rng.normal(size=400)] + [(1, float(v)) for v in rng.integers(0, 3, 301)]
    rows += [(2, 7.0), (3, 1.0), (3, 2.0), (4, 1e300), (4, -1e300), (4, 5.0), (4, 6.0)]
    got = {r.k: r.m for r in ob.grouped_median(spark.createDataFrame(rows, "k INT, v DOUBLE"), ["k"], "v", "m").collect()}
    for k in range(5):
        assert got[k] == pytest.approx(statistics.median(v for kk, v in rows if kk == k))


@pytest.mark.parametrize("limit", [1, 7, 40])
def test_grouped_median_narrows_wide_keys(spark, limit):
    rng = np.random.default_rng(limit)
    rows = [(0, float(v)) for v in rng.normal(size=3001)] + [(0, 1e308), (1, 5e-324), (1, 0.0)]
    rows += [(2, float(2.0 ** v)) for v in rng.integers(-1000, 1000, 800)] + [(3, float(v)) for v in rng.integers(0, 9, 500)]
    rows += [(4, 1.0)] * 600 + [(4, 2.0)] * 600 + [(5, float("inf")), (5, float("-inf")), (5, 3.0), (6, None), (None, 1.0)]
    got = {r.k: r.m for r in ob.grouped_median(spark.createDataFrame(rows, "k INT, v DOUBLE"), ["k"], "v", "m", limit).collect()}
    assert {k: got[k] for k in range(6)} == {k: statistics.median(v for kk, v in rows if kk == k) for k in range(6)}
    assert set(got) == set(range(6))


def test_hot_key_is_split_over_tasks(spark):
    """One key with many values and an outlier: what is ranked in one group stays within the limit, and the work is salted."""
    df = spark.range(300_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000 + 1).alias("k"),
        F.when(F.col("id") == 0, 1e300).otherwise(F.rand(3)).alias("v"),
    )
    values = ob.cut_lineage(df)
    got = {r.k: r.m for r in ob.grouped_median(values, ["k"], "v", "m").collect()}
    want = {r.k: r.m for r in values.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert got == want
    open_keys = values.filter("k = 0").groupBy("k").agg(
        F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.count("v").alias("_n"), F.lit(0).cast("long").alias("_before")
    )
    left = ob._middle_bins(values.withColumnRenamed("v", "_v").withColumn("_c", F.lit(1).cast("long")), open_keys, ["k"]).first()
    assert left._d < 100_000 / ob.MEDIAN_BINS * 2
    sizes = [r["count"] for r in values.filter("k = 0").withColumnRenamed("v", "_v").groupBy(ob._salt()).count().collect()]
    assert len(sizes) == ob.MEDIAN_SALTS and max(sizes) < 1.2 * min(sizes)


def test_training_matrix_stops_on_wrong_width(spark):
    labels = spark.createDataFrame([(0, [1.0, 2.0])], "pool_idx BIGINT, values ARRAY<DOUBLE>")
    cands = spark.createDataFrame([(0, [1])], "pool_idx BIGINT, fp ARRAY<INT>")
    with pytest.raises(Exception, match="expected 1"):
        ob.training_matrix(labels, cands, 1, "fp").collect()
    assert ob.training_matrix(labels, cands, 2, "fp").count() == 1


def test_outcomes_and_new_labels(spark):
    o = obs(spark, [done("a", 0, 1.0), ("b", 1, None, "FAILED", False, "experimental"), ("c", 2, None, "QC_REJECTED", False, "experimental")])
    items = o.select(F.lit("j").alias("job_id"), "item_id")
    assert ob.outcome_counts(items, o).first()[1:] == (1, 1, 1)
    assert ob.newly_labelled(o.filter("pool_idx = 0"), o).count() == 2


def test_several_objectives(spark):
    rows = [("a", 0, [1.0, 10.0], "COMPLETED", True, "experimental"), ("b", 0, [2.0, 30.0], "COMPLETED", True, "replicate")]
    r = ob.replicate_stats(obs(spark, rows), 2, ["ts"], "median").first()
    assert (r.agg0, r.agg1, r.std0, r.std1) == (1.5, 20.0, 0.5, 10.0)


def test_spread_at_the_limit_is_accepted(spark):
    stats = spark.createDataFrame([(0, 2, 14.000000000000002), (1, 2, 14.0), (2, 2, 14.001)], "pool_idx BIGINT, n BIGINT, std0 DOUBLE")
    good, bad = ob.split_labels(stats, 14.0)
    assert sorted(r.pool_idx for r in good.collect()) == [0, 1] and [r.pool_idx for r in bad.collect()] == [2]


def test_large_tables_are_deduplicated_in_pieces(spark, monkeypatch):
    """More pieces than shuffle partitions: the same first events, and a task sorts a piece of the rows alone."""
    df = spark.range(4000).select(
        F.when(F.col("id") % 5 == 0, "hot").otherwise((F.col("id") % 1500).cast("string")).alias("item_id"), (F.col("id") * 37 % 4001).alias("ts"),
        F.lit(1).alias("pool_idx"), F.lit("COMPLETED").alias("state"), F.lit("experimental").alias("kind"),
    )
    want = sorted(map(str, ob.dedupe(df, ["ts"]).collect()))
    monkeypatch.setattr(ob, "PIECE_BYTES", 2000)
    out = ob.dedupe(df, ["ts"])
    assert sorted(map(str, out.collect())) == want and len(want) == len({r.item_id for r in out.collect()})
    assert out.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
