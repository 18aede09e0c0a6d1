import pytest
from pyspark.sql import functions as F

from pickwise.functions import objectives as obj
from pickwise.operators import acquire as ac
from pickwise.operators import feasibility as fe
from pickwise.operators import metrics as me
from pickwise.operators import plates as pl
from pickwise.operators.diversity import diversify


def preds(spark, rows, n=1):
    cols = ", ".join(f"mean{i} DOUBLE, std{i} DOUBLE" for i in range(n))
    return spark.createDataFrame(rows, f"pool_idx BIGINT, {cols}")


def test_each_strategy_returns_k_distinct_rows(spark):
    p = preds(spark, [(i, float(i % 7), 0.1 * i, float(-i), 1.0) for i in range(40)], 2)
    labels = p.filter("pool_idx < 5").select(F.col("mean0").alias("agg0"), F.col("mean1").alias("agg1"))
    params = ac.Params(n_objectives=2, labels=labels, ref_point=(-1.0, -50.0), candidate_cap=20)
    for name in ac.STRATEGIES:
        rows = ac.strategy(name)(p, 6, params).collect()
        assert len({r.pool_idx for r in rows}) == 6 and sorted(r["rank"] for r in rows) == list(range(1, 7))
        assert {r.strategy for r in rows} == {name}
    assert ac.strategy("RANDOM")(p, 100, params).count() == 40


def test_ties_go_to_the_lower_id(spark):
    p = preds(spark, [(3, 1.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 0.0), (0, 0.0, 0.0)])
    assert [r.pool_idx for r in ac.greedy_batch(p, 2, ac.Params()).orderBy("rank").collect()] == [1, 2]


def test_strategy_names(spark):
    with pytest.raises(ValueError, match="unknown acquisition"):
        ac.strategy("nope")
    with pytest.raises(ValueError, match="reference point"):
        ac.pareto_batch(preds(spark, [(0, 1.0, 0.0)]), 1, ac.Params())
    ac.register_strategy("first", lambda p, k, q: p.limit(k))
    assert ac.strategy("First") is ac.STRATEGIES.pop("first")


def test_random_sample_does_not_depend_on_partitions(spark):
    p = preds(spark, [(i, 0.0, 0.0) for i in range(100)])
    pick = lambda df, s: [r.pool_idx for r in ac.random_batch(df, 10, ac.Params(seed=s)).orderBy("rank").collect()]
    assert pick(p.coalesce(1), 1) == pick(p.repartition(7), 1) != pick(p, 2)


def test_a_long_draw_that_takes_columns_along_sends_no_list_to_one_task(spark):
    p = spark.range(3000).select((F.col("id") % 2900).alias("pool_idx"), F.array("id").alias("features"))
    wide = ac.random_batch(p, 1500, ac.Params(seed=5, keep=("features",)))
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" not in plan.split("Union")[0] and "Limit 1500" not in plan
    pick = lambda df: [(r["rank"], r.pool_idx, r.score) for r in df.orderBy("rank").collect()]
    assert pick(wide) == pick(ac.random_batch(p, 1500, ac.Params(seed=5)))


def test_feasibility_policies(spark):
    lib = spark.createDataFrame([(i, float(i)) for i in range(100)], "pool_idx BIGINT, sa_ease DOUBLE")
    assert fe.feasible(lib, lib, 0.1).n_feasible == 90
    with pytest.raises(RuntimeError, match="no feasible"):
        fe.feasible(lib, lib, 0.1, F.lit(False))
    low = lib.filter("pool_idx between 3 and 8")
    opened = fe.feasible(low, lib, 0.1, policy="fail_open")
    assert opened.policy == "fail_open" and opened.rows.count() == 6
    relaxed = fe.feasible(low, lib, 0.1, policy="relax")
    assert (relaxed.policy, relaxed.quantile, relaxed.n_feasible) == ("relax", 0.05, 4)
    assert fe.feasible(lib, lib, 0.1, F.lit(False), "relax").policy == "relax_fallback_open"
    with pytest.raises(ValueError, match="unknown empty policy"):
        fe.feasible(lib, lib, 0.1, policy="x")


def truth_of(spark, scores):
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "pool_idx BIGINT, activity DOUBLE")


def ids(spark, values):
    return spark.createDataFrame([(int(v),) for v in values], "pool_idx BIGINT")


def test_recall_and_enrichment_literal_case(spark):
    truth = truth_of(spark, range(1000))
    hits = me.top_fraction(truth, "activity", 0.01)
    lab = ids(spark, [999, 998, 997, 996, 995, 0, 1, 2])
    assert me.hit_recall(lab, hits).first().recall == 0.5
    assert me.enrichment_factor(lab, hits, 1000).first().ef == pytest.approx(62.5)
    assert me.enrichment_factor(ids(spark, [1]).limit(0), hits, 1000).first().ef == 0.0
    assert me.hit_recall(lab, hits.limit(0)).first().recall == 0.0


def test_report_at_perfect_recall(spark):
    truth = truth_of(spark, [(i * 7919) % 500 for i in range(500)])
    r = me.report(truth, me.top_fraction(truth, "activity", 0.01), ["activity"]).first()
    assert r.top1_recall == 1.0 and r.ef_top1 > 10 and r.bedroc > 0.5 and r.hv_frac is None and r.pareto_recall is None


def test_empty_report(spark):
    truth = truth_of(spark, range(50))
    r = me.report(truth, ids(spark, [1]).limit(0), ["activity"]).first()
    assert (r.n_labeled, r.mean_activity, r.top1_recall, r.ef_top1, r.bedroc, r.n_hits_top1) == (0, 0.0, 0.0, 0.0, 0.0, 0)


def test_long_hit_list_gives_the_same_ranks(spark, monkeypatch):
    truth = truth_of(spark, [i % 11 for i in range(300)])
    short = sorted(me.hit_ranks(truth, "activity", 0.4).collect())
    monkeypatch.setattr(me, "RANK_LIMIT", 0)
    assert sorted(me.hit_ranks(truth, "activity", 0.4).collect()) == short


def test_budget(spark):
    order = spark.createDataFrame([(10, 0), (20, 1), (30, 2), (40, 3)], "pool_idx BIGINT, at BIGINT")
    hits = ids(spark, [20, 40, 50, 60])
    budget = lambda t, h=hits: me.budget_to_recall(order, h, t, "at").first().budget
    assert budget(0.25) == 2 and budget(0.5) == 4 and budget(0.75) is None
    assert budget(0.5, hits.limit(0)) == 0 and budget(0.0) == 0


def test_bedroc_edges(spark):
    ranks = spark.createDataFrame([(0,), (1,)], "rank BIGINT")
    assert me.bedroc_of_ranks(ranks, 100).first().bedroc == pytest.approx(1.0)
    assert me.bedroc_of_ranks(ranks.limit(0), 100).first().bedroc == 0.0
    assert me.bedroc_of_ranks(ranks, 0).first().bedroc == 0.0


def test_plate_of_28_wells(spark):
    plate = pl.Plate(20, 2, 2, 2, 2)
    batch = spark.range(30).select(F.lit("j").alias("job_id"), F.col("id").alias("rank"), (F.col("id") + 100).alias("pool_idx"))
    controls = spark.createDataFrame([("positive", 0, 1), ("positive", 1, 2), ("negative", 0, 3), ("negative", 1, 4)], "kind STRING, rank INT, pool_idx BIGINT")
    wells = pl.layout(batch, controls, plate).orderBy("slot").collect()
    assert len(wells) == 28 and len({w.well_id for w in wells}) == 28
    assert [w.well_id for w in wells][:13] == [f"A{i:02d}" for i in range(1, 13)] + ["B01"]
    kinds = [w.kind for w in wells]
    assert kinds == ["experimental"] * 20 + ["positive"] * 2 + ["negative"] * 2 + ["blank"] * 2 + ["replicate"] * 2
    source = {w.well_id: w.pool_idx for w in wells if w.kind == "experimental"}
    assert all(source[w.replicate_of] == w.pool_idx for w in wells if w.kind == "replicate")
    with pytest.raises(ValueError, match="explicit controls"):
        pl.layout(batch, controls.limit(1), plate)
    with pytest.raises(ValueError, match="wells"):
        pl.Plate(n_experimental=200).check()
    with pytest.raises(ValueError, match="geometry"):
        pl.Plate(rows=0).check()


def test_diversity_prefers_the_dissimilar(spark):
    rows = [("b", 0, 1.0, [0, 1]), ("b", 1, 0.9, [0, 1]), ("b", 2, 0.8, [2, 3])]
    df = spark.createDataFrame(rows, "batch STRING, pool_idx BIGINT, score DOUBLE, fp ARRAY<INT>")
    order = [r.pool_idx for r in diversify(df, ["batch"], 3, 0.6, 4).orderBy("div_rank").collect()]
    assert order == [0, 2, 1]


def test_objective_spellings():
    r = obj.resolve_objectives
    assert r(None) == obj.DEFAULT_OBJECTIVES == r({})
    mixed = r({"objectives": ["activity", "qed", "sa_ease"]})
    assert mixed.expensive_names == ["activity"] and mixed.static_names == ["qed", "sa_ease"]
    assert r({"objectives": ["activity"]}).static_names == ["qed", "sa_ease"]
    assert r({"objectives": ["activity"], "static_properties": []}).static_names == []
    assert r({"objectives": {"expensive": ["a", {"name": "b", "maximize": False}], "static": []}}).expensive[1].maximize is False
    assert r({"objectives": ["qed"]}).expensive_names == ["activity"]
    with pytest.raises(TypeError):
        r({"objectives": [3]})
    with pytest.raises(ValueError):
        obj.require_expensive(r({"objectives": {"expensive": []}}))


def test_labels_are_refused_on_candidates(spark):
    df = spark.createDataFrame([(0, 1.0)], "pool_idx BIGINT, activity DOUBLE")
    with pytest.raises(ValueError, match="hidden labels"):
        obj.refuse_labels(df, obj.DEFAULT_OBJECTIVES)
    with pytest.raises(KeyError):
        obj.static_columns(df, ["nope"])
