from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from pickwise.operators.bootstrap_forest import BootstrapForest, _score, best_split, grow
from pickwise.operators.surrogate import ForestSurrogate, bit_features
from pickwise.plans import campaign as ca
from pickwise.sources.stores import versions

RULES = ca.Rules(batch_size=10, init_fraction=0.1, n_trees=8, max_depth=8)


@pytest.fixture(scope="module")
def library(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6))
    y = x[:, 0] * 2 + x[:, 1]
    rows = [(i, [float(v) for v in x[i]], float(y[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "pool_idx BIGINT, x ARRAY<DOUBLE>, activity DOUBLE").cache()
    return df.select("pool_idx", array_to_vector("x").alias("features")), df.select("pool_idx", "activity")


def test_greedy_beats_random_and_never_selects_twice(spark, library):
    cands, truth = library
    r = {x.strategy: x for x in ca.compare(cands, truth, RULES, ["random", "greedy", "ucb"], 3).collect()}
    assert all(x.n_labeled == 50 for x in r.values())
    assert min(r["greedy"].mean_activity, r["ucb"].mean_activity) > r["random"].mean_activity + 0.5


def test_history_and_resume(spark, library, tmp_path):
    cands, truth = library
    path = str(tmp_path / "run")
    reveal = ca.evaluate_from(truth, ["activity"])
    ca.run_campaign(cands, reveal, RULES, 1, path)
    before = {r.pool_idx for r in spark.read.parquet(f"{path}/version=1").collect()}
    labels = ca.run_campaign(cands, reveal, RULES, 2, path)
    assert versions(spark, path) == [0, 1, 2]
    assert {r.pool_idx for r in spark.read.parquet(f"{path}/version=1").collect()} == before
    assert labels.select("pool_idx").distinct().count() == labels.count() == 40
    h = sorted(ca.history(truth, labels, ["activity"]).collect(), key=lambda r: r["round"])
    assert [r.n_labeled for r in h] == [20, 30, 40]
    assert h[0].top1_recall <= h[1].top1_recall <= h[2].top1_recall


def test_stops_when_everything_is_labelled(spark, library):
    cands, truth = library
    few = cands.filter("pool_idx < 25")
    labels = ca.run_campaign(few, ca.evaluate_from(truth, ["activity"]), replace(RULES, acquisition="random"), 9)
    assert labels.count() == 25


def test_selection_respects_state_and_labels_guard(spark, library):
    cands, truth = library
    labels = cands.join(truth, "pool_idx").filter("pool_idx < 40")
    state = spark.createDataFrame([(50, "FAILED"), (51, "RETRYABLE"), (52, "CONTROL")], "pool_idx BIGINT, phase STRING")
    free = ca.available_candidates(cands, state)
    assert {50, 52}.isdisjoint(r.pool_idx for r in free.collect()) and free.filter("pool_idx = 51").count() == 1
    got = ca.select_round(free, labels, RULES, taken=labels)
    assert got.filter("pool_idx < 40").count() == 0 and got.count() == 10
    with pytest.raises(ValueError, match="hidden labels"):
        ca.select_round(cands.join(truth, "pool_idx"), labels, RULES)


@pytest.mark.parametrize("name", ["pareto", "weighted"])
def test_two_objectives(spark, library, name):
    cands, truth = library
    two = truth.withColumn("other", -F.abs("activity"))
    rules = replace(RULES, objectives=("activity", "other"), acquisition=name, batch_size=4)
    labels = ca.run_campaign(cands, ca.evaluate_from(two, ["activity", "other"]), rules, 1)
    r = ca.history(two, labels, ["activity", "other"], rounds=False).first()
    assert r.n_labeled == 24 and 0 < r.hv_frac <= 1 and 0 <= r.pareto_recall <= 1


def test_forest_mean_and_spread(spark, library):
    cands, truth = library
    training = cands.join(truth, "pool_idx").filter("pool_idx < 80")
    forest = ForestSurrogate(6, 1, 8).fit(training, ["activity"])
    out = forest.predict(cands).orderBy("pool_idx").collect()
    for row, got in zip(cands.orderBy("pool_idx").limit(5).collect(), out):
        trees = [t.predict(row.features) for t in forest.models[0].trees]
        assert got.mean0 == pytest.approx(np.mean(trees)) and got.std0 == pytest.approx(np.std(trees))
    with pytest.raises(RuntimeError):
        ForestSurrogate().predict(cands)


def test_the_default_forest_fits_every_label_without_python(spark):
    assert ca.Rules().surrogate == "forest"
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.col("id").alias("pool_idx"), array_to_vector(F.array((F.col("id") % 7).cast("double"))).alias("features"),
                                    ((F.col("id") % 7) * 3 + F.col("id") % 2).cast("double").alias("activity"))
    out = ForestSurrogate(3, bootstrap=False).fit(rows, ["activity"]).predict(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "InPandas", "ArrowEval"))
    exact = {r.g: r.m for r in rows.groupBy((F.col("pool_idx") % 7).alias("g")).agg(F.avg("activity").alias("m")).collect()}
    for r in out.filter("pool_idx < 14").collect():
        assert abs(r.mean0 - exact[r.pool_idx % 7]) < 1e-9 and r.std0 == 0


def test_bootstrap_forest_is_stable_and_learns(spark, library):
    cands, truth = library
    training = cands.join(truth, "pool_idx").filter("pool_idx < 120")
    one = BootstrapForest(20, 1).fit(training.coalesce(1), ["activity"]).predict(cands).orderBy("pool_idx").collect()
    two = BootstrapForest(20, 1).fit(training.repartition(5), ["activity"]).predict(cands.repartition(3)).orderBy("pool_idx").collect()
    assert [(r.mean0, r.std0) for r in one] == [(r.mean0, r.std0) for r in two]
    y = [r.activity for r in truth.orderBy("pool_idx").collect()]
    assert np.corrcoef([r.mean0 for r in one][120:], y[120:])[0, 1] > 0.7 and all(r.std0 >= 0 for r in one)
    with pytest.raises(RuntimeError):
        BootstrapForest().predict(cands)


def test_full_depth_tree_reproduces_distinct_rows():
    rng = np.random.default_rng(3)
    x, y = rng.random((60, 9)), rng.random(60)
    tree = tuple(np.array(a) for a in grow(x, y, np.ones(60), rng))
    assert _score([tree], x)[:, 0] == pytest.approx(y)
    bits = (rng.random((60, 40)) < 0.5).astype(np.uint8)
    tree = tuple(np.array(a) for a in grow(bits, y, np.ones(60), rng))
    assert _score([tree], bits)[:, 0] == pytest.approx(y)


def test_best_split_equals_brute_force():
    rng = np.random.default_rng(4)
    x, y, w = rng.integers(0, 4, (30, 5)).astype(float), rng.random(30), rng.integers(1, 4, 30).astype(float)
    sse = lambda m: (w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum() if m.any() else 0.0
    cost = lambda c, t: sse(x[:, c] <= t) + sse(x[:, c] > t)
    every = min(cost(c, t) for c in range(5) for t in (0.5, 1.5, 2.5))
    assert cost(*best_split(x, y, w)) == pytest.approx(every)
    assert best_split(np.ones((4, 2)), y[:4], w[:4]) is None


def test_the_rules_name_the_surrogate(spark, library):
    cands, truth = library
    labels = cands.join(truth, "pool_idx").filter("pool_idx < 60")
    for rules in (RULES, replace(RULES, surrogate="trees"), replace(RULES, surrogate="trees", fit_rows=10), replace(RULES, acquisition="Random")):
        assert ca.select_round(cands, labels, rules, taken=labels).count() == 10
    with pytest.raises(ValueError, match="surrogate"):
        ca.select_round(cands, labels, replace(RULES, surrogate="other"), taken=labels)


def test_bit_features(spark):
    df = bit_features(spark.createDataFrame([(0, [3, 1])], "pool_idx BIGINT, fp ARRAY<INT>"), n_bits=5, name="v")
    assert df.first().v.toArray().tolist() == [0, 1, 0, 1, 0]


def test_plate_round(spark):
    from pickwise.operators.plates import Plate

    cands = spark.createDataFrame([(i, [i % 5, 5 + i % 3]) for i in range(12)], "pool_idx BIGINT, fp ARRAY<INT>")
    sel = spark.createDataFrame([(i + 1, i, 1.0 - i / 20, "ucb") for i in range(8)], "rank INT, pool_idx BIGINT, score DOUBLE, strategy STRING")
    controls = spark.createDataFrame([("positive", 0, 10), ("negative", 0, 11)], "kind STRING, rank INT, pool_idx BIGINT")
    wells = ca.plate_round(sel, cands, controls, Plate(6, 1, 1, 1, 2), "j", n_bits=8).collect()
    assert len(wells) == 11
    first = [w.pool_idx for w in sorted(wells, key=lambda w: w.slot) if w.kind == "experimental"]
    assert first[0] == 0 and len(set(first)) == 6 and set(first) <= set(range(8))
    plain = ca.plate_round(sel.withColumn("strategy", F.lit("random")), cands, controls, Plate(6, 1, 1, 1, 2), "j").collect()
    assert [w.pool_idx for w in sorted(plain, key=lambda w: w.slot)][:6] == list(range(6))


def test_run_summary(spark, library):
    from pickwise.operators.metrics import run_summary

    _, truth = library
    row = run_summary(ca.history(truth, truth.limit(5), ["activity"], rounds=False), 1.23456, 6, acquisition="ucb", seed=0).first()
    assert (row.wall_clock_s, row.history_len, row.acquisition, row.n_labeled) == (1.235, 6, "ucb", 5)


def test_a_half_written_round_is_written_anew(spark, library, tmp_path):
    cands, truth = library
    path = str(tmp_path / "run")
    reveal = ca.evaluate_from(truth, ["activity"])
    ca.run_campaign(cands, reveal, replace(RULES, acquisition="random"), 0, path)
    (tmp_path / "run" / "version=1" / "_temporary").mkdir(parents=True)
    (tmp_path / "run" / "version=1" / "part-00000.parquet").write_bytes(b"half")
    labels = ca.run_campaign(cands, reveal, replace(RULES, acquisition="random"), 1, path)
    assert versions(spark, path) == [0, 1] and labels.count() == 30


def test_loop_retries_controls_and_goes_on(spark, library, tmp_path):
    from pickwise.plans import closed_loop as cl

    cands, truth = library
    cands = cands.withColumn("smiles", F.col("pool_idx").cast("string"))
    controls = spark.createDataFrame([(i,) for i in range(150, 200)], "pool_idx BIGINT")
    rules = replace(RULES, acquisition="greedy", n_trees=3)
    evaluate = cl.evaluate_from(truth, ("activity",), F.col("pool_idx") % 3 == 0)
    path = str(tmp_path / "loop")
    cl.run_loop(cands, evaluate, rules, 1, path=path, controls=controls)
    log = cl.run_loop(cands, evaluate, rules, 3, path=path, controls=controls)
    assert versions(spark, path) == [0, 1, 2, 3]
    rows = log.collect()
    assert all(r.pool_idx < 150 for r in rows)
    tries = {}
    for r in rows:
        tries[r.pool_idx] = tries.get(r.pool_idx, 0) + 1
    assert all(n == 1 or (i % 3 == 0 and n == 2) for i, n in tries.items())
    state = cl.derive(log, rules, cl.Policy())
    phase = {r.pool_idx: r.phase for r in state.phases.collect()}
    assert all(phase[i] == ("LABELED" if i % 3 else "FAILED" if n == 2 else "RETRYABLE") for i, n in tries.items())
    history = {r["round"]: r for r in cl.loop_history(truth, log, rules).collect()}
    assert history[3].n_labeled == sum(1 for i in tries if i % 3) and all(r.submitted == r.completed + r.failed for r in history.values())


def test_loop_leaves_what_is_under_way(spark, library, tmp_path):
    from pickwise.plans import closed_loop as cl

    cands, truth = library
    cands = cands.withColumn("smiles", F.col("pool_idx").cast("string"))
    full = cl.evaluate_from(truth, ("activity",))

    def evaluate(items):  # half of the items only report that they run
        seen = full(items)
        runs = F.col("pool_idx") % 2 == 0
        return seen.withColumns({"state": F.when(runs, "RUNNING").otherwise(F.col("state")), "values": F.when(~runs, F.col("values")), "qc_passed": F.col("qc_passed") & ~runs})

    rules = replace(RULES, acquisition="random")
    rows = cl.run_loop(cands, evaluate, rules, 3).collect()
    assert len({r.pool_idx for r in rows}) == len(rows) == 50


def test_on_bit_lists_are_scored_by_the_forest_as_their_vectors_are(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [int(b) for b in np.flatnonzero(rng.random(40) < 0.4)], float(rng.normal())) for i in range(80)]
    labels = spark.createDataFrame(rows, "pool_idx BIGINT, fp ARRAY<INT>, activity DOUBLE")
    odd = spark.createDataFrame([(100, []), (101, [39, 0, 0]), (102, [40, -1, 3]), (103, [None, 7]), (104, [5, 2])], "pool_idx BIGINT, fp ARRAY<INT>")
    everything = labels.select("pool_idx", "fp").unionByName(odd)
    forest = ForestSurrogate(9, 1, 12, 2).fit(bit_features(labels, n_bits=40), ["activity"])
    figures = lambda df: {r.pool_idx: (r.mean0, r.std0) for r in df.collect()}
    assert figures(forest.predict_bits(everything, "fp", 40)) == figures(forest.predict(bit_features(everything, n_bits=40)))
    with pytest.raises(Exception, match="no features"):
        forest.predict_bits(spark.createDataFrame([(1, None)], "pool_idx BIGINT, fp ARRAY<INT>"), "fp", 40).collect()


def test_a_round_builds_no_vectors_from_the_librarys_lists(spark):
    from pickwise.operators import surrogate as su

    labels = spark.createDataFrame([(i, [i % 7, 7 + i % 3], float(i)) for i in range(30)], "pool_idx BIGINT, features ARRAY<INT>, activity DOUBLE")
    cands = spark.range(200).select(F.col("id").alias("pool_idx"), F.array((F.col("id") % 7).cast("int"), (F.col("id") % 11).cast("int")).alias("features"))
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ca, "bit_features", lambda df, *a: seen.append(df.count()) or su.bit_features(df, *a))
        assert ca.select_round(cands, labels, replace(RULES, n_bits=16), taken=labels).count() == 10
    assert seen == [30]


def test_a_rounds_fit_is_not_dealt_over_the_labels_files(spark, library, monkeypatch):
    """Every partition sends the figures of all open nodes at every level."""
    cands, truth = library
    seen, fit = [], ForestSurrogate.fit
    monkeypatch.setattr(ForestSurrogate, "fit", lambda self, df, names: seen.append((df.count(), df.rdd.getNumPartitions())) or fit(self, df, names))
    labels = cands.join(truth, "pool_idx").filter("pool_idx < 60").repartition(12)
    assert ca.select_round(cands, labels, replace(RULES, surrogate="forest", n_trees=3), taken=labels).count() == RULES.batch_size
    assert seen == [(60, 1)]
    assert ca.gathered(spark.range(90).withColumnRenamed("id", "pool_idx"), 40).rdd.getNumPartitions() == 3


def test_packed_bits_give_the_rows_of_on_bit_lists(spark):
    """A campaign scores packed bits without lists or vectors; a NULL fingerprint is no fingerprint."""
    from pickwise.functions.fingerprints import bit_lists, packed_bytes

    rng = np.random.default_rng(9)
    rows = [(i, sorted(rng.choice(50, rng.integers(0, 9), replace=False).tolist()), float(i % 13)) for i in range(150)]
    df = spark.createDataFrame(rows, "pool_idx BIGINT, fp ARRAY<INT>, activity DOUBLE").withColumn("packed", packed_bytes(F.col("fp"), 50))
    assert df.filter(~F.col("fp").eqNullSafe(bit_lists(F.col("packed")))).count() == 0
    none = spark.createDataFrame([(None,)], "fp ARRAY<INT>").select(packed_bytes(F.col("fp")).alias("p"))
    assert none.select("p", bit_lists(F.col("p")).alias("l")).collect() == [(None, None)]
    labels = df.filter("pool_idx < 40")
    for kind in ("forest", "trees"):
        got = []
        for column in ("fp", "packed"):
            rules = replace(RULES, surrogate=kind, n_trees=4, n_bits=50, features=column)
            got.append([(r.rank, r.pool_idx, r.score) for r in ca.select_round(df.drop("activity"), labels, rules, taken=labels).orderBy("rank").collect()])
        assert got[0] == got[1] and len(got[0]) == RULES.batch_size


def test_bit_forest_equals_trees_row_by_row():
    from pickwise.operators.bootstrap_forest import _score_bits, bit_forest

    rng = np.random.default_rng(5)
    x = (rng.random((300, 40)) < 0.4).astype(np.uint8)
    trees = [tuple(np.array(a) for a in grow(x[:n], rng.random(n), np.ones(n), rng)) for n in (1, 2, 90, 300)]
    assert np.array_equal(_score_bits(bit_forest(trees), x), _score(trees, x))
    assert _score_bits(bit_forest(trees), x[:0]).shape == (0, 4)


def test_forest_fit_keeps_the_labels_nodes(spark, library, monkeypatch):
    from pickwise.operators import surrogate as su

    cands, truth = library
    made = []
    monkeypatch.setattr(su, "RandomForestRegressor", lambda **kw: made.append(kw) or RandomForestRegressor(**kw))
    labels = cands.join(truth, "pool_idx")
    forest = ForestSurrogate(4, 0, 6).fit(labels, ["activity"])
    assert made[0]["cacheNodeIds"]
    other = RandomForestRegressor(**{**made[0], "cacheNodeIds": False}).fit(labels)
    assert other.toDebugString.split("\n")[1:] == forest.models[0].toDebugString.split("\n")[1:]
