import random

import pytest

from pickwise.operators import lifecycle as lc

OPS = ["CONTROL", "STOCKOUT", "SELECTED", "SUBMITTED", "RUNNING", "LABELED", "RELEASE", "OBS_CANCELLED", "OBS_FAILED",
       "OBS_QC_REJECTED", "OBS_MEASURED", "OBS_RUNNING", "OBS_SUBMITTED"]
INFLIGHT = ("SELECTED", "SUBMITTED", "RUNNING")


def replay(events, max_fail=1, max_qc=1):
    """The rules written out once more, one candidate at a time."""
    state = {}
    for pool, _, op, job in sorted(events, key=lambda e: (e[0], e[1])):
        s = state.setdefault(pool, {"phase": "AVAILABLE", "job": None, "f": 0, "q": 0})
        p = s["phase"]
        if op in ("CONTROL", "LABELED"):
            s["phase"] = op
        elif op == "SUBMITTED":
            s["phase"], s["job"] = "SUBMITTED", job
        elif op == "STOCKOUT" and p == "AVAILABLE":
            s["phase"] = op
        elif op == "SELECTED" and p in ("AVAILABLE", "RETRYABLE"):
            s["phase"], s["job"] = op, job or s["job"]
        elif op == "RUNNING" and p in ("SELECTED", "SUBMITTED"):
            s["phase"] = op
        elif op == "RELEASE" and p in INFLIGHT and (job is None or s["job"] in (None, job)):
            s["phase"], s["job"] = "AVAILABLE", None
        elif op.startswith("OBS_") and p != "LABELED":
            what = op[4:]
            if what == "CANCELLED":
                s["phase"], s["job"] = "AVAILABLE", None
            elif what in ("FAILED", "QC_REJECTED"):
                c = "f" if what == "FAILED" else "q"
                s[c] += 1
                limit = max_fail if c == "f" else max_qc
                s["phase"] = "RETRYABLE" if s[c] <= limit else what
                if s[c] <= limit:
                    s["job"] = None
            elif what == "MEASURED" and p != "CONTROL":
                s["phase"] = "RUNNING"
            elif what in ("RUNNING", "SUBMITTED"):
                s["phase"] = what
    return {k: (s["phase"], s["job"], s["f"], s["q"]) for k, s in state.items()}


def frame(spark, events):
    return spark.createDataFrame(events, "pool_idx BIGINT, ord BIGINT, op STRING, job_id STRING")


def as_dict(df):
    return {r.pool_idx: (r.phase, r.job_id, r.fail_retries, r.qc_retries) for r in df.collect()}


def make(seed, n=600, hot=0.7, jobs=3):
    rng = random.Random(seed)
    return [
        (0 if rng.random() < hot else rng.randint(1, 20), i, rng.choice(OPS), rng.choice([None] + [f"j{k}" for k in range(jobs)]))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed,hot", [(0, 0.0), (1, 0.7), (2, 0.95), (3, 1.0)])
def test_fold_of_split_candidates_equals_replay(spark, seed, hot):
    events = make(seed, hot=hot)
    assert as_dict(lc.fold_events(frame(spark, events), "ord")) == replay(events)


def test_release_across_partitions_needs_the_holder(spark):
    events = [(0, 0, "SUBMITTED", "mine")] + [(0, i, "RELEASE", f"other{i % 40}") for i in range(1, 400)]
    assert as_dict(lc.fold_events(frame(spark, events), "ord")) == replay(events)
    events.append((0, 1000, "RELEASE", "mine"))
    assert as_dict(lc.fold_events(frame(spark, events), "ord"))[0] == ("AVAILABLE", None, 0, 0)


@pytest.mark.parametrize("block,fan", [(1, 8), (16, 3), (1000, 64)])
def test_blocks_of_any_length_give_the_same_states(spark, block, fan):
    events = make(11, n=400, hot=0.8, jobs=2)
    assert as_dict(lc.fold_events(frame(spark, events), "ord", block=block, fan=fan)) == replay(events)


def test_blocks_that_settle_nothing_are_chained(spark):
    rng = random.Random(4)
    loose = ["SELECTED", "RUNNING", "RELEASE", "STOCKOUT", "OBS_RUNNING", "OBS_MEASURED", "LABELED", "CONTROL", "OBS_SUBMITTED"]
    for ops in (["SELECTED", "RUNNING", "RELEASE"], loose):
        events = [(k, i, rng.choice(ops), rng.choice([None, "", "a", "b", "c"])) for k in (0, 1) for i in range(240)]
        assert as_dict(lc.fold_events(frame(spark, events), "ord", block=8, fan=3)) == replay(events)


def test_retries_run_on_over_blocks(spark):
    events = [(0, i, "OBS_FAILED", None) for i in range(50)] + [(0, 50, "LABELED", None)]
    events += [(0, 51 + i, "OBS_FAILED", None) for i in range(50)] + [(0, 101, "SUBMITTED", "j")] + [(0, 102 + i, "OBS_QC_REJECTED", None) for i in range(9)]
    state = lc.fold_events(frame(spark, events), "ord", block=7, fan=2)
    assert as_dict(state)[0][2:] == (50, 9) and as_dict(state) == replay(events)
    assert as_dict(lc.fold_events(frame(spark, events), "ord", 60, 3, block=7, fan=2)) == replay(events, 60, 3)


def test_rows_without_candidate_or_operation_and_empty_logs(spark):
    odd = [(None, 0, "CONTROL", None), (-1, 0, "CONTROL", None), (3, 0, None, "j"), (4, 0, "UNHEARD", "j"), (5, None, "SELECTED", "j")]
    assert as_dict(lc.fold_events(frame(spark, odd), "ord")) == {4: ("AVAILABLE", None, 0, 0), 5: ("SELECTED", "j", 0, 0)}
    assert as_dict(lc.fold_events(frame(spark, []), "ord")) == {}


def test_the_fold_needs_no_python_worker(spark, monkeypatch):
    plans, write = [], lc.cut_lineage
    plan = lambda df: df._jdf.queryExecution().toString()
    monkeypatch.setattr(lc, "cut_lineage", lambda df: plans.append(plan(df)) or write(df))
    plans.append(plan(lc.fold_events(frame(spark, make(1, n=50)).repartition(2), "ord")))
    assert len(plans) == 3 and not any(word in p for p in plans for word in ("InPandas", "InArrow", "ArrowEval", "BatchEvalPython"))


@pytest.mark.parametrize("seed", [5, 6])
def test_fold_goes_on_from_a_snapshot(spark, seed):
    events = make(seed)
    first = lc.fold_events(frame(spark, events[:250]), "ord")
    both = lc.fold_events(frame(spark, events[250:]), "ord", prior=first, block=9, fan=4)
    assert as_dict(both) == replay(events)


def obs_frame(spark, rows):
    full = [(p, t, k, s, s == "COMPLETED", [1.0] if s == "COMPLETED" else None) for p, t, k, s in rows]
    return spark.createDataFrame(full, "pool_idx BIGINT, ord BIGINT, kind STRING, state STRING, qc_passed BOOLEAN, values ARRAY<DOUBLE>")


@pytest.mark.parametrize("seed", range(4))
def test_aggregate_form_equals_the_fold(spark, seed):
    rng = random.Random(seed)
    kinds = ["experimental"] * 5 + ["replicate", "positive", "blank"]
    states = ["RUNNING", "COMPLETED", "FAILED", "QC_REJECTED", "CANCELLED", "SUBMITTED"]
    rows = [(rng.randint(-1, 25), i, rng.choice(kinds), rng.choice(states)) for i in range(300)]
    obs = obs_frame(spark, rows)
    quick = {r.pool_idx: (r.phase, r.fail_retries, r.qc_retries) for r in lc.observation_phases(obs, "ord").collect()}
    import pyspark.sql.functions as F

    ops = obs.withColumn("op", lc.event_op()).withColumn("job_id", F.lit(None).cast("string"))
    slow = {k: (p, f, q) for k, (p, _, f, q) in as_dict(lc.fold_events(ops, "ord")).items()}
    # a candidate whose events never matter has no row in the fold: it is simply available
    assert {k: v for k, v in quick.items() if k in slow} == slow
    assert all(v == ("AVAILABLE", 0, 0) for k, v in quick.items() if k not in slow)


def test_retries_then_final(spark):
    def phase(*states):
        rows = [(0, i, "experimental", s) for i, s in enumerate(states)]
        return lc.observation_phases(obs_frame(spark, rows), "ord").first().phase

    assert phase("FAILED") == "RETRYABLE" and phase("FAILED", "FAILED") == "FAILED"
    assert phase("QC_REJECTED") == "RETRYABLE" and phase("QC_REJECTED", "QC_REJECTED") == "QC_REJECTED"


def test_label_is_sticky_and_sync_counts_once(spark):
    events = [(0, 0, "LABELED", None), (0, 1, "OBS_FAILED", None), (1, 0, "OBS_MEASURED", None), (2, 0, "OBS_MEASURED", None)]
    state = lc.fold_events(frame(spark, events), "ord")
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "pool_idx BIGINT")
    out = as_dict(lc.sync_labels(state, ids(1), ids(2)))
    assert out[0][0] == "LABELED" and out[1][0] == "LABELED" and out[2] == ("RETRYABLE", None, 0, 1)
    again = lc.sync_labels(lc.sync_labels(state, ids(1), ids(2)), ids(1), ids(2))
    assert as_dict(again)[2] == ("RETRYABLE", None, 0, 1)
