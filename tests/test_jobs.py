import random

import pytest

from pickwise.operators import jobs as jb


def replay(log):
    out = {}
    for job, o, _ in log:
        s = out.setdefault(job, {"st": "SUBMITTED", "r": 0, "e": 0, "n": 0})
        if s["st"] in ("DONE", "FAILED"):
            continue
        s["n"] += 1
        if o == "DONE":
            s["st"], s["e"] = "DONE", 0
        elif o == "RUNNING":
            s["st"], s["e"] = "RUNNING", 0
        elif o == "REFUSED":
            s["st"] = "FAILED"
        elif o == "LOST":
            if s["r"] >= 2:
                s["st"] = "FAILED"
            else:
                s["r"], s["st"] = s["r"] + 1, "RUNNING"
        else:
            s["e"] += 1
            if s["e"] >= 3:
                s["st"] = "FAILED"
    return {k: (s["st"], s["r"], s["e"], s["n"]) for k, s in out.items()}


@pytest.mark.parametrize("seed,common", [(0, ["ERROR"] * 2 + ["RUNNING"] * 5), (1, ["ERROR"] * 3 + ["RUNNING"] * 2 + ["LOST"]), (2, ["LOST", "RUNNING"])])
def test_poll_log(spark, seed, common):
    rng = random.Random(seed)
    jobs = [0] * 6 + list(range(1, 12))  # job 0 holds a third of all polls
    log = [(rng.choice(jobs), rng.choice(common * 6 + ["DONE", "REFUSED"]), i) for i in range(400)]
    df = spark.createDataFrame(log, "job_id INT, outcome STRING, ord BIGINT").repartition(5)
    got = {r.job_id: (r.status, r.retry_count, r.poll_fail_count, r.n_polls) for r in jb.poll_outcomes(df, "ord", 3, 2).collect()}
    assert got == replay(log)


def test_idempotent_submission(spark):
    new = spark.createDataFrame([("k1", "a", 1), ("k1", "b", 2), ("k2", "c", 3)], "idempotency_key STRING, job_id STRING, at INT")
    old = spark.createDataFrame([("k2", "z", 0)], "idempotency_key STRING, job_id STRING, at INT")
    got = {r.job_id: (r.assigned_job_id, r.is_new) for r in jb.submit_once(new, old, "at").collect()}
    assert got == {"a": ("a", True), "b": ("a", True), "c": ("z", False)}


def test_pending_progress_and_cancel(spark):
    items = spark.createDataFrame(
        [("j", "i1", 1, "experimental"), ("j", "i2", 2, "experimental"), ("k", "i3", 3, "experimental"), ("j", "i4", 4, "replicate"), ("j", "i5", -1, "experimental")],
        "job_id STRING, item_id STRING, pool_idx BIGINT, kind STRING",
    )
    ledger = spark.createDataFrame([("j", "RUNNING"), ("k", "DONE")], "job_id STRING, status STRING")
    assert sorted(r.pool_idx for r in jb.pending_set(items, ledger).collect()) == [1, 2]
    results = items.filter("item_id in ('i1', 'i3')")
    progress = {r.job_id: (r.n_items, r.n_pending, r.done) for r in jb.job_progress(items, results).collect()}
    assert progress == {"j": (4, 3, False), "k": (1, 0, True)}
    assert sorted(r.item_id for r in jb.cancel_rows(items, results).collect()) == ["i2", "i4", "i5"]
