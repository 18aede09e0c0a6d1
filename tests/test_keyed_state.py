import random
from statistics import median, pstdev

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pickwise.operators.lifecycle import MARKS, fold_events
from pickwise.streaming import ingest as ing
from pickwise.streaming import keyed

OBS = "item_id STRING, pool_idx BIGINT, values ARRAY<DOUBLE>, state STRING, qc_passed BOOLEAN, kind STRING"
EVENTS = "pool_idx BIGINT, ord BIGINT, op STRING, job_id STRING"
OPS = [op for op in MARKS if op != "RESTORE"] + [f"OBS_{s}" for s in ("CANCELLED", "FAILED", "QC_REJECTED", "MEASURED", "RUNNING", "SUBMITTED")]


def obs(spark, rows, schema=OBS):
    return spark.createDataFrame([(i, p, v, "COMPLETED", True, "experimental") for i, p, v in rows], schema)


def feed(parts, path, make, tmp):
    """Each part is one micro-batch; every one of them is a run of its own from the checkpoint of the last."""
    for n, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{path}/{n}")
        spark = part.sparkSession
        stream = make(ing.read_stream(spark, f"{path}/*", part.schema))
        ing.run_available(stream, f"{tmp}/state", ing.append_updates(f"{tmp}/out"))
    return ing.latest_rows(spark, f"{tmp}/out", "pool_idx")


def test_medians_of_repeated_unordered_results(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(f"{i}", rnd.choice([0, 0, 0, 1, 2]), [rnd.choice([1.5, -2.0, rnd.random(), 1e300, -1e300])]) for i in range(400)]
    rows += [("n1", 0, [None]), ("n2", 1, [float("nan")]), ("n3", None, [1.0]), ("n4", -1, [1.0]), ("n5", 7, [-0.0]), ("n6", 8, [])]
    twice = rows + rows[:150]
    rnd.shuffle(twice)
    parts = [obs(spark, twice[i::3]) for i in range(3)]
    got = feed(parts, str(tmp_path / "in"), lambda s: keyed.stream_medians(ing.stream_dedupe(s), run_values=4), str(tmp_path))
    want = {}
    for _, p, v in rows:
        if p is not None and p >= 0 and v and v[0] is not None and v[0] == v[0]:
            want.setdefault(p, []).append(v[0])
    got = {r.pool_idx: (r.n, r.agg0) for r in got.collect()}
    assert {p: (n, np.float64(m)) for p, (n, m) in got.items()} == {p: (len(v), np.float64(median(v))) for p, v in want.items()}


def test_spread_and_verdict_follow_the_batch_rule(spark, tmp_path):
    values = {0: [1.0, 3.0, 8.0, 1.0], 1: [2.0, 2.0, 2.0], 2: [5.0]}
    rows = [(f"{p}-{i}", p, [v]) for p, vs in values.items() for i, v in enumerate(vs)]
    out = feed([obs(spark, rows[::2]), obs(spark, rows[1::2])], str(tmp_path / "in"), keyed.stream_medians, str(tmp_path))
    got = {r.pool_idx: r for r in keyed.with_verdict(out, 1.0).collect()}
    for p, vs in values.items():
        assert abs(got[p].std0 - pstdev(vs)) < 1e-9 and abs(got[p].mean0 - sum(vs) / len(vs)) < 1e-9
        assert got[p].rejected == (len(vs) > 1 and pstdev(vs) > 1.0)


def test_runs_stay_short_and_split_evenly():
    class Value:
        kept = None

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept

        def update(self, row):
            self.kept = row

    class Map(dict):
        reads = 0

        def getValue(self, key):
            self.reads += 1
            return self[key]

        def updateValue(self, key, row):
            self[key] = row

    op = keyed.RunningOrder(8)
    op.index, op.runs, op.moments = Value(), Map(), Value()
    rnd = random.Random(1)
    seen = []
    for n in range(60):
        batch = [rnd.gauss(0, 1) if n % 2 else float(rnd.randrange(40)) for _ in range(rnd.choice([1, 3, 50]))]
        seen += batch
        op._take(*np.unique(np.array(batch), return_counts=True))
        for rank in (1, (len(seen) + 1) // 2, len(seen)):
            assert op._ranked(rank) == sorted(seen)[rank - 1]
    assert max(len(v) for v, _ in op.runs.values()) <= 16 and len(op.runs) > 20
    op.runs.reads = 0
    op._take(np.array([0.5]), np.array([1]))
    op._ranked(len(seen) // 2)
    assert op.runs.reads == 2


def test_marks_in_state_equal_the_batch_fold(spark, tmp_path):
    rnd = random.Random(9)
    rows = [
        (rnd.choice([0, 0, *range(40), None, -1]), i, rnd.choice([*OPS, None]), rnd.choice([None, "", "a", "b"])) for i in range(3000)
    ]
    whole = spark.createDataFrame(rows, EVENTS)
    early, mid, late = (whole.filter((F.col("ord") >= a) & (F.col("ord") < b)) for a, b in ((0, 900), (900, 2000), (2000, 3000)))
    snapshot = fold_events(early, "ord")
    out = feed([mid, late], str(tmp_path / "in"), lambda s: keyed.stream_marks(s, "ord", snapshot=snapshot), str(tmp_path))
    columns = ("pool_idx", "phase", "job_id", "fail_retries", "qc_retries")
    assert sorted(map(str, out.select(*columns).collect())) == sorted(map(str, fold_events(whole, "ord").select(*columns).collect()))


def test_events_of_equal_or_no_place(spark, tmp_path):
    rows = [(1, 5, "RUNNING", "a"), (1, 5, "SUBMITTED", "a"), (2, None, "SUBMITTED", "b"), (2, 1, "RUNNING", None), (3, 1, "strange", "c")]
    df = spark.createDataFrame(rows, EVENTS)
    out = feed([df], str(tmp_path / "in"), lambda s: keyed.stream_marks(s, "ord"), str(tmp_path))
    assert sorted((r.pool_idx, r.phase, r.job_id) for r in out.collect()) == [(1, "SUBMITTED", "a"), (2, "RUNNING", "b")]


def test_candidates_of_a_block_share_calls_and_wide_ones_have_runs(spark, tmp_path, monkeypatch):
    """Ids of several blocks, some with many values, events counted in small pieces; the state store is called by block, not by candidate."""
    monkeypatch.setattr(keyed, "PIECE_VALUES", 40)
    calls = {"block": 0, "runs": 0}

    class Value:
        kept = None

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept

        def update(self, row):
            self.kept = row
            calls["block"] += 1

    class Map(dict):
        containsKey, getValue = dict.__contains__, dict.__getitem__

        def updateValue(self, key, row):
            self[key] = row
            calls["runs"] += 1

    op = keyed.RunningOrders(4)
    op.block, op.index, op.runs = Value(), Map(), Map()
    rnd, seen = random.Random(3), {}
    for n in range(6):
        rows = [(i, float(rnd.randrange(3))) for i in rnd.sample(range(200), 150)] + [(7, rnd.gauss(0, 1)) for _ in range(30 * (n % 2))]
        rnd.shuffle(rows)
        for i, v in rows:
            seen.setdefault(i, []).append(v)
        frames = [pd.DataFrame(rows[a:a + 25], columns=["pool_idx", "value"]) for a in range(0, len(rows), 25)]
        got = pd.concat(op.handleInputRows((0,), iter(frames), None)).set_index("pool_idx")
        assert set(got.index) == {i for i, _ in rows}
        for i in got.index:
            assert got.loc[i, "agg0"] == median(seen[i]) and got.loc[i, "n"] == len(seen[i])
            assert abs(got.loc[i, "std0"] - pstdev(seen[i])) < 1e-9 and abs(got.loc[i, "mean0"] - sum(seen[i]) / len(seen[i])) < 1e-9
    assert calls["block"] == 6 and {k[0] for k in op.runs} == {7} and list(op.index) == [(7,)]


def test_medians_of_far_apart_ids(spark, tmp_path):
    rows = [(f"{i}", p, [float(i % 5)]) for i, p in enumerate([0, 255, 256, 2**40, 2**62, 2**62 + 1] * 5)]
    out = feed([obs(spark, rows[:17]), obs(spark, rows[17:])], str(tmp_path / "in"), keyed.stream_medians, str(tmp_path))
    want = {p: median(v[0] for _, q, v in rows if q == p) for _, p, _ in rows}
    assert {r.pool_idx: r.agg0 for r in out.collect()} == want
