"""Keyed stream state: running order statistics and running lifecycles, a micro-batch at a time.

State lives in Spark's RocksDB state store, so a micro-batch reads and writes the state of the candidates it touches and nothing
else: no log and no earlier snapshot is read again. Both operators take a batch table as their first state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pickwise.functions.states import PHASES, contributes
from pickwise.operators import lifecycle as lc
from pickwise.operators.observations import qc_rejected

RUN_VALUES = 512  # distinct values a stored run aims at; a run of more than twice as many is split
BLOCK_BITS = 8  # candidates whose ids agree but for the last bits share one state row
PIECE_VALUES = 200_000  # counted values of a block that wait in memory before they go to the state
_MOMENTS, _COUNTED = ("ids", "n", "mean", "m2", "wide"), ("of", "vals", "counts")
_TYPES = (np.int64, np.int64, np.float64, np.float64, np.int8, np.int64, np.float64, np.int64)
LABEL_SCHEMA = "pool_idx BIGINT, n BIGINT, agg0 DOUBLE, mean0 DOUBLE, std0 DOUBLE"
STATE_SCHEMA = "pool_idx BIGINT, phase STRING, job_id STRING, fail_retries INT, qc_retries INT"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, which keyed state needs; a provider the user chose is left alone."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name):
        spark.conf.set(name, _ROCKSDB)


# ---- running medians ----------------------------------------------------------------------------

def merge_counts(values: np.ndarray, counts: np.ndarray, new_values: np.ndarray, new_counts: np.ndarray):
    """Two sorted (value, count) runs as one."""
    both, at = np.unique(np.concatenate([values, new_values]), return_inverse=True)
    total = np.zeros(len(both), dtype=np.int64)
    np.add.at(total, at, np.concatenate([counts, new_counts]))
    return both, total


class RunningOrder:
    """How often each value of one candidate came, as sorted runs of bounded length (``runs``), and an ``index`` of the runs with their totals.

    A micro-batch reads the index, the runs its values fall into and the one or two runs that hold the middle ranks.
    """

    def __init__(self, run_values: int = RUN_VALUES):
        self.run_values = run_values

    def _run(self, run_id: int) -> tuple[np.ndarray, np.ndarray]:
        values, counts = self.runs.getValue((run_id,))
        return np.array(values, dtype=float), np.array(counts, dtype=np.int64)

    def _take(self, values: np.ndarray, counts: np.ndarray) -> None:
        """Sorted distinct values with their counts into the stored runs."""
        stored = self.index.get() if self.index.exists() else ([], [], [], 0)
        firsts, totals, ids, following = list(stored[0]), list(stored[1]), list(stored[2]), stored[3]
        home = np.maximum(np.searchsorted(np.array(firsts, dtype=float), values, side="right") - 1, 0)
        # from the last run to the first, so that places before a split run stay as they are
        for place in np.unique(home)[::-1].tolist():
            mine = home == place
            run, of = values[mine], counts[mine]
            known = place < len(ids)
            if known:
                run, of = merge_counts(*self._run(ids[place]), run, of)
            pieces = 1 if len(run) <= 2 * self.run_values else -(-len(run) // self.run_values)
            cut = [(v, c) for v, c in zip(np.array_split(run, pieces), np.array_split(of, pieces))]
            numbers = [ids[place]] if known else []
            while len(numbers) < pieces:
                numbers.append(following)
                following += 1
            for number, (v, c) in zip(numbers, cut):
                self.runs.updateValue((number,), (v.tolist(), c.tolist()))
            firsts[place:place + 1] = [float(v[0]) for v, _ in cut]
            totals[place:place + 1] = [int(c.sum()) for _, c in cut]
            ids[place:place + 1] = numbers
        self.index.update((firsts, totals, ids, following))
        self._order = (totals, ids)

    def recall(self) -> None:
        """The stored order, for ranks without new values."""
        _, totals, ids, _ = self.index.get()
        self._order = (list(totals), list(ids))

    def _ranked(self, rank: int) -> float:
        """The ``rank``-th smallest value, from 1."""
        totals, ids = self._order
        upto = np.cumsum(totals)
        place = int(np.searchsorted(upto, rank))
        values, counts = self._run(ids[place])
        return float(values[np.searchsorted(np.cumsum(counts), rank - (upto[place] - totals[place]))])


class _Of:
    """The part of a map state that belongs to one candidate: its single value, or its entries by a further key."""

    def __init__(self, state, pool_idx: int):
        self.state, self.key = state, (pool_idx,)

    def exists(self) -> bool:
        return self.state.containsKey(self.key)

    def get(self) -> tuple:
        return self.state.getValue(self.key)

    def update(self, row: tuple) -> None:
        self.state.updateValue(self.key, row)

    def getValue(self, key: tuple) -> tuple:
        return self.state.getValue((*self.key, *key))

    def updateValue(self, key: tuple, row: tuple) -> None:
        self.state.updateValue((*self.key, *key), row)


def _starts(ids: np.ndarray) -> np.ndarray:
    """Where each group of equal, sorted ids begins."""
    return np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.empty(0, dtype=np.int64)


def _collapsed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, value, count) lists as one, sorted by id and value, each pair once."""
    ids, values, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((values, ids))
    ids, values, counts = ids[order], values[order], counts[order]
    if not len(ids):
        return ids, values, counts
    fresh = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (values[1:] != values[:-1])])
    return ids[fresh], values[fresh], np.add.reduceat(counts, fresh)


class RunningOrders(StatefulProcessor):
    """The candidates of one block of ids: counted values of those with few different ones together in one state row, the others as runs.

    A block costs a micro-batch two or three calls of the state store, however many of its candidates it touches; a candidate of more than
    ``2 * run_values`` different values has its own index and runs (``RunningOrder``). A hot candidate's events are counted in pieces of
    about ``PIECE_VALUES``, so a task holds one block's short lists and one piece.
    """

    def __init__(self, run_values: int = RUN_VALUES):
        self.run_values = run_values

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.block = handle.getValueState("block", ", ".join(f"{c} BINARY" for c in (*_MOMENTS, *_COUNTED)))
        self.index = handle.getMapState("index", "pool_idx BIGINT", "firsts ARRAY<DOUBLE>, totals ARRAY<BIGINT>, ids ARRAY<BIGINT>, next BIGINT")
        self.runs = handle.getMapState("runs", "pool_idx BIGINT, id BIGINT", "vals ARRAY<DOUBLE>, counts ARRAY<BIGINT>")

    def _load(self) -> None:
        kept = [np.frombuffer(x, dtype=d) for x, d in zip(self.block.get(), _TYPES)] if self.block.exists() else [np.empty(0, dtype=d) for d in _TYPES]
        self.moments, self.counted = pd.DataFrame(dict(zip(_MOMENTS[1:], kept[1:5])), index=kept[0]), tuple(kept[5:])

    def _save(self) -> None:
        m = self.moments
        kept = [m.index.to_numpy(), *(m[c].to_numpy() for c in _MOMENTS[1:]), *self.counted]
        self.block.update(tuple(np.ascontiguousarray(x, dtype=d).tobytes() for x, d in zip(kept, _TYPES)))

    def _order(self, pool_idx: int) -> RunningOrder:
        order = RunningOrder(self.run_values)
        order.index, order.runs = _Of(self.index, pool_idx), _Of(self.runs, pool_idx)
        return order

    def _spread(self, ids: np.ndarray, values: np.ndarray, counts: np.ndarray) -> None:
        """Counts, means and sums of squared distances, the stored ones merged with the new ones."""
        first = _starts(ids)
        n = np.add.reduceat(counts, first)
        mean = np.add.reduceat(values * counts, first) / n
        m2 = np.add.reduceat(counts * (values - np.repeat(mean, np.diff(np.r_[first, len(ids)]))) ** 2, first)
        every = self.moments.index.union(ids[first])
        old = self.moments.reindex(every, fill_value=0)
        at = every.get_indexer(ids[first])
        n0, mean0, m20 = (old[c].to_numpy()[at] for c in ("n", "mean", "m2"))
        off = np.where(n0 > 0, mean - mean0, 0.0)
        fresh = {"n": n0 + n, "mean": np.where(n0 > 0, mean0 + off * n / (n0 + n), mean), "m2": m2 + m20 + off * off * n0 * n / (n0 + n)}
        for c, v in fresh.items():
            column = old[c].to_numpy().copy()
            column[at] = v
            old[c] = column
        self.moments = old

    def _add(self, ids: np.ndarray, values: np.ndarray, counts: np.ndarray) -> None:
        """Sorted pairs of candidate and value, each once, with their counts."""
        self._spread(ids, values, counts)
        is_wide = self.moments["wide"].to_numpy().astype(bool)
        wide = self.moments.index.to_numpy()[is_wide]
        runs = np.isin(ids, wide)
        few = _collapsed([self.counted, (ids[~runs], values[~runs], counts[~runs])])
        first = _starts(few[0])
        long = few[0][first][np.diff(np.r_[first, len(few[0])]) > 2 * self.run_values]
        grown = np.isin(few[0], long)
        self.counted = tuple(x[~grown] for x in few)
        for part, mine in (((ids, values, counts), runs), (few, grown)):
            of, vals, times = (x[mine] for x in part)
            first = _starts(of)
            for start, stop in zip(first.tolist(), [*first[1:].tolist(), len(of)]):
                self._order(int(of[start]))._take(vals[start:stop], times[start:stop])
        self.moments["wide"] = is_wide | self.moments.index.isin(long)

    def _pieces(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held, rows, bound = [], 0, PIECE_VALUES
        for frame in frames:
            ids, values = frame["pool_idx"].to_numpy(dtype=np.int64), frame["value"].to_numpy(dtype=float)
            held.append((ids, values, np.ones(len(ids), dtype=np.int64)))
            rows += len(ids)
            if rows >= bound:
                held = [_collapsed(held)]
                if len(held[0][0]) * 2 > PIECE_VALUES:
                    yield held.pop()
                rows = len(held[0][0]) if held else 0
        if held:
            yield _collapsed(held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        touched = []
        for piece in self._pieces(rows):
            self._add(*piece)
            touched.append(np.unique(piece[0]))
        self._save()
        ids = np.unique(np.concatenate(touched))
        mine = self.moments.loc[ids]
        n = mine["n"].to_numpy()
        middle = self._middles(ids, n, mine["wide"].to_numpy().astype(bool))
        yield pd.DataFrame({"pool_idx": ids, "n": n, "agg0": middle, "mean0": mine["mean"].to_numpy(), "std0": (mine["m2"].to_numpy() / n) ** 0.5})

    def _middles(self, ids: np.ndarray, n: np.ndarray, wide: np.ndarray) -> np.ndarray:
        of, values, counts = self.counted
        out = np.empty(len(ids))
        few = ~wide
        if few.any():
            upto = np.cumsum(counts)
            start = np.searchsorted(of, ids[few])
            before = upto[start] - counts[start]
            out[few] = sum(values[np.searchsorted(upto, before + rank)] / 2 for rank in ((n[few] + 1) // 2, n[few] // 2 + 1))
        for at in np.flatnonzero(wide).tolist():
            order = self._order(int(ids[at]))
            order.recall()
            out[at] = order._ranked((int(n[at]) + 1) // 2) / 2 + order._ranked(int(n[at]) // 2 + 1) / 2
        return out

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._load()
        for piece in self._pieces(iter([initialState])):
            self._add(*piece)
        self._save()

    def close(self) -> None:
        pass


def stream_medians(obs: DataFrame, objective: int = 0, run_values: int = RUN_VALUES) -> DataFrame:
    """Running count, exact median (``agg0``), mean and spread of one objective, a row for each candidate a micro-batch touches.

    Results may come in any order and late. Put ``stream_dedupe`` before it where the source repeats events. NULL and NaN values and
    results that do not count change nothing; -0.0 is 0.0. The latest row of a candidate is its state (``latest_rows``).
    """
    value = F.get("values", F.lit(objective)).cast("double")
    rows = obs.filter(contributes()).select(F.col("pool_idx").cast("long").alias("pool_idx"), (value + F.lit(0.0)).alias("value"))
    rows = rows.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    use_keyed_state(obs.sparkSession)
    rows = rows.withColumn("block", F.shiftright("pool_idx", BLOCK_BITS))
    return rows.groupBy("block").transformWithStateInPandas(RunningOrders(run_values), LABEL_SCHEMA, "append", "none")


def with_verdict(labels: DataFrame, max_std: float | None = 1.0, min_replicates: int = 2) -> DataFrame:
    """The batch rule for replicates that disagree, on running labels."""
    return labels.withColumn("rejected", qc_rejected(max_std, min_replicates))


# ---- running lifecycle --------------------------------------------------------------------------

_SAME, _OTHER = "same", "other"  # jobs by how they relate: the one that holds the candidate, another one


def transitions(spark: SparkSession) -> dict[tuple, tuple]:
    """What each event does to each phase, read off the batch rules: (op, phase, retries spent, holding job, named job) to (phase, job).

    Jobs are ``None``, empty, the holding one or another one, so the table has a fixed size, whatever the log.
    """
    ops = (*lc.MARKS, "OBS_CANCELLED", "OBS_FAILED", "OBS_QC_REJECTED", "OBS_MEASURED", "OBS_RUNNING", "OBS_SUBMITTED")
    cases = [
        (op, phase, spent, held, job)
        for op in ops if op != "RESTORE" for phase in PHASES for spent in (False, True)
        for held in (None, _SAME) for job in (None, "", _SAME, _OTHER)
    ]
    rows = spark.createDataFrame(cases, "op STRING, p STRING, spent BOOLEAN, held STRING, job_id STRING")
    event = F.struct("op", "job_id", F.lit(None).cast("string").alias("phase"))
    tries = F.col("spent").cast("int")
    entered = F.array(lc._image(F.col("p"), F.col("held"), F.col("p"), F.col("held")))
    after = F.get(lc._apply(entered, event, F.col("p") == "LABELED", tries, tries, 0, 0), F.lit(0))
    done = rows.select("op", "p", "spent", "held", "job_id", after["phase"].alias("phase"), after["job"].alias("job"))
    return {(r.op, r.p, r.spent, r.held, r.job_id): (r.phase, r.job) for r in done.collect()}


class RunningPhase(StatefulProcessor):
    """Per candidate: phase, job and retry counters. The events of a micro-batch are taken in order on top of them."""

    def __init__(self, table: dict[tuple, tuple], max_fail_retries: int, max_qc_retries: int):
        self.table = table
        self.limits = {"OBS_FAILED": max_fail_retries, "OBS_QC_REJECTED": max_qc_retries}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "phase STRING, job_id STRING, fails INT, rejects INT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        phase, held, fails, rejects = self.state.get() if self.state.exists() else ("AVAILABLE", None, 0, 0)
        tried = {"OBS_FAILED": fails, "OBS_QC_REJECTED": rejects}
        events = pd.concat(list(rows)).sort_values(["placed", "place", "op", "job_id"], na_position="first", kind="stable")
        for op, job in zip(events["op"], events["job_id"].where(events["job_id"].notna(), None)):
            if op in tried and phase != "LABELED":
                tried[op] += 1
            spent = op in tried and tried[op] > self.limits[op]
            named = None if job is None else _SAME if job == held else "" if job == "" else _OTHER
            phase, holder = self.table[op, phase, spent, None if held is None else _SAME, named]
            if holder != _SAME:
                held = None if holder is None else job
        after = (phase, held, tried["OBS_FAILED"], tried["OBS_QC_REJECTED"])
        self.state.update(after)
        yield pd.DataFrame([(key[0], *after)], columns=["pool_idx", "phase", "job_id", "fail_retries", "qc_retries"])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        held = None if pd.isna(row["job_id"]) else row["job_id"]
        self.state.update((row["phase"], held, int(row["fail_retries"]), int(row["qc_retries"])))

    def close(self) -> None:
        pass


def stream_marks(
    events: DataFrame, order: str, max_fail_retries: int = 1, max_qc_retries: int = 1, snapshot: DataFrame | None = None
) -> DataFrame:
    """Running state of the candidates that ``events(pool_idx, <order>, op, job_id)`` touch, marks and results mixed.

    ``order`` is a whole number; it holds within a micro-batch, and micro-batches count in the order they arrive, as marks do. Events
    of equal place are taken by operation and job, those without a place come first. Rows without a candidate or with an unknown
    operation change nothing. ``snapshot`` (pool_idx, phase, job_id, fail_retries, qc_retries; one row a candidate) is where a new
    checkpoint begins. What one task holds at once is one candidate's events of a micro-batch.
    """
    spark = events.sparkSession
    use_keyed_state(spark)
    table = transitions(spark)
    known = (F.col("pool_idx") >= 0) & F.col("op").isin(*sorted({op for op, *_ in table}))
    rows = events.filter(known).select(
        F.col("pool_idx").cast("long").alias("pool_idx"), F.col(order).isNotNull().alias("placed"),
        F.coalesce(F.col(order).cast("long"), F.lit(0)).alias("place"), "op", "job_id",
    )
    first = None
    if snapshot is not None:
        first = snapshot.select(
            F.col("pool_idx").cast("long").alias("pool_idx"), "phase", "job_id", F.col("fail_retries").cast("int").alias("fail_retries"),
            F.col("qc_retries").cast("int").alias("qc_retries"),
        ).groupBy("pool_idx")
    step = RunningPhase(table, max_fail_retries, max_qc_retries)
    return rows.groupBy("pool_idx").transformWithStateInPandas(step, STATE_SCHEMA, "append", "none", first)
