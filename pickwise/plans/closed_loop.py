"""The closed loop made of the engine's own operators.

A round is: observation log -> first event per item -> replicate aggregates and quality control -> candidate phases -> what is available
-> batch -> job items -> evaluation -> new observations. Nothing is carried along but the log: every state is derived from it, so a loop
that was stopped goes on after its last finished round, and a half-written round is written anew.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwise.functions.states import available as is_available
from pickwise.functions.states import inflight
from pickwise.operators.acquire import initial_batch
from pickwise.operators.jobs import reveal
from pickwise.operators.lifecycle import observation_phases, sync_labels
from pickwise.operators.metrics import report
from pickwise.operators.observations import dedupe, replicate_stats, split_labels
from pickwise.operators.surrogate import Surrogate
from pickwise.plans.campaign import Rules, select_round
from pickwise.session import cut_lineage, scratch_path
from pickwise.sources.stores import save_version, versions

ITEM = ("job_id", "item_id", "round", "rank", "pool_idx", "smiles", "compound_id", "kind")
OBSERVATION = (*ITEM, "state", "values", "qc_passed", "message", "ts", "seq")
ORDER = ("seq",)
Evaluate = Callable[[DataFrame], DataFrame]
"""Items (columns ``ITEM``) to observations: adds state, values, qc_passed and message; an item may be observed more than once or, while
it is under way, as RUNNING. A column ``seq`` orders the events of one round; without it all of a round are simultaneous."""


@dataclass(frozen=True)
class Policy:
    """Rules of the loop around the selection rules: quality control, retries, what is never evaluated."""

    max_std: float | None = 1.0
    min_replicates: int = 2
    method: str = "mean"
    max_fail_retries: int = 1
    max_qc_retries: int = 1
    plate_limit: int | None = None


@dataclass(frozen=True)
class State:
    labels: DataFrame
    rejected: DataFrame
    phases: DataFrame


def derive(log: DataFrame, rules: Rules, policy: Policy) -> State:
    """Labels, rejected aggregates and candidate phases of an observation log."""
    first = cut_lineage(dedupe(log, ORDER))
    # an item under way has no result yet: its events set phases, never labels
    stats = replicate_stats(first, len(rules.objectives), ORDER, policy.method)
    labels, rejected = split_labels(stats, policy.max_std, policy.min_replicates)
    phases = observation_phases(first, "seq", policy.max_fail_retries, policy.max_qc_retries)
    return State(labels, rejected, cut_lineage(sync_labels(phases, labels, rejected, policy.max_qc_retries)))


def evaluate_from(truth: DataFrame, names: tuple[str, ...], fails: Column | None = None) -> Evaluate:
    """Evaluation that reveals stored labels; items for which ``fails`` holds, and those without a label, fail."""

    def evaluate(items: DataFrame) -> DataFrame:
        seen = reveal(items, truth, F.array(*names))
        if fails is None:
            return seen
        bad = fails & (seen["state"] == "COMPLETED")
        return seen.withColumns({
            "state": F.when(bad, "FAILED").otherwise(F.col("state")), "values": F.when(~bad, F.col("values")),
            "qc_passed": F.col("qc_passed") & ~bad, "message": F.when(bad, "evaluation failed").otherwise(F.col("message")),
        })

    return evaluate


def run_loop(
    candidates: DataFrame, evaluate: Evaluate, rules: Rules, rounds: int, policy: Policy = Policy(), path: str | None = None,
    surrogate: Surrogate | None = None, controls: DataFrame | None = None, imported: DataFrame | None = None,
) -> DataFrame:
    """The observation log of up to ``rounds`` rounds after the initial one.

    ``candidates`` (pool_idx, smiles, the rules' features); ``controls`` (pool_idx) are never selected; ``imported`` holds observations
    made before. Stock and ease rules apply to the first batch too. The loop stops when nothing is available.
    """
    spark = candidates.sparkSession
    root = path or scratch_path(spark, "loop")
    total = candidates.count()
    done = versions(spark, root)
    library = candidates if "compound_id" in candidates.columns else candidates.withColumn("compound_id", F.concat(F.lit("C"), F.col("pool_idx").cast("string")))

    def log() -> DataFrame | None:
        parts = [spark.read.parquet(f"{root.rstrip('/')}/version={v}") for v in done]
        parts += [imported.select(*OBSERVATION)] if imported is not None else []
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    for r in range(rounds + 1):
        if r in done:
            continue
        past = log()
        state = derive(past, rules, policy) if past is not None else None
        free = library
        if state is not None:
            free = free.join(state.phases.filter(~is_available()).select("pool_idx"), "pool_idx", "left_anti")
        if controls is not None:
            free = free.join(controls.select("pool_idx"), "pool_idx", "left_anti")
        if free.isEmpty():
            break
        if r == 0:
            if rules.stock is not None:
                free = free.filter(F.coalesce(rules.stock, F.lit(False)))
            batch = initial_batch(free, total, rules.init_fraction, rules.seed, policy.plate_limit, keep=(rules.features,))
        else:
            names = [F.col(f"agg{i}").alias(n) for i, n in enumerate(rules.objectives)]
            known = state.labels.select("pool_idx", *names).join(library.select("pool_idx", rules.features), "pool_idx")
            under_way = state.phases.filter(inflight()).select("pool_idx").join(library.select("pool_idx", rules.features), "pool_idx")
            pending = under_way.withColumnRenamed(rules.features, "fp") if rules.similarity else None
            batch = select_round(free, known, rules, pending=pending, surrogate=surrogate, round_no=r)
        items = batch.select("rank", "pool_idx").join(library.select("pool_idx", "smiles", "compound_id"), "pool_idx").select(
            F.lit(f"round-{r}").alias("job_id"), F.concat_ws("-", F.lit(f"item-{r}"), F.col("pool_idx").cast("string")).alias("item_id"),
            F.lit(r).alias("round"), "rank", "pool_idx", "smiles", "compound_id", F.lit("experimental").alias("kind"),
        )
        seen = evaluate(items)
        local = F.col("seq") if "seq" in seen.columns else F.lit(0)
        seen = seen.withColumn("seq", F.lit(r).cast("long") * F.lit(1 << 32) + local.cast("long")).withColumn("ts", F.timestamp_seconds("seq"))
        save_version(seen.select(*OBSERVATION), root, r)
        done = [*done, r]
    return log()


def loop_history(truth: DataFrame, log: DataFrame, rules: Rules, policy: Policy = Policy()) -> DataFrame:
    """One row per round: the metrics of the labels known by then, with the round's own outcome counts, job and strategy."""
    last = log.agg(F.max("round")).first()[0]
    name = rules.acquisition if isinstance(rules.acquisition, str) else getattr(rules.acquisition, "__name__", "custom")
    first = dedupe(log, ORDER)
    upto = first.withColumn("upto", F.explode(F.sequence(F.col("round"), F.lit(last))))
    stats = replicate_stats(upto, len(rules.objectives), ORDER, policy.method, by=["upto"])
    labels, _ = split_labels(stats, policy.max_std, policy.min_replicates)
    metrics = report(truth, labels.select(F.col("upto").alias("round"), "pool_idx"), list(rules.objectives), by=["round"])
    counts = first.groupBy("round", "job_id").agg(
        F.count(F.lit(1)).alias("submitted"), F.count_if(F.col("state") == "COMPLETED").alias("completed"),
        F.count_if(F.col("state") == "FAILED").alias("failed"), F.count_if(F.col("state") == "QC_REJECTED").alias("qc_rejected"),
    )
    return counts.join(metrics, "round", "left").withColumn("acquisition", F.lit(name.lower())).withColumn("batch_seq", F.col("round"))

