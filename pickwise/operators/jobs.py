"""The job ledger: revealing results, progress, idempotent submission, poll outcomes, retries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwise.functions.states import inflight, job_candidate, open_job, terminal
from pickwise.operators.scale import global_index, top_k_per

# A job fails after this many poll errors in a row, or when lost again after this many re-submissions.
MAX_POLL_FAILS = 8
MAX_RESUBMIT = 3


def reveal(items: DataFrame, labels: DataFrame, values: Column) -> DataFrame:
    """Results for job items from a label table.

    Blank items complete without a value and never pass quality control; an item whose candidate
    has no label fails.
    """
    truth = labels.select("pool_idx", values.alias("_values"), F.lit(True).alias("_known"))
    blank = (F.col("kind") == "blank") | (F.col("pool_idx") < 0)
    known = F.col("_known").isNotNull()
    # fixed value: the wording of a missing label
    missing = F.concat(F.lit("missing truth for pool_idx="), F.col("pool_idx").cast("string"))
    # blanks share one candidate number and never meet a label: only the others are joined
    plain = items.filter(F.coalesce(blank, F.lit(False))).withColumns({"_values": F.lit(None).cast(truth.schema["_values"].dataType), "_known": F.lit(None).cast("boolean")})
    return (
        items.filter(~F.coalesce(blank, F.lit(False))).join(truth, "pool_idx", "left").unionByName(plain)
        .withColumn("values", F.when(~blank & known, F.col("_values")))
        .withColumn("state", F.when(blank | known, F.lit("COMPLETED")).otherwise(F.lit("FAILED")))
        .withColumn("qc_passed", ~blank & known)
        .withColumn("message", F.when(blank, F.lit("no value expected")).when(known, F.lit("ok")).otherwise(missing))
        .drop("_values", "_known")
    )


def reveal_labels(ids: DataFrame, labels: DataFrame, names: Sequence[str]) -> DataFrame:
    """Named label columns for a list of candidates."""
    return ids.select("pool_idx").join(labels.select("pool_idx", *names), "pool_idx")


def classify(scored: DataFrame) -> DataFrame:
    """Evaluation outcomes: blank, timeout, failed or ok; a lower affinity is a higher activity."""
    blank = (F.col("kind") == "blank") | (F.col("pool_idx") < 0)
    timeout = F.coalesce(F.col("message") == "timeout", F.lit(False))
    no_score = F.col("score").isNull()
    failed_text = F.coalesce(F.nullif(F.col("message"), F.lit("")), F.lit("evaluation failed"))
    ok = ~blank & ~timeout & ~no_score
    return (
        scored.withColumn(
            "task_state",
            F.when(blank, F.lit("COMPLETED")).when(timeout, F.lit("TIMEOUT")).when(no_score, F.lit("FAILED")).otherwise(F.lit("COMPLETED")),
        )
        .withColumn("state", F.when(blank | ok, F.lit("COMPLETED")).otherwise(F.lit("FAILED")))
        .withColumn("qc_passed", ok)
        .withColumn("activity", F.when(ok, -F.col("score")))
        .withColumn(
            "message",
            F.when(blank, F.lit("blank")).when(timeout, F.lit("evaluation timeout")).when(no_score, failed_text).otherwise(F.lit("ok")),
        )
    )


def retry_eligible(max_retries: int) -> Column:
    """An attempt without score that did not time out may run again while attempts remain."""
    timed_out = F.coalesce(F.col("message") == "timeout", F.lit(False))
    return F.col("score").isNull() & ~timed_out & (F.col("attempts") <= max_retries)


def new_terminal(results: DataFrame, seen: DataFrame) -> DataFrame:
    """Terminal results whose item the job has not reported before."""
    return results.filter(terminal()).join(seen.select("job_id", "item_id").distinct(), ["job_id", "item_id"], "left_anti")


def job_candidates(items: DataFrame) -> DataFrame:
    return items.filter(job_candidate())


def pending_set(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """Distinct candidates in experimental items of open jobs."""
    mine = items.filter((F.col("kind") == "experimental") & (F.col("pool_idx") >= 0))
    return mine.join(ledger.filter(open_job()).select("job_id"), "job_id", "left_semi").select("pool_idx").distinct()


def round_gate(ledger: DataFrame, target_round: int) -> DataFrame:
    """Per campaign: finished and open acquisition jobs, and whether another round may start."""
    acquisition = F.col("acquisition") != "init"
    return (
        ledger.groupBy("campaign_id")
        .agg(
            F.count_if(acquisition & (F.col("status") == "DONE")).alias("completed_rounds"),
            F.count_if(acquisition & open_job()).alias("inflight_rounds"),
            F.count_if(~acquisition & open_job()).alias("open_init"),
        )
        .withColumn("may_submit", F.col("completed_rounds") + F.col("inflight_rounds") < target_round)
    )


def inflight_counts(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return state.groupBy(*by).agg(F.count_if(inflight()).alias("n_inflight"))


def open_jobs(ledger: DataFrame) -> DataFrame:
    return ledger.filter(open_job())


def job_progress(items: DataFrame, results: DataFrame) -> DataFrame:
    """Per job: items, items still without a result, and whether it is finished."""
    have = results.select("item_id").distinct().withColumn("_have", F.lit(True))
    return (
        items.select("job_id", "item_id").distinct().join(have, "item_id", "left")
        .groupBy("job_id")
        .agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("_have").isNull()).alias("n_pending"))
        .withColumn("done", F.col("n_pending") == 0)
    )


def cancel_rows(items: DataFrame, results: DataFrame, source: str = "cancel") -> DataFrame:
    """A CANCELLED observation for every item that has no result yet."""
    left = items.join(results.select("item_id").distinct(), "item_id", "left_anti")
    return left.select(
        "job_id", "item_id", "pool_idx", "kind",
        F.lit("CANCELLED").alias("state"), F.lit(False).alias("qc_passed"),
        F.lit(source).alias("source"), F.lit("cancelled").alias("message"),
    )


def submit_once(new: DataFrame, ledger: DataFrame, order: str) -> DataFrame:
    """Job id each submission gets: a known idempotency key keeps its first id, and so does a key
    repeated within the new submissions."""
    first = new.groupBy("idempotency_key").agg(F.min_by("job_id", order).alias("_first"))
    known = ledger.groupBy("idempotency_key").agg(F.min_by("job_id", order).alias("_known"))
    ids = first.join(known, "idempotency_key", "left").select(
        "idempotency_key",
        F.coalesce("_known", "_first").alias("assigned_job_id"),
        F.col("_known").isNull().alias("is_new"),
    )
    return new.join(ids, "idempotency_key")


def with_score_cache(requests: DataFrame, cache: DataFrame, keys: Sequence[str] = ("job_id", "item_id")) -> tuple[DataFrame, DataFrame]:
    """(already scored, still to score)."""
    stored = cache.select(*keys, "score").dropDuplicates(list(keys))
    return requests.join(stored, list(keys)), requests.join(stored, list(keys), "left_anti")


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row per key; combines before the shuffle."""
    others = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_row")).select(key, "_row.*")


def poll_outcomes(
    polls: DataFrame, order: str, max_poll_fails: int = MAX_POLL_FAILS, max_resubmit: int = MAX_RESUBMIT
) -> DataFrame:
    """Job status after its poll log. ``outcome`` is RUNNING, DONE, ERROR, LOST or REFUSED.

    A job ends at its first DONE or REFUSED poll, at the ``max_poll_fails``-th ERROR in a row (a LOST
    poll neither adds nor resets), or when LOST once more after ``max_resubmit`` re-submissions.
    Errors follow each other without a gap when their numbers among all answers and among the errors
    grow alike, so no job's log is replayed in one task.
    """
    log = polls.select("job_id", "outcome", F.col(order).alias("ord"))
    outcome = F.col("outcome")
    answers = global_index(log.filter(outcome != "LOST"), ["job_id", "ord"], "at")
    errors = global_index(answers.filter(outcome == "ERROR"), ["at"], "nth").select("job_id", "ord", "at", "nth")
    back = max_poll_fails - 1
    begun = errors.select("job_id", (F.col("nth") + back).alias("nth"), (F.col("at") + back).alias("at"))
    failed = errors.join(begun, ["job_id", "nth", "at"]).groupBy("job_id").agg(F.min("ord").alias("failed_at"))
    lost = top_k_per(log.filter(outcome == "LOST"), ["job_id"], [F.asc("ord")], max_resubmit + 1, "n")
    gone = lost.filter(F.col("n") == max_resubmit + 1).select("job_id", F.col("ord").alias("gone_at"))
    ends = (
        log.groupBy("job_id").agg(
            F.min(F.when(outcome == "DONE", F.col("ord"))).alias("done_at"),
            F.min(F.when(outcome == "REFUSED", F.col("ord"))).alias("refused_at"),
        )
        .join(failed, "job_id", "left").join(gone, "job_id", "left")
        .select("job_id", "done_at", F.least("done_at", "refused_at", "failed_at", "gone_at").alias("end_at"))
    )
    live = log.join(ends, "job_id").filter(F.col("end_at").isNull() | (F.col("ord") <= F.col("end_at")))
    folded = live.groupBy("job_id", "end_at", "done_at").agg(
        F.count_if(outcome == "RUNNING").alias("n_running"),
        F.count_if(outcome == "LOST").alias("n_lost"),
        F.max(F.when(outcome.isin("RUNNING", "DONE"), F.col("ord"))).alias("reset_at"),
        F.count(F.lit(1)).alias("n_polls"),
    )
    after_reset = F.col("reset_at").isNull() | (F.col("ord") > F.col("reset_at"))
    open_errors = (
        live.filter(outcome == "ERROR").select("job_id", "ord").join(folded.select("job_id", "reset_at"), "job_id")
        .groupBy("job_id").agg(F.count_if(after_reset).alias("_e"))
    )
    ended = F.col("end_at").isNotNull()
    status = (
        F.when(ended & F.coalesce(F.col("end_at") == F.col("done_at"), F.lit(False)), F.lit("DONE"))
        .when(ended, F.lit("FAILED"))
        .when(F.col("n_running") + F.col("n_lost") > 0, F.lit("RUNNING"))
        .otherwise(F.lit("SUBMITTED"))
    )
    return folded.join(open_errors, "job_id", "left").select(
        "job_id", status.alias("status"), F.least("n_lost", F.lit(max_resubmit)).alias("retry_count"),
        F.coalesce("_e", F.lit(0)).alias("poll_fail_count"), "n_polls",
    )
