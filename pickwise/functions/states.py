"""State names and the row predicates built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the observation, job and candidate tables.
WELL_STATES = ("SELECTED", "SUBMITTED", "RUNNING", "COMPLETED", "FAILED", "QC_REJECTED", "CANCELLED")
TERMINAL_STATES = ("COMPLETED", "FAILED", "QC_REJECTED", "CANCELLED")
ITEM_KINDS = ("experimental", "positive", "negative", "blank", "replicate")
JOB_STATES = ("PREPARED", "QUEUED", "SUBMITTED", "RUNNING", "DONE", "FAILED", "CANCELLED")
OPEN_JOB_STATES = ("PREPARED", "QUEUED", "SUBMITTED", "RUNNING")
PHASES = (
    "AVAILABLE", "SELECTED", "SUBMITTED", "RUNNING", "LABELED", "FAILED",
    "QC_REJECTED", "RETRYABLE", "DEAD_LETTER", "CONTROL", "STOCKOUT", "BLANK",
)
BLOCKING_PHASES = (
    "SELECTED", "SUBMITTED", "RUNNING", "LABELED", "FAILED", "QC_REJECTED", "DEAD_LETTER", "CONTROL", "STOCKOUT",
)
INFLIGHT_PHASES = ("SELECTED", "SUBMITTED", "RUNNING")


def _measured() -> Column:
    done = (F.col("state") == "COMPLETED") & F.col("qc_passed") & F.col("values").isNotNull()
    return done & (F.col("pool_idx") >= 0)


def usable() -> Column:
    """A single experimental measurement that passed quality control."""
    return F.coalesce(_measured() & (F.col("kind") == "experimental"), F.lit(False))


def contributes() -> Column:
    """A measurement that enters replicate aggregation: experimental or replicate."""
    return F.coalesce(_measured() & F.col("kind").isin("experimental", "replicate"), F.lit(False))


def terminal(state: str = "state") -> Column:
    return F.col(state).isin(*TERMINAL_STATES)


def available(phase: str = "phase") -> Column:
    """Not in a blocking phase: may be selected."""
    return ~F.col(phase).isin(*BLOCKING_PHASES)


def inflight(phase: str = "phase") -> Column:
    return F.col(phase).isin(*INFLIGHT_PHASES)


def open_job(status: str = "status") -> Column:
    return F.col(status).isin(*OPEN_JOB_STATES)


def job_candidate() -> Column:
    """Items that stand for a library candidate."""
    return F.col("kind").isin("experimental", "replicate") & (F.col("pool_idx") >= 0)
