"""Candidate lifecycle from event logs.

``observation_phases`` covers result events alone: the rules then depend only on counts and on the
last time of each event class, so it is one grouped aggregate, in batch and in streaming alike.

``fold_events`` covers result events mixed with the engine's own marks (selected, submitted,
released, labelled ...), where order and job ownership matter. Every event is a function on the small
set of phases. The log is numbered in (candidate, order) and cut into blocks of bounded length, so
one candidate's log may span any number of them. A block is composed into the images of all phases by
a Catalyst aggregate; the images of a split candidate are composed again, a bounded number at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pickwise.functions.states import INFLIGHT_PHASES, PHASES, contributes
from pickwise.operators.scale import global_index
from pickwise.session import cut_lineage

# Event operations. OBS_* come from results, the others are marks.
MARKS = ("CONTROL", "STOCKOUT", "SELECTED", "SUBMITTED", "RUNNING", "LABELED", "RELEASE", "RESTORE")
BLOCK_EVENTS = 1_000  # events that are composed at once
CHAIN_BLOCKS = 64  # composed blocks that are composed with each other at once
_ENTRY = "\x00entry"  # whichever job held the candidate when the block began
_ANY = "\x00any"  # an image that does not depend on how the block began


# ---- result events only -------------------------------------------------------------------------

def _class(kind: str | tuple[str, ...], *states: str) -> Column:
    kinds = (kind,) if isinstance(kind, str) else kind
    cond = F.col("kind").isin(*kinds)
    return cond & F.col("state").isin(*states) if states else cond


def phase_aggregates(order: Column) -> list[Column]:
    """Fixed-size partial aggregates that decide the phase. A BIGINT ``order`` keeps them hash-based."""

    def last(cond: Column, name: str) -> Column:
        return F.max(F.when(cond, order)).alias(name)

    failed, rejected = _class("experimental", "FAILED"), _class("experimental", "QC_REJECTED")
    return [
        last(_class(("positive", "negative")), "t_control"),
        last(_class("experimental", "CANCELLED"), "t_cancelled"),
        last(failed, "t_failed"),
        last(rejected, "t_rejected"),
        last(contributes() & (F.col("kind") == "experimental"), "t_measured"),
        last(_class("experimental", "RUNNING"), "t_running"),
        last(_class("experimental", "SUBMITTED"), "t_submitted"),
        last(_class("replicate", "RUNNING"), "t_replicate"),
        F.count_if(failed).cast("int").alias("fail_retries"),
        F.count_if(rejected).cast("int").alias("qc_retries"),
    ]


def phase_of(max_fail_retries: int = 1, max_qc_retries: int = 1) -> Column:
    """Phase from ``phase_aggregates``: the last event that sets a phase decides, then the two rules
    that depend on the phase they meet (a measurement, and a running replicate)."""
    setter = F.greatest("t_control", "t_cancelled", "t_failed", "t_rejected", "t_running", "t_submitted")

    def is_last(name: str) -> Column:
        return F.coalesce(F.col(name) == setter, F.lit(False))

    measured_after = F.col("t_measured").isNotNull() & (setter.isNull() | (F.col("t_measured") > setter))
    replicate_after = F.coalesce(F.col("t_replicate") > F.col("t_submitted"), F.lit(False))
    return (
        F.when(is_last("t_control"), F.lit("CONTROL"))
        .when(measured_after, F.lit("RUNNING"))
        .when(is_last("t_cancelled"), F.lit("AVAILABLE"))
        .when(is_last("t_failed"), F.when(F.col("fail_retries") <= max_fail_retries, F.lit("RETRYABLE")).otherwise(F.lit("FAILED")))
        .when(is_last("t_rejected"), F.when(F.col("qc_retries") <= max_qc_retries, F.lit("RETRYABLE")).otherwise(F.lit("QC_REJECTED")))
        .when(is_last("t_running"), F.lit("RUNNING"))
        .when(is_last("t_submitted"), F.when(replicate_after, F.lit("RUNNING")).otherwise(F.lit("SUBMITTED")))
        .otherwise(F.lit("AVAILABLE"))
    )


def observation_phases(
    obs: DataFrame, order: str, max_fail_retries: int = 1, max_qc_retries: int = 1, by: Sequence[str] = ()
) -> DataFrame:
    """Phase and retry counters per candidate from result events. Works on a stream in update mode."""
    keys = [*by, "pool_idx"]
    known = obs.filter(F.col("pool_idx") >= 0)
    return (
        known.groupBy(*keys).agg(*phase_aggregates(F.col(order)))
        .select(*keys, phase_of(max_fail_retries, max_qc_retries).alias("phase"), "fail_retries", "qc_retries")
    )


def sync_labels(state: DataFrame, labels: DataFrame, rejected: DataFrame, max_qc_retries: int = 1) -> DataFrame:
    """Align phases with the aggregated labels.

    A label always wins. A candidate whose replicates disagree is counted once per rejected
    aggregate and becomes retryable or finally rejected, unless its phase already settles it.
    """
    # a label may come without a state row, such as one imported
    unseen = labels.select("pool_idx").distinct().join(state.select("pool_idx"), "pool_idx", "left_anti")
    state = state.unionByName(
        unseen.withColumns({"phase": F.lit("AVAILABLE"), "fail_retries": F.lit(0), "qc_retries": F.lit(0)}), allowMissingColumns=True
    )
    settled = F.col("phase").isin("LABELED", "QC_REJECTED", "DEAD_LETTER", "RETRYABLE", "FAILED", "CONTROL")
    marked = (
        state.join(labels.select("pool_idx", F.lit(True).alias("_label")), "pool_idx", "left")
        .join(rejected.select("pool_idx", F.lit(True).alias("_bad")), "pool_idx", "left")
    )
    counts = F.col("_label").isNull() & F.col("_bad").isNotNull() & ~settled
    qc = F.col("qc_retries") + F.when(counts, F.lit(1)).otherwise(F.lit(0))
    phase = (
        F.when(F.col("_label").isNotNull(), F.lit("LABELED"))
        .when(counts, F.when(qc <= max_qc_retries, F.lit("RETRYABLE")).otherwise(F.lit("QC_REJECTED")))
        .otherwise(F.col("phase"))
    )
    out = {"qc_retries": qc.cast("int"), "phase": phase}
    if "job_id" in state.columns:  # a candidate that may be tried again belongs to no job
        out["job_id"] = F.when(counts & (qc <= max_qc_retries), F.lit(None)).otherwise(F.col("job_id"))
    return marked.withColumns(out).drop("_label", "_bad")


# ---- results mixed with marks -------------------------------------------------------------------

def event_op() -> Column:
    """Operation of a result event, NULL where it never changes the lifecycle."""
    exp = F.col("kind") == "experimental"
    return (
        F.when(F.col("kind").isin("positive", "negative"), F.lit("CONTROL"))
        .when((F.col("kind") == "replicate") & (F.col("state") == "RUNNING"), F.lit("RUNNING"))
        .when(exp & F.col("state").isin("CANCELLED", "FAILED", "QC_REJECTED"), F.concat(F.lit("OBS_"), F.col("state")))
        .when(exp & contributes(), F.lit("OBS_MEASURED"))
        .when(exp & F.col("state").isin("RUNNING", "SUBMITTED"), F.concat(F.lit("OBS_"), F.col("state")))
    )


def _image(p: Column, h: Column, phase: Column, job: Column) -> Column:
    """Entered in phase ``p`` and held by job ``h``, a candidate leaves in ``phase`` and held by ``job``."""
    return F.struct(p.alias("p"), h.alias("h"), phase.alias("phase"), job.alias("job"))


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def _known(phase: Column, job: Column) -> Column:
    return F.array(_image(_text(_ANY), _text(_ANY), phase, job))


def _start() -> Column:
    return _known(_text("AVAILABLE"), _text(None))


def _every_start() -> Column:
    return F.array(*[_image(_text(p), _text(h), _text(p), _text(h)) for p in PHASES for h in (None, _ENTRY)])


def _labelled_after(op: Column, ev: Column, labelled: Column) -> Column:
    """Only these four events begin or end the phase LABELED, whatever the phase was before."""
    return (
        F.when(op == "LABELED", F.lit(True))
        .when(op.isin("SUBMITTED", "CONTROL"), F.lit(False))
        .when(op == "RESTORE", F.coalesce(ev["phase"] == "LABELED", F.lit(False)))
        .otherwise(labelled)
    )


def _added(ev: Column, labelled: Column, op: str, restored: str) -> Column:
    """What an event adds to a retry counter; results of a labelled candidate do not count."""
    return (
        F.when((ev["op"] == op) & ~labelled, F.lit(1))
        .when(ev["op"] == "RESTORE", F.coalesce(ev[restored], F.lit(0)))
        .otherwise(F.lit(0))
    )


def _counters(acc: Column, ev: Column) -> list[Column]:
    return [
        _labelled_after(ev["op"], ev, acc["labelled"]).alias("labelled"),
        (acc["fails"] + _added(ev, acc["labelled"], "OBS_FAILED", "fail_retries")).alias("fails"),
        (acc["rejects"] + _added(ev, acc["labelled"], "OBS_QC_REJECTED", "qc_retries")).alias("rejects"),
    ]


def _count_block(events: str, labelled: bool) -> Column:
    """Counters of a block that begins labelled or not."""
    zero = F.struct(F.lit(labelled).alias("labelled"), F.lit(0).alias("fails"), F.lit(0).alias("rejects"))
    return F.aggregate(events, zero, lambda acc, ev: F.struct(*_counters(acc, ev)))


def _apply(images: Column, ev: Column, labelled: Column, fails: Column, rejects: Column, max_fail: int, max_qc: int) -> Column:
    """Images after one more event; ``fails`` and ``rejects`` already count it."""
    op, job = ev["op"], ev["job_id"]
    result = op.startswith("OBS_")
    spent = ((op == "OBS_FAILED") & (fails > max_fail)) | ((op == "OBS_QC_REJECTED") & (rejects > max_qc))
    frees = op.isin("OBS_CANCELLED", "OBS_FAILED", "OBS_QC_REJECTED") & ~labelled & ~spent
    # the phase that an event sets whatever it meets
    sets = (
        F.when(op.isin("CONTROL", "LABELED", "SUBMITTED"), op)
        .when(op == "RESTORE", ev["phase"])
        .when(result & labelled, _text(None))
        .when(spent | op.isin("OBS_RUNNING", "OBS_SUBMITTED"), F.substring(op, 5, 100))
        .when(op == "OBS_CANCELLED", _text("AVAILABLE"))
        .when(op.isin("OBS_FAILED", "OBS_QC_REJECTED"), _text("RETRYABLE"))
    )

    def one(img: Column) -> Column:
        phase, held = img["phase"], img["job"]
        inflight = phase.isin(*INFLIGHT_PHASES)
        picks = (op == "SELECTED") & phase.isin("AVAILABLE", "RETRYABLE")
        released = (op == "RELEASE") & inflight & (job.isNull() | held.isNull() | (held == job))
        after = (
            F.when(sets.isNotNull(), sets)
            .when((op == "OBS_MEASURED") & ~labelled & (phase != "CONTROL"), _text("RUNNING"))
            .when((op == "STOCKOUT") & (phase == "AVAILABLE"), op)
            .when(picks, op)
            .when((op == "RUNNING") & phase.isin("SELECTED", "SUBMITTED"), op)
            .when(released, _text("AVAILABLE"))
            .otherwise(phase)
        )
        holder = F.when(picks, F.coalesce(F.nullif(job, F.lit("")), held)).when(~released, held)
        following = F.array(_image(img["p"], img["h"], after, holder))
        # a release by a job that may be the unknown holder: that holder gets an image of its own
        named = F.exists(images, lambda x: (x["p"] == img["p"]) & x["h"].eqNullSafe(job))
        may_own = (op == "RELEASE") & inflight & job.isNotNull() & held.eqNullSafe(F.lit(_ENTRY)) & ~named
        own = F.array(_image(img["p"], job, _text("AVAILABLE"), _text(None)))
        return F.when(may_own, F.concat(following, own)).otherwise(following)

    settled = op.isin("SUBMITTED", "RESTORE") | frees
    return F.when(settled, _known(sets, F.when(~frees, job))).otherwise(F.flatten(F.transform(images, one)))


def _fold_block(events: str, images: Column, labelled: Column, fails: Column, rejects: Column, max_fail: int, max_qc: int) -> Column:
    """A block's events composed onto ``images``: struct(labelled, fails, rejects, images)."""
    zero = F.struct(labelled.alias("labelled"), fails.alias("fails"), rejects.alias("rejects"), images.alias("images"))

    def step(acc: Column, ev: Column) -> Column:
        now, f, q = _counters(acc, ev)
        return F.struct(now, f, q, _apply(acc["images"], ev, acc["labelled"], f, q, max_fail, max_qc).alias("images"))

    return F.aggregate(events, zero, step)


def _compose(first: Column, then: Column) -> Column:
    """Images of two neighbouring blocks as those of one."""

    def image_of(phase: Column, job: Column) -> Column:
        own = F.filter(then, lambda u: (u["p"] == _ANY) | ((u["p"] == phase) & u["h"].eqNullSafe(job)))
        open_ = F.filter(then, lambda u: (u["p"] == phase) & u["h"].eqNullSafe(F.lit(_ENTRY)))
        return F.coalesce(F.get(own, F.lit(0)), F.get(open_, F.lit(0)))

    def one(img: Column) -> Column:
        to = image_of(img["phase"], img["job"])
        holder = F.when(to["job"].eqNullSafe(F.lit(_ENTRY)), img["job"]).otherwise(to["job"])
        following = F.array(_image(img["p"], img["h"], to["phase"], holder))
        # holders the later block tells apart, unless the earlier one already does
        names = F.filter(
            then, lambda u: (u["p"] == img["phase"]) & u["h"].isNotNull() & (u["h"] != _ENTRY)
            & ~F.exists(first, lambda x: (x["p"] == img["p"]) & x["h"].eqNullSafe(u["h"])),
        )
        own = F.transform(names, lambda u: _image(img["p"], u["h"], u["phase"], u["job"]))
        return F.when(img["job"].eqNullSafe(F.lit(_ENTRY)), F.concat(following, own)).otherwise(following)

    return F.flatten(F.transform(first, one))


def _chain(blocks: DataFrame, fan: int) -> DataFrame:
    """``blocks(pool_idx, block, images)`` composed in block order until one row is left per candidate."""
    while True:
        most = blocks.groupBy("pool_idx").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        key = F.expr(f"block div {fan}") if most > fan else F.lit(0).cast("long")
        grouped = blocks.groupBy("pool_idx", key.alias("block")).agg(F.array_sort(F.collect_list(F.struct("block", "images"))).alias("_b"))
        rest = F.slice("_b", F.lit(2), F.size("_b"))
        images = F.aggregate(rest, F.col("_b")[0]["images"], lambda acc, b: _compose(acc, b["images"]))
        composed = grouped.select("pool_idx", "block", images.alias("images"))
        if most <= fan:
            return composed
        blocks = cut_lineage(composed)


def fold_events(
    events: DataFrame, order: str, max_fail_retries: int = 1, max_qc_retries: int = 1, prior: DataFrame | None = None,
    block: int = BLOCK_EVENTS, fan: int = CHAIN_BLOCKS,
) -> DataFrame:
    """Candidate state after ``events(pool_idx, <order>, op, job_id)`` in order, on top of ``prior``.

    Rows without a candidate (NULL or negative id) or operation change nothing; equal places in the order are taken by operation and
    job. ``block`` and ``fan`` bound what one group holds and never change a result. Per candidate only one short row for each
    ``block`` of its events comes together, to carry the counters.
    """
    limits = (max_fail_retries, max_qc_retries)
    log = events.filter((F.col("pool_idx") >= 0) & F.col("op").isNotNull()).select(
        "pool_idx", F.col(order).alias("_order"), "op", "job_id",
        F.lit(None).cast("string").alias("phase"),
        F.lit(None).cast("int").alias("fail_retries"), F.lit(None).cast("int").alias("qc_retries"),
    ).withColumn("_rank", F.lit(1))
    if prior is not None:
        start = prior.select(
            "pool_idx", F.lit(None).cast(log.schema["_order"].dataType).alias("_order"), F.lit("RESTORE").alias("op"),
            "job_id", "phase", "fail_retries", "qc_retries", F.lit(0).alias("_rank"),
        )
        log = log.unionByName(start)
    event = F.struct("pos", "op", "job_id", "phase", "fail_retries", "qc_retries")
    groups = (
        global_index(log, ["pool_idx", "_rank", "_order", "op", "job_id"])
        .groupBy("pool_idx", F.expr(f"pos div {block}").alias("block"))
        .agg(F.array_sort(F.collect_list(event)).alias("events"))
    )
    # only the first and the last candidate of a block can go on in another one
    edge = (F.col("events")[0]["pos"] % block == 0) | (F.element_at("events", -1)["pos"] % block == block - 1)
    alone = _fold_block("events", _start(), F.lit(False), F.lit(0), F.lit(0), *limits)
    parts = cut_lineage(groups.select("pool_idx", "block", F.when(edge, F.col("events")).alias("events"), F.when(~edge, alone).alias("state")))
    done = parts.filter(F.col("state").isNotNull()).select(
        "pool_idx", F.col("state.images")[0]["phase"].alias("phase"), F.col("state.images")[0]["job"].alias("job_id"),
        F.col("state.fails").alias("fail_retries"), F.col("state.rejects").alias("qc_retries"),
    )

    split = parts.filter(F.col("events").isNotNull()).select("pool_idx", "block", "events")
    before = Window.partitionBy("pool_idx").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("_no.labelled") == F.col("_yes.labelled"), F.col("_no.labelled"))
    carried = (
        split.select("pool_idx", "block", _count_block("events", False).alias("_no"), _count_block("events", True).alias("_yes"))
        .withColumn("_first", F.count(F.lit(1)).over(before) == 0)
        .withColumn("_labelled", F.coalesce(F.last(known, ignorenulls=True).over(before), F.lit(False)))
        .withColumn("_here", F.when(F.col("_labelled"), F.col("_yes")).otherwise(F.col("_no")))
        .select(
            "pool_idx", "block", "_first", "_labelled",
            *[F.coalesce(F.sum(f"_here.{c}").over(before), F.lit(0)).cast("int").alias(f"_{c}") for c in ("fails", "rejects")],
        )
    )
    begin = F.when(F.col("_first"), _start()).otherwise(_every_start())
    folded = cut_lineage(
        split.join(carried, ["pool_idx", "block"])
        .withColumn("_s", _fold_block("events", begin, F.col("_labelled"), F.col("_fails"), F.col("_rejects"), *limits))
        .select("pool_idx", "block", "_s.fails", "_s.rejects", "_s.images")
    )
    # nothing before the last block that settles the state matters; a candidate's first block always does
    settles = F.col("images")[0]["p"] == _ANY
    ends = folded.groupBy("pool_idx").agg(
        F.max(F.when(settles, F.col("block"))).alias("_from"),
        F.max_by("fails", "block").alias("fail_retries"), F.max_by("rejects", "block").alias("qc_retries"),
    )
    tail = folded.join(ends.select("pool_idx", "_from"), "pool_idx").filter(F.col("block") >= F.col("_from"))
    chained = _chain(tail.select("pool_idx", "block", "images"), fan)
    last = F.col("images")[0]
    return done.unionByName(
        chained.join(ends, "pool_idx").select("pool_idx", last["phase"].alias("phase"), last["job"].alias("job_id"), "fail_retries", "qc_retries")
    )
