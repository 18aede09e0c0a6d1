"""Observation events to training labels: de-duplication, replicate aggregation, quality control."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pickwise.functions.states import contributes
from pickwise.session import cut_lineage

MEDIAN_BINS = 256  # a power of two
MEDIAN_SALTS = 16
MEDIAN_VALUES = 4_096  # different values of a key that are ranked in one group
ROUNDING = 1e-12
PIECE_BYTES = 16 << 20  # of events, by the optimizer's estimate, that one task sorts to find first ones
MAX_PIECES = 4_000  # an estimate can be far too high


def event_key() -> Column:
    """Item id, or candidate:state:kind for events that carry none."""
    fallback = F.concat_ws(":", F.col("pool_idx").cast("string"), "state", "kind")
    return F.coalesce(F.nullif(F.col("item_id"), F.lit("")), fallback)


def dedupe(obs: DataFrame, order: Sequence[str]) -> DataFrame:
    """First event per key. The rank filter is applied per input partition before the shuffle.

    A larger table is dealt into pieces first, by key and input partition, so that no task sorts more than about ``PIECE_BYTES`` of it,
    before and after; a key of very many events is still cut down where it lies.
    """
    w = Window.partitionBy("_key").orderBy(*order)
    rows = obs.withColumn("_key", event_key())
    pieces = min(-(-obs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() // PIECE_BYTES), MAX_PIECES)
    if pieces > obs.sparkSession.sparkContext.defaultParallelism:
        own = Window.partitionBy("_key", "_part").orderBy(*order)
        rows = rows.withColumn("_part", F.spark_partition_id()).repartition(pieces, "_key", "_part")
        rows = rows.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") == 1).drop("_part", "_n").repartition(pieces, "_key")
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_key", "_n")


def contributing(obs: DataFrame) -> DataFrame:
    return obs.filter(contributes())


def _value_columns(n_objectives: int) -> list[Column]:
    return [F.get("values", F.lit(i)).alias(f"v{i}") for i in range(n_objectives)]


def replicate_stats(
    obs: DataFrame,
    n_objectives: int,
    order: Sequence[str],
    method: str = "mean",
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per measured candidate: aggregate and population spread per objective, count, latest
    time, and the attributes of its first event.

    Every aggregate has fixed-size state and combines before the shuffle, so a candidate with a very
    large number of replicates costs no more than one row per input partition.
    """
    if method not in ("mean", "median"):
        raise ValueError(f"unknown aggregate method: {method}")
    keys = [*by, "pool_idx"]
    events = contributing(obs)
    flat = events.select(*keys, *_value_columns(n_objectives), "ts", "smiles", "compound_id", *_extra(order, keys))
    first = F.min_by(F.struct("smiles", "compound_id"), F.struct(*order))
    spread = [F.stddev_pop(f"v{i}").alias(f"std{i}") for i in range(n_objectives)]
    means = [F.avg(f"v{i}").alias(f"agg{i}") for i in range(n_objectives)] if method == "mean" else []
    stats = flat.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *means, *spread, F.max("ts").alias("ts"), first.alias("_first")
    )
    for i in range(n_objectives if method == "median" else 0):
        # a candidate without a value for this objective has no median, but keeps its row
        stats = stats.join(grouped_median(flat, keys, f"v{i}", f"agg{i}"), keys, "left")
    return stats.select(
        *keys, "n", *[f"agg{i}" for i in range(n_objectives)], *[f"std{i}" for i in range(n_objectives)],
        "ts", "_first.smiles", "_first.compound_id",
        F.concat(F.lit("agg:"), F.col("pool_idx").cast("string"), F.lit(":n"), F.col("n").cast("string")).alias("item_id"),
    )


def _extra(order: Sequence[str], keys: Sequence[str]) -> list[str]:
    return [c for c in order if c not in ("ts", "smiles", "compound_id", *keys)]


def _bin(value: Column, splits: Column) -> Column:
    """How many of the ``MEDIAN_BINS`` - 1 ascending ``splits`` lie below the value, by halving."""
    steps = F.array(*[F.lit(MEDIAN_BINS >> i) for i in range(1, MEDIAN_BINS.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(value > F.get(splits, at + step - 1), at + step).otherwise(at))


def _salt() -> Column:
    return F.pmod(F.hash("_v"), F.lit(MEDIAN_SALTS))


def _salted(few: DataFrame) -> DataFrame:
    """One row for each salt; for wide keys alone, of which there are fewer than values by ``MEDIAN_VALUES``."""
    return few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(MEDIAN_SALTS - 1))))


def _middle_bins(counts: DataFrame, open_keys: DataFrame, keys: list[str]) -> DataFrame:
    """The part of each open key's values that still holds both middle ranks, or the two values themselves (``_a``, ``_b``).

    Splits come from an approximate quantile sketch of the different values, so outliers and uneven values cost nothing; what they
    hold is then counted exactly. At most ``MEDIAN_BINS`` rows a key come together. Rows are salted, so a hot key is many tasks' work.
    """
    inside = (
        counts.withColumn("_salt", _salt()).join(_salted(open_keys), [*keys, "_salt"])
        .filter(F.col("_v").between(F.col("_lo"), F.col("_hi"))).select(*keys, "_salt", "_v", "_c", "_n", "_before")
    )
    shares = F.array(*[F.lit(i / MEDIAN_BINS) for i in range(1, MEDIAN_BINS)])
    splits = inside.groupBy(*keys).agg(F.percentile_approx("_v", shares, 10 * MEDIAN_BINS).alias("_splits"))
    bins = (
        inside.join(_salted(splits), [*keys, "_salt"]).groupBy(*keys, _bin(F.col("_v"), F.col("_splits")).alias("_bin"))
        .agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
             F.first("_n").alias("_n"), F.first("_before").alias("_before"))
    )
    running = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    placed = bins.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_c").over(running), F.lit(0)))

    def holds(rank: Column) -> Column:
        return (F.col("_before") < rank) & (F.col("_before") + F.col("_c") >= rank)

    part = F.struct("_lo", "_hi", "_d", "_before")
    found = placed.groupBy(*keys, "_n").agg(F.max(F.when(holds(low), part)).alias("_l"), F.max(F.when(holds(high), part)).alias("_h"))
    # middle ranks in two bins are the last value of one and the first of the next
    apart = (F.col("_l._before") != F.col("_h._before")) | (F.col("_l._lo") == F.col("_l._hi"))
    return found.select(
        *keys, "_n", "_l._lo", "_l._hi", "_l._d", "_l._before", F.when(apart, F.col("_l._hi")).alias("_a"), F.when(apart, F.col("_h._lo")).alias("_b"),
    )


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, name: str, limit: int = MEDIAN_VALUES) -> DataFrame:
    """Exact median per key, also when one key holds most rows; NULL values and keys are left out, NaN is the largest value.

    Equal values are counted together first. Keys of at most ``limit`` different values are ranked at once. The part of a wider key
    that holds its middle is narrowed pass by pass, only keys still wider going on; a pass leaves about 1 in ``MEDIAN_BINS`` values.
    """
    keys = list(keys)
    given = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*keys, value)])
    counts = cut_lineage(
        df.filter(given).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    )
    spans = counts.groupBy(*keys).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_d"), F.sum("_c").alias("_n"), F.lit(0).cast("long").alias("_before")
    )
    wide = F.col("_d") > limit
    bracket = [*keys, "_lo", "_hi", "_n", "_before"]
    inside, done = counts.withColumns({"_n": F.lit(None).cast("long"), "_before": F.lit(None).cast("long")}), []
    if (spans.agg(F.max("_d")).first()[0] or 0) > limit:
        open_keys, narrowed = cut_lineage(spans.filter(wide).select(*bracket)), []
        while not open_keys.isEmpty():
            passed = cut_lineage(_middle_bins(counts, open_keys, keys))
            narrowed.append(passed.filter(F.col("_a").isNotNull() | ~wide))
            open_keys = passed.filter(F.col("_a").isNull() & wide).select(*bracket)
        few = reduce(DataFrame.unionByName, narrowed)  # once each wide key
        done = [few.filter(F.col("_a").isNotNull()).select(*keys, ((F.col("_a") + F.col("_b")) / 2).alias(name))]
        kept = F.col("_n").isNull() | (F.col("_a").isNull() & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        salted = _salted(few.select(*bracket, "_a"))
        inside = counts.withColumn("_salt", _salt()).join(salted, [*keys, "_salt"], "left").filter(kept).select(*keys, "_v", "_c", "_n", "_before")
    within = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("_all")
    low, high = F.floor((n + 1) / 2), F.floor(n / 2) + 1
    ranked = (
        inside.withColumn("_all", F.coalesce("_n", F.sum("_c").over(Window.partitionBy(*keys))))
        .withColumn("_upto", F.coalesce("_before", F.lit(0)) + F.sum("_c").over(within))
    )
    hits = ranked.filter((F.col("_upto") >= low) & (F.col("_upto") - F.col("_c") < high))
    return reduce(DataFrame.unionByName, done, hits.groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / 2).alias(name)))


def qc_rejected(max_std: float | None, min_replicates: int = 2) -> Column:
    """Replicates that disagree too much on the first objective; ``None`` switches the check off.

    A spread that equals the limit up to rounding is accepted: its last digits depend on the order
    in which partial results are merged, and the verdict must not.
    """
    if max_std is None:
        return F.lit(False)
    return (F.col("n") >= min_replicates) & (F.col("std0") > F.lit(float(max_std) * (1 + ROUNDING)))


def split_labels(stats: DataFrame, max_std: float | None = 1.0, min_replicates: int = 2) -> tuple[DataFrame, DataFrame]:
    """(labels, rejected) from replicate statistics."""
    bad = qc_rejected(max_std, min_replicates)
    return stats.filter(~bad), stats.filter(bad)


def labels_from(
    obs: DataFrame,
    n_objectives: int,
    order: Sequence[str],
    method: str = "mean",
    max_std: float | None = 1.0,
    min_replicates: int = 2,
    by: Sequence[str] = (),
) -> DataFrame:
    """Training labels from a raw event log: dedupe, aggregate, reject."""
    stats = replicate_stats(dedupe(obs, order), n_objectives, order, method, by)
    return split_labels(stats, max_std, min_replicates)[0]


def label_items(obs: DataFrame, stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Which items fed which aggregate, one row per item: a candidate may have any number of them."""
    keys = [*by, "pool_idx"]
    agg = stats.select(*keys, F.col("item_id").alias("label_id"))
    return contributing(obs).select(*keys, "item_id").join(agg, keys)


def newly_labelled(before: DataFrame, after: DataFrame) -> DataFrame:
    """Candidates labelled now and not before."""
    return after.join(before.select("pool_idx"), "pool_idx", "left_anti")


def training_matrix(obs_labels: DataFrame, candidates: DataFrame, n_objectives: int, features: str) -> DataFrame:
    """Labels with their candidates' features; a label of the wrong width stops the job."""
    width_ok = F.size("values") == n_objectives
    problem = F.concat(
        F.lit("observation at "), F.col("pool_idx").cast("string"), F.lit(" has "), F.size("values").cast("string"),
        F.lit(f" values; expected {n_objectives}"),
    )
    checked = obs_labels.withColumn("values", F.when(width_ok, F.col("values")).otherwise(F.raise_error(problem)))
    return checked.join(candidates.select("pool_idx", features), "pool_idx")


def labelled_mask(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """Every candidate with a flag: has a label."""
    marks = labels.select("pool_idx").distinct().withColumn("_has", F.lit(True))
    return candidates.join(marks, "pool_idx", "left").withColumn("labelled", F.coalesce("_has", F.lit(False))).drop("_has")


def outcome_counts(items: DataFrame | None, obs: DataFrame) -> DataFrame:
    """Per job: contributing, failed and rejected results among the job's own items.

    Without ``items`` the observations name their job themselves, and no join is needed.
    """
    if items is None:
        per = obs.select("job_id", contributes().alias("_ok"), "state")
    else:
        results = obs.select("item_id", contributes().alias("_ok"), "state")
        per = items.select("job_id", "item_id").distinct().join(results, "item_id")
    return per.groupBy("job_id").agg(
        F.count_if(F.col("_ok")).alias("completed"),
        F.count_if(F.col("state") == "FAILED").alias("failed"),
        F.count_if(F.col("state") == "QC_REJECTED").alias("qc_rejected"),
    )
