"""How good a labelled set is against the full truth: recall, enrichment, BEDROC, Pareto and budget."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pickwise.operators.acquire import RANK_LIMIT
from pickwise.operators.pareto import grouped_hypervolume, hypervolume, pareto_front
from pickwise.operators.scale import global_index, order_statistics, top_k
from pickwise.session import cut_lineage

# The two hit definitions and the early-recognition weight of the report.
TOP_FRACTIONS = (0.001, 0.01)
BEDROC_ALPHA = 20.0


def top_count(n: int, fraction: float) -> int:
    return max(1, math.ceil(float(fraction) * n))


def top_fraction(truth: DataFrame, score: str, fraction: float, n: int | None = None) -> DataFrame:
    """Hits: the top fraction by score, ties by id."""
    n = truth.count() if n is None else n
    return top_k(truth, score, top_count(n, fraction))


def hit_ranks(truth: DataFrame, score: str, fraction: float, n: int | None = None) -> DataFrame:
    """Hits with their 0-based rank; only the hits are ever sorted."""
    n = truth.count() if n is None else n
    hits = top_fraction(truth, score, fraction, n).select("pool_idx", score)
    order = [F.desc(score), F.asc("pool_idx")]
    if top_count(n, fraction) <= RANK_LIMIT:
        return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)
    return global_index(hits, order, "rank")


def ratio(part: Column, whole: Column) -> Column:
    """Division that gives zero for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def hit_recall(labelled: DataFrame, hits: DataFrame, name: str = "recall") -> DataFrame:
    """Share of the hits that are labelled."""
    found = hits.select("pool_idx").join(labelled.select("pool_idx").distinct().withColumn("_l", F.lit(1)), "pool_idx", "left")
    return found.agg(F.count(F.lit(1)).alias("n_hits"), F.count("_l").alias("n_found")).select(
        "n_hits", "n_found", ratio(F.col("n_found"), F.col("n_hits")).alias(name)
    )


def enrichment_factor(labelled: DataFrame, hits: DataFrame, n_library: int) -> DataFrame:
    """Hit rate among the labelled over the hit rate in the library; zero when either is empty."""
    ids = labelled.select("pool_idx").distinct()
    return (
        ids.withColumn("_l", F.lit(1)).join(hits.select("pool_idx").withColumn("_h", F.lit(1)), "pool_idx", "full")
        .agg(F.count("_l").alias("n_labeled"), F.count("_h").alias("n_hits"), F.count_if(F.col("_l").isNotNull() & F.col("_h").isNotNull()).alias("n_found"))
        .withColumn("ef", ratio(ratio(F.col("n_found"), F.col("n_labeled")), F.col("n_hits") / F.lit(n_library)))
    )


def ideal_weight(n_active: Column, n: Column, alpha: float) -> Column:
    """Sum of ``exp(-alpha * r / n)`` for r = 1..n_active, in closed form."""
    step = F.lit(-alpha) / n
    return F.exp(step) * F.expm1(step * n_active) / F.expm1(step)


def _clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def bedroc_of_ranks(ranks: DataFrame, n: int, rank: str = "rank", alpha: float = BEDROC_ALPHA) -> DataFrame:
    """BEDROC of recovered 0-based ranks, against the best placement of as many actives."""
    if n <= 0 or alpha <= 0:
        return ranks.agg(F.lit(0.0).alias("bedroc"))
    s = F.sum(F.exp(F.lit(-alpha) * (F.col(rank) + 1) / F.lit(float(n))))
    ideal = ideal_weight(F.count(F.lit(1)), F.lit(float(n)), alpha)
    return ranks.agg(F.when(F.count(F.lit(1)) > 0, _clip(s / ideal)).otherwise(F.lit(0.0)).alias("bedroc"))


def bedroc_against_truth(
    truth: DataFrame, labelled: DataFrame, score: str, fraction: float = 0.01, alpha: float = BEDROC_ALPHA
) -> DataFrame:
    """BEDROC of the labelled hits, against all hits found first."""
    n = truth.count()
    ranks = hit_ranks(truth, score, fraction, n)
    mine = ranks.join(labelled.select("pool_idx").distinct().withColumn("_l", F.lit(1)), "pool_idx", "left")
    weight = F.when(F.col("_l").isNotNull(), F.exp(F.lit(-alpha) * (F.col("rank") + 1) / F.lit(float(n))))
    ideal = ideal_weight(F.count(F.lit(1)), F.lit(float(n)), alpha)
    return mine.agg(_clip(F.coalesce(F.sum(weight), F.lit(0.0)) / ideal).alias("bedroc"))


def budget_to_recall(labelled_order: DataFrame, hits: DataFrame, target: float, order: str) -> DataFrame:
    """Smallest number of labels, in label order, that reaches the target share of all hits.

    The needed hit's place is an order statistic over the labelled hits, and the budget the count of
    labels up to that place; labels are never put in one sorted list. ``order`` must be unique.
    """
    spark = labelled_order.sparkSession
    n_hits = hits.count()
    if n_hits == 0 or target <= 0:
        return spark.range(1).select(F.lit(0).cast("bigint").alias("budget"))
    need = max(1, math.ceil(target * n_hits - 1e-12))
    found = labelled_order.join(hits.select("pool_idx"), "pool_idx", "left_semi")
    at = order_statistics(found, order, [need]).get(need) if found.count() >= need else None
    if at is None:
        return spark.range(1).select(F.lit(None).cast("bigint").alias("budget"))
    return labelled_order.agg(F.count_if(F.col(order).cast("double") <= F.lit(at)).alias("budget"))


def report(
    truth: DataFrame, labelled: DataFrame, objectives: Sequence[str], by: Sequence[str] = (),
    fractions: tuple[float, float] = TOP_FRACTIONS, alpha: float = BEDROC_ALPHA,
) -> DataFrame:
    """The benchmark report, one row per group of labelled candidates.

    The truth side (hits, ranks, front, reference point) is worked out once for all groups. Pareto
    figures are NULL with a single objective.
    """
    first = objectives[0]
    by = list(by)
    ends = [f(o) for o in objectives for f in (F.min, F.max)]
    n, *lo_hi = truth.agg(F.count(F.lit(1)), *ends).first()
    top1 = hit_ranks(truth, first, fractions[1], n).select("pool_idx", F.col("rank").alias("_rank"))
    k01, k1 = top_count(n, fractions[0]), top_count(n, fractions[1])
    mine = labelled.select(*by, "pool_idx").distinct().join(truth.select("pool_idx", *objectives), "pool_idx")
    marked = mine.join(top1, "pool_idx", "left")
    several = len(objectives) > 1
    if several:
        # the front is wanted three times: as a flag, as a count and for its volume
        front = cut_lineage(pareto_front(truth, objectives).select("pool_idx", *objectives))
        n_front = front.count()
        marked = marked.join(front.select("pool_idx", F.lit(1).alias("_front")), "pool_idx", "left")
    hit = F.col("_rank").isNotNull()
    found = F.count_if(hit)
    weight = F.sum(F.when(hit, F.exp(F.lit(-alpha) * (F.col("_rank") + 1) / F.lit(float(n)))))
    rows = marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_labeled"),
        F.coalesce(F.avg(first), F.lit(0.0)).alias("mean_activity"),
        (F.count_if(F.col("_rank") < k01) / F.lit(k01)).alias("top01_recall"),
        (found / F.lit(k1)).alias("top1_recall"),
        ratio(ratio(found, F.count(F.lit(1))), F.lit(k1 / n)).alias("ef_top1"),
        _clip(F.coalesce(weight, F.lit(0.0)) / ideal_weight(F.lit(k1), F.lit(float(n)), alpha)).alias("bedroc"),
        found.alias("n_hits_top1"),
        *([(F.count("_front") / F.lit(max(1, n_front))).alias("pareto_recall")] if several else []),
    )
    if not several:
        null = F.lit(None).cast("double")
        return rows.withColumn("hv_frac", null).withColumn("pareto_recall", null)
    ref = [lo_hi[2 * i] - 0.05 * (lo_hi[2 * i + 1] - lo_hi[2 * i]) for i in range(len(objectives))]
    whole = hypervolume(front, objectives, ref).first()[0]
    if by:
        parts = grouped_hypervolume(mine, by, objectives, ref).withColumnRenamed("hypervolume", "_hv")
        rows = rows.join(parts, by, "left")
    else:
        rows = rows.withColumn("_hv", hypervolume(mine, objectives, ref).scalar())
    share = ratio(F.coalesce("_hv", F.lit(0.0)), F.lit(whole))
    return rows.withColumn("hv_frac", share).withColumn("global_hv", F.lit(whole)).drop("_hv")


def run_summary(rows: DataFrame, wall_s: float, history_len: int, **labels) -> DataFrame:
    """A run's report row with its wall time, number of rounds and identifying labels."""
    extra = {k: F.lit(v) for k, v in labels.items()}
    return rows.withColumns({"wall_clock_s": F.lit(round(wall_s, 3)), "history_len": F.lit(history_len), **extra})


def round_history(labels: DataFrame, items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per campaign and round: submitted and outcome counts, and labels gained so far.

    ``labels(campaign_id, round, pool_idx)`` holds every labelling; a candidate counts from its first
    round on. The running sum goes over rounds, after the candidates have been counted.
    """
    first = labels.groupBy("campaign_id", "pool_idx").agg(F.min("round").alias("round"))
    gained = first.groupBy("campaign_id", "round").agg(F.count(F.lit(1)).alias("gained"))
    submitted = items.groupBy("campaign_id", "round").agg(F.count(F.lit(1)).alias("submitted"))
    done = outcomes.groupBy("campaign_id", "round").agg(
        *[F.sum(c).alias(c) for c in ("completed", "failed", "qc_rejected")]
    )
    keys = ["campaign_id", "round"]
    w = Window.partitionBy("campaign_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    table = submitted.join(done, keys, "left").join(gained, keys, "left").fillna(0)
    return table.withColumn("n_labeled", F.sum("gained").over(w)).drop("gained")


def seed_summary(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and population spread over seeds per strategy and round."""
    cols = [f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return runs.groupBy("strategy", "round").agg(F.count(F.lit(1)).alias("n_seeds"), *cols)


def speedup(runs: DataFrame, keys: Sequence[str], baseline: str = "serial") -> DataFrame:
    """Every run's wall time against the baseline run of the same keys."""
    base = runs.filter(F.col("mode") == baseline).groupBy(*keys).agg(F.max("wall").alias("_base"))
    return runs.join(base, list(keys)).withColumn("speedup", F.col("_base") / F.nullif(F.col("wall"), F.lit(0.0))).drop("_base")


def value_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value per column, one row per column."""
    agg = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"{c}_lo").alias("lo"), F.col(f"{c}_hi").alias("hi")) for c in columns])
    return agg.select(F.explode(rows).alias("r")).select("r.*")
