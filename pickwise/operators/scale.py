"""Building blocks that stay exact when one group, score or key holds a large share of all rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from pickwise.session import cut_lineage

BINS = 2048
TOP_LIMIT = 100_000
SMALL_COLUMN = 1_000_000
BLOCK_ROWS = 50_000
SPREAD_BYTES = 128 << 20
WINDOW_LIMIT = 1000  # Spark's own default for limiting a window's groups before the shuffle
_LOCAL_BITS = 33


def use_all_cores(df: DataFrame) -> DataFrame:
    """Spread a small input, such as one file with one row group, over all cores.

    Only an input of at most ``SPREAD_BYTES`` by the optimizer's estimate is shuffled; rows and results never change.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if size > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _numbers(df: DataFrame, col: Column) -> DataFrame:
    """The values of a numeric column as ``v``: whole numbers stay whole, all others become DOUBLE. NULL and NaN are left out."""
    v = df.select(col.alias("v"))
    if isinstance(v.schema["v"].dataType, IntegralType):
        return v.select(F.col("v").cast("long").alias("v")).filter(F.col("v").isNotNull())
    return v.select(F.col("v").cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))


def order_statistics(df: DataFrame, value: str | Column, ranks: Sequence[int]) -> dict[int, float]:
    """Exact ``rank``-th smallest values (1-based), nulls and NaN left out; ranks beyond the number of values are missing.

    Infinities are counted apart. Each pass then aggregates at most ``BINS`` bins of the finite bracket that holds the rank, so the
    driver only ever sees bin counts. Bins are monotone in the value and a pass always splits its bracket. Whole numbers are binned by
    whole steps, so no digit of a BIGINT is lost.
    """
    v = _numbers(df, F.col(value) if isinstance(value, str) else value)
    whole = isinstance(v.schema["v"].dataType, IntegralType)
    finite = F.lit(True) if whole else F.abs("v") < float("inf")
    ends = v.agg(
        F.min(F.when(finite, F.col("v"))).alias("lo"), F.max(F.when(finite, F.col("v"))).alias("hi"),
        F.count(F.when(finite, 1)).alias("n"), F.count(F.when(~finite & (F.col("v") < 0), 1)).alias("below"), F.count(F.lit(1)).alias("all"),
    ).first()
    found: dict[int, float] = {}
    inner = []
    for r in sorted(set(ranks)):
        if r <= ends.below:
            found[r] = float("-inf")
        elif r <= ends.below + ends.n:
            inner.append((r, r - ends.below))
        elif r <= ends["all"]:
            found[r] = float("inf")
    v = v.filter(finite)
    brackets = {(ends.lo, ends.hi): inner} if inner else {}
    while brackets:
        narrower: dict[tuple[float, float], list[tuple[int, int]]] = {}
        for (lo, hi), wanted in brackets.items():
            if lo == hi:
                found.update({r: lo for r, _ in wanted})
                continue
            if whole:
                step = -(-(hi - lo + 1) // BINS)
                pos = F.floor((F.col("v").cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")) / F.lit(step).cast("decimal(20,0)"))
            elif hi / 2 == lo / 2:  # neighbours so small that halving makes them equal: nothing lies between
                pos = F.when(F.col("v") > lo, F.lit(BINS)).otherwise(F.lit(0))
            else:
                pos = F.floor((F.col("v") / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2) * BINS)
            bins = (
                v.filter(F.col("v").between(lo, hi))
                .groupBy(F.least(pos, F.lit(BINS - 1)).alias("bin"))
                .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                .collect()
            )
            bins.sort(key=lambda b: b.bin)
            for rank, left in wanted:
                for b in bins:
                    if left <= b.n:
                        narrower.setdefault((b.lo, b.hi), []).append((rank, left))
                        break
                    left -= b.n
        brackets = narrower
    return found


def quantiles(df: DataFrame, value: str, qs: Sequence[float], small: int = SMALL_COLUMN) -> list[float]:
    """Linear-interpolation quantiles of a whole column; NULL and NaN are left out.

    Up to ``small`` finite values the built-in aggregate is used, else order statistics by bins; both follow one formula.
    """
    v = _numbers(df, F.col(value)).select(F.col("v").cast("double").alias("v"))
    n, odd = v.agg(F.count(F.lit(1)), F.count(F.when(F.abs("v") == float("inf"), 1))).first()
    if n == 0:
        raise ValueError(f"no values in column {value!r}")
    if n <= small and not odd:
        return list(v.agg(F.percentile("v", F.array(*[F.lit(float(q)) for q in qs]))).first()[0])
    places = [(n - 1) * q for q in qs]
    ranks = sorted({r for p in places for r in (math.floor(p) + 1, math.ceil(p) + 1)})
    stats = order_statistics(v, "v", ranks)
    out = []
    for p in places:
        low, high = math.floor(p), math.ceil(p)
        a, b = stats[low + 1], stats[high + 1]
        out.append(a if a == b else (high - p) * a + (p - low) * b)
    return out


def top_k(df: DataFrame, score: str, k: int, tie: str = "pool_idx", limit: int = TOP_LIMIT) -> DataFrame:
    """The ``k`` rows of largest score, ties by ascending ``tie``; NULL and NaN scores come last, a NULL tie comes first.

    A short list uses Spark's bounded top-k. A long one never gathers rows: the exact cut (score, tie) is found by binned counts, then
    a plain filter keeps the rows above it. Both give the same rows.
    """
    if k <= 0:
        return df.limit(0)
    missing = F.col(score).isNull() | F.isnan(F.col(score).cast("double"))
    if k <= limit:
        return df.orderBy(F.desc_nulls_last(F.when(~missing, F.col(score))), F.asc(tie)).limit(k)
    scored = df.filter(~missing)
    n = scored.count()
    if n < k:
        return scored.unionByName(_first_by(df.filter(missing), tie, k - n))
    cut = order_statistics(scored, score, [n - k + 1])[n - k + 1]
    above = scored.filter(F.col(score) > cut)
    return above.unionByName(_first_by(scored.filter(F.col(score) == cut), tie, k - above.count()))


def _first_by(df: DataFrame, tie: str, k: int) -> DataFrame:
    """The first ``k`` rows by ascending ``tie``, NULL first."""
    blank = df.filter(F.col(tie).isNull())
    n = blank.count()
    if n >= k:
        return blank.limit(k)
    last = order_statistics(df, tie, [k - n]).get(k - n)
    if last is None:
        return df
    below = df.filter(F.col(tie) < last)
    # rows at the cut agree in score and tie, so any of them will do
    return blank.unionByName(below).unionByName(df.filter(F.col(tie) == last).limit(k - n - below.count()))


def top_k_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key, ranked from 1.

    Every key is limited before its rows come together: by Spark itself for a short list, and by a first ranking within parts of the
    key, one for each input partition, for a longer one.
    """
    if k > WINDOW_LIMIT:
        part = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = df.withColumn("_part", F.spark_partition_id()).withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= k).drop("_part", "_n")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def global_index(df: DataFrame, order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """Dense 0-based position in a total order, with one range shuffle and no single-task window.

    The range-sorted rows carry their place within their partition; the checkpoint pins the
    partition bounds, and only one row count per partition is summed up.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", _LOCAL_BITS))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    # one row per shuffle partition, so the broadcast cannot grow with the data
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, local + F.col("_start"))
        .drop("_at", "_part", "_start")
    )


def grouped_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "pos"
) -> DataFrame:
    """Dense 0-based position within each key; a key of any size is spread over many tasks."""
    placed = global_index(df, [*keys, *order], "_global")
    firsts = placed.groupBy(*keys).agg(F.min("_global").alias("_first"))
    return placed.join(firsts, list(keys)).withColumn(name, F.col("_global") - F.col("_first")).drop("_global", "_first")


def blocks(df: DataFrame, size: int = BLOCK_ROWS) -> Iterator[list]:
    """Rows of ``df`` in driver-sized blocks; more rows mean more blocks, never a bigger one.

    Beyond one block the rows are pinned and numbered, so every block is cut from the same rows.
    """
    head = df.limit(size + 1).collect()
    if len(head) <= size:
        if head:
            yield head
        return
    numbered = cut_lineage(global_index(df, df.columns, "_row"))
    n = numbered.count()
    for start in range(0, n, size):
        yield numbered.filter((F.col("_row") >= start) & (F.col("_row") < start + size)).drop("_row").collect()
