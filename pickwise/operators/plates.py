"""Laying a batch out on a plate: wells, control roles, replicates, item ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pickwise.operators.acquire import sample_order
from pickwise.operators.scale import grouped_index, top_k_per

# The order of roles on a plate.
ROLE_ORDER = ("experimental", "positive", "negative", "blank", "replicate")


# The wells of each role and the geometry of a standard plate.
@dataclass(frozen=True)
class Plate:
    n_experimental: int = 80
    n_positive: int = 4
    n_negative: int = 4
    n_blank: int = 4
    n_replicate: int = 4
    rows: int = 8
    cols: int = 12

    @property
    def size(self) -> int:
        return self.n_experimental + self.n_positive + self.n_negative + self.n_blank + self.n_replicate

    @property
    def capacity(self) -> int:
        return self.rows * self.cols

    def check(self) -> "Plate":
        if self.rows < 1 or self.cols < 1 or self.rows > 26:
            raise ValueError(f"invalid plate geometry: {self.rows} rows, {self.cols} columns")
        if self.size > self.capacity:
            raise ValueError(f"plate needs {self.size} wells but has {self.capacity}")
        return self


def padded(number: Column, width: int) -> Column:
    """Zero-padded text; longer numbers keep all their digits."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def compound_id(pool_idx: Column) -> Column:
    return F.concat(F.lit("CMP"), padded(pool_idx, 7))


def well(slot: Column, cols: int) -> Column:
    """Slot 0 is A01, then along the row."""
    return F.concat(F.chr(F.lit(65) + F.floor(slot / cols)), padded(slot % cols + 1, 2))


def over_capacity(items: DataFrame, plate: Plate) -> DataFrame:
    """Plates with more items than wells."""
    return items.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_items")).filter(F.col("n_items") > plate.capacity)


def controls_check(controls: DataFrame, plate: Plate) -> DataFrame:
    """Controls given against those required; they are never inferred."""
    role = F.col("kind")
    return (
        controls.agg(F.count_if(role == "positive").alias("n_positive"), F.count_if(role == "negative").alias("n_negative"))
        .withColumn("ok", (F.col("n_positive") >= plate.n_positive) & (F.col("n_negative") >= plate.n_negative))
    )


def require_controls(controls: DataFrame, plate: Plate) -> None:
    row = controls_check(controls, plate).first()
    if not row.ok:
        raise ValueError(f"plate needs explicit controls: {plate.n_positive} positive and {plate.n_negative} negative, got {row.asDict()}")


def _sample_key(seed: int) -> list:
    """Order in which a plate's wells are drawn for a second measurement."""
    return [sample_order(seed, F.col("job_id"), F.col("pool_idx")), F.asc("pool_idx")]


def replicate_picks(experimental: DataFrame, plate: Plate, seed: int) -> DataFrame:
    """Sampled experimental wells per plate that are measured again."""
    return top_k_per(experimental, ["job_id"], _sample_key(seed), plate.n_replicate, "_in_role")


def layout(batches: DataFrame, controls: DataFrame, plate: Plate, seed: int = 0) -> DataFrame:
    """All plates at once from ``batches(job_id, rank, pool_idx)`` and ``controls(kind, rank, pool_idx)``.

    Experimental wells come first, then controls, blanks and replicates. Every batch is cut to the
    plate's limit before its wells are numbered, and the limit applies before the shuffle.
    """
    plate.check()
    require_controls(controls, plate)
    chosen = top_k_per(batches, ["job_id"], [F.asc("rank")], plate.n_experimental, "_in_role")
    # slot, size and sample rank of a well all come from the job's own rows, which lie together already
    job = Window.partitionBy("job_id")
    drawn = job.orderBy(*_sample_key(seed))
    experimental = chosen.select(
        "job_id", "pool_idx", (F.col("_in_role") - 1).alias("slot"), F.count(F.lit(1)).over(job).cast("int").alias("_n_exp"), F.row_number().over(drawn).alias("_pick")
    )
    wanted = {"positive": plate.n_positive, "negative": plate.n_negative}
    fixed = None
    for kind, n in wanted.items():
        start = 0 if kind == "positive" else plate.n_positive
        # at most one plate's controls
        one = controls.filter(F.col("kind") == kind).orderBy("rank").limit(n).withColumn(
            "_after", F.lit(start) + F.row_number().over(Window.orderBy("rank")) - 1
        ).select("pool_idx", "kind", "_after")
        fixed = one if fixed is None else fixed.unionByName(one)
    blanks = controls.sparkSession.range(plate.n_blank).select(
        F.lit(-1).cast("bigint").alias("pool_idx"), F.lit("blank").alias("kind"),
        (F.lit(plate.n_positive + plate.n_negative) + F.col("id")).cast("int").alias("_after"),
    )
    roles = fixed.unionByName(blanks).agg(F.collect_list(F.struct("pool_idx", "kind", "_after")).alias("_roles"))
    shape = "array<struct<slot:int,pool_idx:bigint,kind:string,replicate_of:string>>"
    none = F.lit(None).cast("string")
    entry = lambda slot, idx, kind, of: F.struct(slot.cast("int").alias("slot"), idx.cast("bigint").alias("pool_idx"), kind.alias("kind"), of.alias("replicate_of"))
    n_fixed = plate.n_positive + plate.n_negative + plate.n_blank
    own = F.array(entry(F.col("slot"), F.col("pool_idx"), F.lit("experimental"), none)).cast(shape)
    again = F.array(entry(F.col("_n_exp") + n_fixed + F.col("_pick") - 1, F.col("pool_idx"), F.lit("replicate"), well(F.col("slot"), plate.cols))).cast(shape)
    # the first well of a job stands for its controls and blanks
    rest = F.transform("_roles", lambda r: entry(F.col("_n_exp") + r["_after"], r["pool_idx"], r["kind"], none)).cast(shape)
    empty = F.array().cast(shape)
    entries = F.concat(own, F.when(F.col("_pick") <= plate.n_replicate, again).otherwise(empty), F.when(F.col("slot") == 0, rest).otherwise(empty))
    wells = experimental.withColumn("_roles", roles.scalar()).select("job_id", F.explode(entries).alias("_w")).select("job_id", "_w.*").withColumn("well_id", well(F.col("slot"), plate.cols))
    return wells.withColumn("item_id", F.concat_ws(":", "job_id", "well_id")).withColumn(
        "compound_id", F.when(F.col("pool_idx") >= 0, compound_id(F.col("pool_idx"))).otherwise(F.lit(""))
    )


def number_batches(new_jobs: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """Batch numbers of new jobs per campaign, going on after the campaign's last one."""
    last = known.groupBy("campaign_id").agg(F.max("batch_seq").alias("_last"))
    placed = grouped_index(new_jobs, ["campaign_id"], order, "_n")
    return placed.join(last, "campaign_id", "left").withColumn(
        "batch_seq", F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("_n")
    ).drop("_last", "_n")


def job_items(batches: DataFrame, order: list[str]) -> DataFrame:
    """Items ``job:i0``, ``job:i1`` ... of plain batches."""
    placed = grouped_index(batches, ["job_id"], order, "_n")
    return placed.select(
        "job_id", F.concat(F.col("job_id").cast("string"), F.lit(":i"), F.col("_n").cast("string")).alias("item_id"),
        "pool_idx", F.lit("experimental").alias("kind"), compound_id(F.col("pool_idx")).alias("compound_id"),
    )
