"""Result streams: ingest, de-duplication, running labels, running lifecycle, progress."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pickwise.functions.states import contributes, open_job
from pickwise.operators.jobs import latest
from pickwise.operators.lifecycle import observation_phases
from pickwise.operators.observations import event_key
from pickwise.sources.stores import versions


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_dedupe(obs: DataFrame, ts: str | None = None, delay: str | None = None) -> DataFrame:
    """One event per key, the first to arrive; an event that comes later does not replace it, even with an earlier time. Without a
    watermark keys are remembered for ever, as the log demands; with one, only for ``delay``, which may let a later duplicate through."""
    keyed = obs.withColumn("_key", event_key())
    if ts and delay:
        return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
    return keyed.dropDuplicates(["_key"]).drop("_key")


def split_late(path: str, ts: str, delay: str) -> Callable[[DataFrame, int], None]:
    """Sink that parts a micro-batch by the watermark: ``path``/on_time for ``stream_dedupe`` and ``path``/late, with a reason.

    The watermark is the latest event time of all micro-batches before, less ``delay`` (an interval such as ``2 hours``); a row at or behind it, or
    without a time, is late and kept apart. One row a micro-batch remembers the latest time. De-duplication of what is on time has seen no later
    time than this sink, so it drops no row as late by itself: every row is kept, repeated or late, and none goes missing.
    """
    root = path.rstrip("/")

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        if not _is_new(spark, f"{root}/seen", batch_id):
            return
        before = [v for v in versions(spark, f"{root}/seen") if v < batch_id]
        latest_time = spark.read.parquet(f"{root}/seen/version={before[-1]}").first()["latest"] if before else None
        mark = F.lit(latest_time).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        when = F.col(ts).cast("timestamp")
        reason = F.when(when.isNull(), F.lit("no event time")).when(when <= mark, F.lit("behind the watermark"))
        rows = df.withColumn(ts, when).withColumn("reason", reason)
        df.persist()
        rows.filter(F.col("reason").isNull()).drop("reason").write.mode("overwrite").parquet(f"{root}/on_time/version={batch_id}")
        rows.filter(F.col("reason").isNotNull()).withColumn("watermark", mark).write.mode("overwrite").parquet(f"{root}/late/version={batch_id}")
        # written last: a micro-batch that has no row here is done again, as a whole
        seen = df.agg(F.greatest(F.max(when), F.lit(latest_time).cast("timestamp")).alias("latest"))
        seen.write.mode("overwrite").parquet(f"{root}/seen/version={batch_id}")
        df.unpersist()

    return write


def stream_labels(obs: DataFrame, n_objectives: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Running mean, spread and count per candidate; update mode. State is three numbers per key."""
    vals = [F.get("values", F.lit(i)) for i in range(n_objectives)]
    aggs = [f(v).alias(f"{n}{i}") for i, v in enumerate(vals) for f, n in ((F.avg, "agg"), (F.stddev_pop, "std"))]
    return obs.filter(contributes()).groupBy(*by, "pool_idx").agg(F.count(F.lit(1)).alias("n"), *aggs)


def stream_phases(obs: DataFrame, order: str, max_fail_retries: int = 1, max_qc_retries: int = 1) -> DataFrame:
    """Running lifecycle phase per candidate; update mode. The batch rules are used as they are: they
    need only counts and last times, so late and unordered results are taken in correctly."""
    return observation_phases(obs, order, max_fail_retries, max_qc_retries)


def _is_new(spark: SparkSession, path: str, batch_id: int) -> bool:
    return batch_id not in versions(spark, path)


def append_to_log(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that writes each micro-batch to its own folder, so a repeated batch adds nothing."""
    def write(df: DataFrame, batch_id: int) -> None:
        if _is_new(df.sparkSession, path, batch_id):
            # an unfinished folder of an earlier attempt is replaced
            df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={batch_id}")

    return write


def latest_rows(spark: SparkSession, path: str, key: str, before: int | None = None) -> DataFrame | None:
    """Last written row per key over all finished micro-batches (those below ``before``)."""
    root = path.rstrip("/")
    folders = [f"{root}/version={v}" for v in versions(spark, path) if before is None or v < before]
    if not folders:
        return None
    rows = spark.read.option("basePath", root).parquet(*folders)
    return latest(rows, key, "version").drop("version")


def progress_rows(log_path: str, out_path: str, ledger: DataFrame | None = None):
    """Sink that ingests a micro-batch and writes one progress row for it."""
    append = append_to_log(log_path)

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        append(df, batch_id)
        if not _is_new(spark, out_path, batch_id):
            return
        fresh = spark.read.parquet(f"{log_path}/version={batch_id}")
        earlier = [f"{log_path}/version={v}" for v in versions(spark, log_path) if v < batch_id]
        gained = fresh.filter(contributes()).select("pool_idx").distinct()
        if earlier:
            old = spark.read.schema(df.schema).parquet(*earlier).filter(contributes()).select("pool_idx")
            gained = gained.join(old, "pool_idx", "left_anti")
        open_now = ledger.filter(open_job()).count() if ledger is not None else 0
        row = fresh.agg(F.count(F.lit(1)).alias("n_new_obs")).select(
            F.lit(batch_id).alias("batch_id"), "n_new_obs",
            gained.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_new_labels"),
            F.lit(open_now).alias("open_jobs"),
        )
        row.coalesce(1).write.mode("overwrite").parquet(f"{out_path}/version={batch_id}")

    return write


def run_available(stream: DataFrame, checkpoint: str, sink: Callable, mode: str = "append") -> StreamingQuery:
    """Process everything there is and stop; the checkpoint lets the next run go on from there."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(sink).start()
    )
    query.awaitTermination()
    return query


def append_updates(path: str) -> Callable[[DataFrame, int], None]:
    """Sink for update-mode results: writes the changed rows only; read them with ``latest_rows``."""
    return append_to_log(path)
