"""Durable state: observation log, candidate snapshots, job ledger, campaign headers, round history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwise.operators.observations import labels_from

LEDGER_FIELDS = ("item_id", "smiles", "pool_idx", "kind", "compound_id", "well_id", "replicate_of")


def append_observations(obs: DataFrame, path: str) -> None:
    """The log only grows; labels are always derived from it."""
    obs.write.mode("append").parquet(path)


def replay(spark: SparkSession, path: str, n_objectives: int, order: Sequence[str], **rules) -> DataFrame:
    """Labels recomputed from the stored log."""
    return labels_from(spark.read.parquet(path), n_objectives, order, **rules)


def save_version(df: DataFrame, path: str, version: int) -> str:
    """A complete snapshot in its own folder; a finished version is never overwritten, an unfinished one is written anew."""
    target = f"{path.rstrip('/')}/version={version}"
    if version in versions(df.sparkSession, path):
        raise FileExistsError(f"version {version} is already complete: {target}")
    df.write.mode("overwrite").parquet(target)
    return target


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished snapshot numbers: a folder counts once Spark has committed it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    found = []
    for status in fs.listStatus(hadoop):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version=") and fs.exists(done):
            found.append(int(name.split("=", 1)[1]))
    return sorted(found)


def load_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A snapshot, the last finished one by default; None when there is none."""
    known = versions(spark, path)
    if version is None:
        version = known[-1] if known else None
    if version is None or version not in known:
        return None
    return spark.read.parquet(f"{path.rstrip('/')}/version={version}")


def save_ledger(jobs: DataFrame, items: DataFrame, path: str) -> None:
    """The ledger as two flat tables, one row per job and one row per item: a job may have any number of items."""
    jobs.write.mode("overwrite").parquet(f"{path.rstrip('/')}/jobs")
    items.select("job_id", *LEDGER_FIELDS).write.mode("overwrite").parquet(f"{path.rstrip('/')}/items")


def load_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, items) as stored."""
    return tuple(spark.read.parquet(f"{path.rstrip('/')}/{part}") for part in ("jobs", "items"))


def flat_items(jobs: DataFrame, items: DataFrame, keep: Sequence[str] = ("job_id",)) -> DataFrame:
    """Items with columns of their job; items of unknown jobs are left out."""
    return items.join(jobs.select(*dict.fromkeys(("job_id", *keep))), "job_id")


def save_campaign(spark: SparkSession, header: dict, path: str, version: int) -> None:
    """Campaign header row: id, seed, round, next batch number, controls, objectives."""
    row = {
        "campaign_id": header["campaign_id"], "seed": int(header.get("seed", 0)), "round": int(header.get("round", 0)),
        "next_batch_seq": header.get("next_batch_seq"), "init_done": bool(header.get("init_done", False)),
        "positive_idx": list(header.get("positive_idx", ())), "negative_idx": list(header.get("negative_idx", ())),
    }
    schema = (
        "campaign_id STRING, seed BIGINT, round INT, next_batch_seq INT, init_done BOOLEAN, "
        "positive_idx ARRAY<BIGINT>, negative_idx ARRAY<BIGINT>"
    )
    save_version(spark.createDataFrame([row], schema), path, version)


def load_campaign(spark: SparkSession, path: str) -> dict | None:
    """Last header; a missing batch number starts at zero."""
    df = load_version(spark, path)
    if df is None:
        return None
    row = df.withColumn("next_batch_seq", F.coalesce("next_batch_seq", F.lit(0))).first()
    return row.asDict()


def write_history(history: DataFrame, path: str, fmt: str = "json") -> None:
    history.write.mode("errorifexists").format(fmt).save(path)
