"""Queries that run a stream over the given tables to its end and return what it left behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from pickwise.operators.lifecycle import fold_events
from pickwise.operators.observations import dedupe
from pickwise.plans import state_queries as sq
from pickwise.plans import tables as t
from pickwise.plans.registry import query
from pickwise.session import cut_lineage, scratch_path
from pickwise.streaming import ingest as ing
from pickwise.streaming import keyed


FILE_ROWS = 250_000  # rows that one task writes to a file of a stream


def _stream(spark, sf_dir: str, view, files: int = 4):
    """A table view as a file stream of two micro-batches: the number of files follows the rows, so no task takes in a fixed share of them."""
    rows = view(spark, sf_dir)
    path = scratch_path(spark, "incoming")
    rows.repartition(max(files, -(-rows.count() // FILE_ROWS))).write.parquet(path)
    written = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    return ing.read_stream(spark, path, rows.schema, files_per_trigger=max(files // 2, -(-written // 2)))


def _run(spark, stream, sink, mode="append"):
    ing.run_available(stream, scratch_path(spark, "stream-state"), sink, mode)


@query(f"WITH {t.OBS} SELECT item_id, 1::BIGINT AS n FROM obs GROUP BY item_id")
def stream_dedupe(spark, d):
    """Every item id passes once, over several micro-batches."""
    out = scratch_path(spark, "deduped")
    _run(spark, ing.stream_dedupe(_stream(spark, d, t.observations)), ing.append_to_log(out))
    return spark.read.parquet(out).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


LATE_SQL = f"""WITH {t.DEDUPED}, cut AS (SELECT *, ts <= TIMESTAMP '1995-06-30' AS first FROM deduped), top AS (SELECT max(ts) AS m FROM cut WHERE first),
again AS (SELECT cut.*, ts <= m - INTERVAL 60 DAY AS late FROM cut, top WHERE first AND ts > m - INTERVAL 120 DAY),
lot AS (SELECT 'kept' AS outcome, * FROM deduped UNION ALL SELECT CASE WHEN late THEN 'late' ELSE 'repeated' END, * EXCLUDE (first, late) FROM again)
SELECT outcome, count(*) AS n, sum(pool_idx)::BIGINT AS ids, sum(quantity)::BIGINT AS quantity FROM lot GROUP BY outcome"""


@query(LATE_SQL)
def stream_late(spark, d):
    """The newer half of the log brings events of the last 120 days again, with a memory of 60: they are repeated or late."""
    log = dedupe(t.observations(spark, d), t.OBS_ORDER).withColumn("ts", F.col("ts").cast("timestamp"))
    first = cut_lineage(log.filter(F.col("ts") <= F.lit("1995-06-30").cast("timestamp")))
    top = first.agg(F.max("ts").alias("m")).first()["m"]
    again = first.filter(F.col("ts") > F.lit(top).cast("timestamp") - F.expr("INTERVAL 120 DAYS"))
    later = log.filter(F.col("ts") > F.lit("1995-06-30").cast("timestamp")).unionByName(again)
    incoming, parted, kept, s1, s2 = (scratch_path(spark, n) for n in ("incoming", "parted", "kept", "split-state", "dedupe-state"))
    for n, part in enumerate((first, later)):
        part.write.parquet(f"{incoming}/{n}")
        ing.run_available(ing.read_stream(spark, f"{incoming}/*", log.schema), s1, ing.split_late(parted, "ts", "60 DAYS"))
        on_time = ing.read_stream(spark, f"{parted}/on_time/*", log.schema)
        ing.run_available(ing.stream_dedupe(on_time, "ts", "60 days"), s2, ing.append_to_log(kept))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("pool_idx").alias("ids"), F.sum("quantity").cast("long").alias("quantity")]
    parts = {name: spark.read.schema(log.schema).parquet(path).agg(*sums) for name, path in (("kept", kept), ("on_time", f"{parted}/on_time"), ("late", f"{parted}/late"))}
    taken = parts["kept"].select(*[(-F.col(c)).alias(c) for c in ("n", "ids", "quantity")])
    repeated = parts["on_time"].unionByName(taken).agg(*[F.sum(c).alias(c) for c in ("n", "ids", "quantity")])
    named = [df.withColumn("outcome", F.lit(name)) for name, df in (("kept", parts["kept"]), ("late", parts["late"]), ("repeated", repeated))]
    return named[0].unionByName(named[1]).unionByName(named[2]).select("outcome", "n", "ids", "quantity")


@query(f"WITH {t.OBS} SELECT pool_idx, count(*) AS n, round(avg(v), 6) AS agg0, round(stddev_pop(v), 6) AS std0 FROM obs WHERE {t.CONTRIBUTES} GROUP BY pool_idx")
def stream_labels(spark, d):
    out = scratch_path(spark, "labels")
    _run(spark, ing.stream_labels(_stream(spark, d, t.observations)), ing.append_updates(out), "update")
    return ing.latest_rows(spark, out, "pool_idx").select("pool_idx", "n", F.round("agg0", 6).alias("agg0"), F.round("std0", 6).alias("std0"))


@query(f"WITH {t.OBS} SELECT pool_idx, round(median(v), 6) AS agg0 FROM obs WHERE {t.CONTRIBUTES} GROUP BY pool_idx")
def stream_medians(spark, d):
    """Medians from keyed state: a micro-batch reads nothing but itself and the state of its candidates."""
    out = scratch_path(spark, "medians")
    _run(spark, keyed.stream_medians(_stream(spark, d, t.observations)), ing.append_updates(out))
    return ing.latest_rows(spark, out, "pool_idx").select("pool_idx", F.round("agg0", 6).alias("agg0"))


@query(f"""WITH {t.DEDUPED}, s AS (SELECT pool_idx, count(*) AS n, median(v) AS m, avg(v) AS a, stddev_pop(v) AS sd FROM deduped WHERE {t.CONTRIBUTES} GROUP BY pool_idx)
SELECT pool_idx, n, round(m, 6) AS agg0, round(a, 6) AS mean0, round(sd, 6) AS std0, n >= 2 AND sd > 14 * (1 + 1e-12::DOUBLE) AS rejected FROM s""")
def stream_label_qc(spark, d):
    """Every event is delivered twice and unordered; de-duplication, labels and quality control run as one stream."""
    def view(s, sf):
        log = cut_lineage(dedupe(t.observations(s, sf), t.OBS_ORDER))
        return log.unionByName(log)

    out = scratch_path(spark, "labels")
    _run(spark, keyed.stream_medians(ing.stream_dedupe(_stream(spark, d, view))), ing.append_updates(out))
    labels = keyed.with_verdict(ing.latest_rows(spark, out, "pool_idx"), 14.0)
    return labels.select("pool_idx", "n", *[F.round(c, 6).alias(c) for c in ("agg0", "mean0", "std0")], "rejected")


@query(sq.FOLD_SQL + " SELECT * FROM state")
def stream_candidates(spark, d):
    """The batch rules on a stream; the order of arrival does not matter."""
    out = scratch_path(spark, "phases")
    _run(spark, ing.stream_phases(_stream(spark, d, t.events), "ord"), ing.append_updates(out), "update")
    return ing.latest_rows(spark, out, "pool_idx")


@query(sq._marks_sql(f"CASE WHEN event_type = 'purchase' THEN 'RELEASE' ELSE {sq.MARK_OPS} END"))
def stream_marks(spark, d):
    """The first third of the log is a batch snapshot, the rest comes as two runs of a stream on keyed state."""
    rows = sq._marks(spark, d, True)
    path, out, state = (scratch_path(spark, n) for n in ("incoming", "snapshots", "stream-state"))
    low, high = rows.agg(F.expr("percentile_approx(ord, array(0.33, 0.67))")).first()[0]
    begin = cut_lineage(fold_events(rows.filter(F.col("ord") <= low), "ord"))
    ing.append_updates(out)(begin, -1)
    for part, between in (("a", (F.col("ord") > low) & (F.col("ord") <= high)), ("b", F.col("ord") > high)):
        rows.filter(between).write.parquet(f"{path}/{part}")
        # the second run goes on from the checkpoint of the first
        stream = keyed.stream_marks(ing.read_stream(spark, f"{path}/*", rows.schema), "ord", snapshot=begin)
        ing.run_available(stream, state, ing.append_updates(out))
    return ing.latest_rows(spark, out, "pool_idx").withColumn("job_id", F.coalesce("job_id", F.lit("-")))


@query(f"WITH {t.OBS} SELECT (SELECT count(*) FROM obs) AS n_obs, (SELECT count(DISTINCT pool_idx) FROM obs WHERE {t.CONTRIBUTES}) AS n_labels, 2::BIGINT AS n_batches")
def stream_progress(spark, d):
    """One progress row per micro-batch; together they cover the whole log."""
    log, out = scratch_path(spark, "log"), scratch_path(spark, "progress")
    _run(spark, _stream(spark, d, t.observations), ing.progress_rows(log, out, t.ledger(spark, d)))
    rows = spark.read.parquet(out)
    return rows.agg(F.sum("n_new_obs").alias("n_obs"), F.sum("n_new_labels").alias("n_labels"), F.count(F.lit(1)).alias("n_batches"))
