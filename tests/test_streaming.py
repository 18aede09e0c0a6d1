from pyspark.sql import functions as F

from pickwise.sources.stores import versions
from pickwise.streaming import ingest as ing

SCHEMA = "item_id STRING, pool_idx BIGINT, values ARRAY<DOUBLE>, state STRING, qc_passed BOOLEAN, kind STRING, ts TIMESTAMP"


def rows(spark, *specs):
    full = [(i, p, [v], "COMPLETED", True, "experimental") for i, p, v in specs]
    return spark.createDataFrame(full, SCHEMA.rsplit(", ", 1)[0]).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))


def test_repeated_batch_adds_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    sink = ing.append_to_log(log)
    sink(rows(spark, ("a", 0, 1.0)), 0)
    sink(rows(spark, ("a", 0, 1.0)), 0)
    sink(rows(spark, ("b", 0, 1.0)), 1)
    assert spark.read.parquet(log).count() == 2 and versions(spark, log) == [0, 1]


def test_restart_without_loss_or_repeat(spark, tmp_path):
    src, log, state = (str(tmp_path / n) for n in ("src", "log", "state"))
    rows(spark, ("a", 0, 1.0), ("b", 1, 2.0)).write.parquet(f"{src}/1")
    schema = spark.read.parquet(f"{src}/1").schema

    def run():
        stream = ing.stream_dedupe(ing.read_stream(spark, f"{src}/*", schema))
        ing.run_available(stream, state, ing.append_to_log(log))

    run()
    rows(spark, ("b", 1, 9.0), ("c", 2, 3.0)).write.parquet(f"{src}/2")
    run()
    run()
    assert sorted(r.item_id for r in spark.read.parquet(log).collect()) == ["a", "b", "c"]


def test_bounded_dedupe_needs_a_watermark(spark, tmp_path):
    src, log = str(tmp_path / "src"), str(tmp_path / "log")
    rows(spark, ("a", 0, 1.0), ("a", 0, 1.0)).write.parquet(src)
    stream = ing.stream_dedupe(ing.read_stream(spark, src, spark.read.parquet(src).schema), "ts", "1 hour")
    ing.run_available(stream, str(tmp_path / "state"), ing.append_to_log(log))
    assert spark.read.parquet(log).count() == 1


def test_progress_counts_new_labels_only(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    ledger = spark.createDataFrame([("j", "RUNNING"), ("k", "DONE")], "job_id STRING, status STRING")
    sink = ing.progress_rows(log, out, ledger)
    sink(rows(spark, ("a", 0, 1.0)), 0)
    sink(rows(spark, ("b", 0, 1.0), ("c", 5, 1.0)), 1)
    got = sorted((r.batch_id, r.n_new_obs, r.n_new_labels, r.open_jobs) for r in spark.read.parquet(out).collect())
    assert got == [(0, 1, 1, 1), (1, 2, 1, 1)]


def test_late_and_timeless_rows_are_kept_apart_with_a_reason(spark, tmp_path):
    src, parted, log = (str(tmp_path / n) for n in ("src", "parted", "log"))

    def at(item, time):
        return rows(spark, (item, 0, 1.0)).withColumn("ts", F.lit(time).cast("timestamp"))

    batches = [
        [("a", "2024-01-01 10:00"), ("b", "2024-01-01 12:00")],
        [("b", "2024-01-01 12:00"), ("c", "2024-01-01 10:00"), ("d", None), ("e", "2024-01-01 11:00"), ("f", "2024-01-01 11:01")],
        [("f", "2024-01-01 11:01"), ("a", "2024-01-01 10:00")],
    ]
    for n, batch in enumerate(batches):
        for m, (item, time) in enumerate(batch):
            at(item, time).write.parquet(f"{src}/{n}-{m}")
        schema = spark.read.parquet(f"{src}/0-0").schema
        for _ in range(2):  # a run without news changes nothing
            ing.run_available(ing.read_stream(spark, f"{src}/*", schema), str(tmp_path / "s1"), ing.split_late(parted, "ts", "1 HOUR"))
            stream = ing.stream_dedupe(ing.read_stream(spark, f"{parted}/on_time/*", schema), "ts", "1 hour")
            ing.run_available(stream, str(tmp_path / "s2"), ing.append_to_log(log))
    kept = sorted(r.item_id for r in spark.read.schema(schema).parquet(log).collect())
    late = sorted((r.item_id, r.reason) for r in spark.read.parquet(f"{parted}/late").collect())
    assert kept == ["a", "b", "f"]
    assert late == [("a", "behind the watermark"), ("c", "behind the watermark"), ("d", "no event time"), ("e", "behind the watermark")]


def test_interrupted_split_is_done_again_as_a_whole(spark, tmp_path):
    root = str(tmp_path / "parted")
    sink = ing.split_late(root, "ts", "1 HOUR")
    batch = rows(spark, ("a", 0, 1.0))
    batch.write.parquet(f"{root}/on_time/version=0")  # an attempt that ended before its last table
    sink(batch, 0)
    sink(batch, 0)
    assert spark.read.parquet(f"{root}/on_time").count() == 1 and versions(spark, f"{root}/seen") == [0]


def test_files_of_a_stream_follow_the_rows(spark, monkeypatch):
    """More rows are more files, none of them a fixed share, and still two micro-batches."""
    from pickwise.plans import stream_queries as sq

    monkeypatch.setattr(sq, "FILE_ROWS", 10)
    for n, files in ((40, 4), (95, 10)):
        batches = []
        stream = sq._stream(spark, "", lambda s, d: s.range(n))  # noqa: B023
        ing.run_available(stream, sq.scratch_path(spark, "state"), lambda df, _: batches.append([r["count"] for r in df.groupBy(F.input_file_name()).count().collect()]))  # noqa: B023
        sizes = sum(batches, [])
        assert len(batches) == 2 and sum(sizes) == n and len(sizes) == files and max(sizes) <= 2 * n / files
