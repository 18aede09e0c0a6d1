"""The given tables seen as the engine's own tables. SQL twins of each view sit next to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwise.functions.fingerprints import positive_bits
from pickwise.operators.plates import compound_id
from pickwise.operators.scale import use_all_cores

OBS_ORDER = ["ts", "pool_idx", "quantity", "price"]
EMBEDDING_BITS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library rows: ids repeat, static properties only."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pool_idx"), F.col("p_name").alias("smiles"),
        (F.col("p_size") / 50.0).alias("qed"), (-F.col("p_size")).cast("double").alias("sa_ease"),
    )


CANDIDATES = "candidates AS (SELECT p_partkey AS pool_idx, p_name AS smiles, p_size / 50.0::DOUBLE AS qed, (-p_size)::DOUBLE AS sa_ease FROM part)"


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows as measured: lower docking and lower difficulty are better."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pool_idx"), F.col("p_name").alias("smiles"), F.col("p_retailprice").alias("dock"),
        (F.col("p_size") / 50.0).alias("qed"), F.col("p_size").cast("double").alias("sa"),
    )


RAW_LABELS = "raw_labels AS (SELECT p_partkey AS pool_idx, p_name AS smiles, p_retailprice AS dock, p_size / 50.0::DOUBLE AS qed, p_size::DOUBLE AS sa FROM part)"


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_labels(spark, sf_dir).select(
        "pool_idx", (-F.col("dock")).alias("activity"), "qed", (-F.col("sa")).alias("sa_ease")
    )


TRUTH = "truth AS (SELECT p_partkey AS pool_idx, -p_retailprice AS activity, p_size / 50.0::DOUBLE AS qed, (-p_size)::DOUBLE AS sa_ease FROM part)"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result events; item ids repeat, so the log holds real duplicates."""
    flag = F.col("l_returnflag")
    return use_all_cores(table(spark, sf_dir, "lineitem")).select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("item_id"),
        F.col("l_orderkey").alias("job_id"),
        F.col("l_partkey").alias("pool_idx"),
        F.concat(F.lit("S"), F.col("l_partkey").cast("string")).alias("smiles"),
        compound_id(F.col("l_partkey")).alias("compound_id"),
        F.array("l_quantity").alias("values"),
        F.when(flag == "N", F.lit("COMPLETED")).when(flag == "A", F.lit("FAILED")).otherwise(F.lit("QC_REJECTED")).alias("state"),
        (flag == "N").alias("qc_passed"),
        F.when(F.col("l_linestatus") == "F", F.lit("experimental")).otherwise(F.lit("replicate")).alias("kind"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
    )


OBS = """obs AS (SELECT l_orderkey || ':' || l_linenumber AS item_id, l_orderkey AS job_id, l_partkey AS pool_idx,
  'S' || l_partkey AS smiles, format('CMP{:07d}', l_partkey) AS compound_id, l_quantity AS v,
  CASE l_returnflag WHEN 'N' THEN 'COMPLETED' WHEN 'A' THEN 'FAILED' ELSE 'QC_REJECTED' END AS state,
  l_returnflag = 'N' AS qc_passed, CASE l_linestatus WHEN 'F' THEN 'experimental' ELSE 'replicate' END AS kind,
  l_shipdate AS ts, l_quantity AS quantity, l_extendedprice AS price FROM lineitem)"""
DEDUPED = OBS + """, deduped AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts, pool_idx, quantity, price) AS rn FROM obs) WHERE rn = 1)"""
CONTRIBUTES = "state = 'COMPLETED' AND qc_passed AND pool_idx >= 0"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose accepted measurements agree (spread of at most 14), with the time of the first."""
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'")
    q = F.col("l_quantity")
    known = li.groupBy(F.col("l_partkey").alias("pool_idx")).agg(
        F.min(F.unix_date(F.to_date("l_shipdate"))).alias("ts"), F.count(F.lit(1)).alias("n"), F.sum(q).alias("s"), F.sum(q * q).alias("ss")
    )
    return known.filter("n * ss - s * s <= 196 * n * n").drop("s", "ss")


LABELLED = """labelled AS (SELECT l_partkey AS pool_idx, min(l_shipdate::DATE - DATE '1970-01-01')::INT AS ts, count(*) AS n FROM lineitem
  WHERE l_returnflag = 'N' GROUP BY l_partkey HAVING count(*) * sum(l_quantity * l_quantity) - sum(l_quantity) * sum(l_quantity) <= 196 * count(*) * count(*))"""


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with features: on-bits are the positive positions of the embedding."""
    bits = positive_bits(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pool_idx"), bits.alias("fp"), F.size(bits).alias("popcount"), "label", "embedding"
    )


FPS = """fps AS (SELECT vec_id AS pool_idx, label, list_filter(range(64), lambda i: embedding[i + 1] > 0) AS fp FROM embeddings),
  bits AS (SELECT pool_idx, unnest(fp) AS b FROM fps), pop AS (SELECT pool_idx, len(fp) AS n FROM fps)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle events with a unique BIGINT order."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("pool_idx"), F.col("event_id").cast("string").alias("item_id"), "ts",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ord"), F.array("value").alias("values"),
        F.when(kind == "purchase", F.lit("COMPLETED")).when(kind == "error", F.lit("FAILED"))
        .when(kind == "signup", F.lit("QC_REJECTED")).when(kind == "view", F.lit("RUNNING")).otherwise(F.lit("CANCELLED")).alias("state"),
        (kind == "purchase").alias("qc_passed"), F.lit("experimental").alias("kind"), "props", "value", "event_type",
    )


EVENTS = """ev AS (SELECT user_id AS pool_idx, event_id::VARCHAR AS item_id, epoch_us(ts) AS ord, value, event_type, props,
  CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'QC_REJECTED' WHEN 'view' THEN 'RUNNING' ELSE 'CANCELLED' END AS state
  FROM events)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("campaign_id"), F.col("o_custkey").alias("owner"),
        F.when(status == "P", F.lit("RUNNING")).when(status == "O", F.lit("SUBMITTED")).otherwise(F.lit("DONE")).alias("status"),
        F.when(F.col("o_totalprice") < 50_000, F.lit("init")).otherwise(F.lit("greedy")).alias("acquisition"),
        F.col("o_orderdate").alias("ts"), F.year("o_orderdate").alias("round"),
    )


LEDGER = """ledger AS (SELECT o_orderkey AS job_id, o_orderpriority AS campaign_id, o_custkey AS owner,
  CASE o_orderstatus WHEN 'P' THEN 'RUNNING' WHEN 'O' THEN 'SUBMITTED' ELSE 'DONE' END AS status,
  CASE WHEN o_totalprice < 50000 THEN 'init' ELSE 'greedy' END AS acquisition, o_orderdate AS ts, year(o_orderdate) AS round FROM orders)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two predicted objectives per candidate, without a model."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pool_idx"), F.col("p_retailprice").alias("mean0"), F.col("p_size").cast("double").alias("std0"),
        (F.col("p_size") * 1.0).alias("mean1"), (F.col("p_retailprice") / 100.0).alias("std1"),
    )


PREDICTIONS = """pred AS (SELECT p_partkey AS pool_idx, p_retailprice AS mean0, p_size::DOUBLE AS std0, p_size::DOUBLE AS mean1, p_retailprice / 100.0::DOUBLE AS std1 FROM part)"""


def known_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured values of the labelled candidates, two objectives."""
    done = labelled(spark, sf_dir)
    p = predictions(spark, sf_dir)
    return p.join(done.select("pool_idx"), "pool_idx").select(
        "pool_idx", (F.col("mean0") * 0.9).alias("agg0"), (F.col("mean1") * 0.9).alias("agg1")
    )


KNOWN = LABELLED + ", " + PREDICTIONS + ", known AS (SELECT pool_idx, mean0 * 0.9::DOUBLE AS agg0, mean1 * 0.9::DOUBLE AS agg1 FROM pred WHERE pool_idx IN (SELECT pool_idx FROM labelled))"
