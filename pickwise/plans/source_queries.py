"""Queries over sources, documents and simple projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from pickwise.functions import fingerprints as fpf
from pickwise.functions.hashing import seeded_uniform
from pickwise.functions.objectives import Objective, resolve_objectives, static_columns
from pickwise.functions.states import contributes, usable
from pickwise.operators import align as al
from pickwise.operators import feasibility as fe
from pickwise.operators import jobs as jb
from pickwise.operators.scale import use_all_cores
from pickwise.plans import tables as t
from pickwise.plans.registry import query
from pickwise.session import scratch_path
from pickwise.sources import documents as doc
from pickwise.sources import stores as st
from pickwise.sources import tables as src


@query("SELECT p_name AS smiles, p_partkey AS ord FROM part")
def scan_library(spark, d):
    return t.table(spark, d, "part").select(F.col("p_name").alias("smiles"), F.col("p_partkey").alias("ord"))


@query("""WITH l AS (SELECT p_partkey AS k FROM part), r AS (SELECT DISTINCT l_partkey AS k FROM lineitem)
SELECT (SELECT count(*) FROM l) AS n_library, (SELECT count(*) FROM r) AS n_features,
 (SELECT count(*) FROM l WHERE k NOT IN (SELECT k FROM r)) AS n_missing_features,
 (SELECT count(*) FROM r WHERE k NOT IN (SELECT k FROM l)) AS n_unknown_features""")
def check_alignment(spark, d):
    seen = t.table(spark, d, "lineitem").select(F.col("l_partkey").alias("pool_idx")).distinct()
    return al.alignment_report(t.candidates(spark, d), seen)


@query("""WITH raw AS (SELECT p_name AS smiles, CASE WHEN p_size > 40 THEN 'n/a' ELSE p_retailprice::VARCHAR END AS score, p_partkey AS ord FROM part)
SELECT smiles, arg_max(try_cast(score AS DOUBLE), ord) AS score FROM raw WHERE try_cast(score AS DOUBLE) IS NOT NULL GROUP BY smiles""")
def scores_tolerant(spark, d):
    raw = t.table(spark, d, "part").select(
        F.col("p_name").alias("smiles"),
        F.when(F.col("p_size") > 40, F.lit("n/a")).otherwise(F.col("p_retailprice").cast("string")).alias("score"),
        F.col("p_partkey").alias("ord"),
    )
    return src.tolerant_scores(raw)


@query(f"WITH {t.RAW_LABELS} SELECT smiles, dock, qed, sa FROM raw_labels")
def scan_labels(spark, d):
    """Written as gzip CSV, read back with strict types."""
    path = scratch_path(spark, "labels")
    src.write_labels(t.raw_labels(spark, d), path)
    return src.read_labels(spark, path).select("smiles", "dock", "qed", "sa")


LABEL_RULES = dict(method="mean", max_std=14.0)
LABEL_SQL = f"""WITH {t.DEDUPED}, s AS (SELECT pool_idx, count(*) AS n, avg(v) AS a, stddev_pop(v) AS sd FROM deduped WHERE {t.CONTRIBUTES} GROUP BY pool_idx)
SELECT pool_idx, n, round(a, 6) AS agg0, round(sd, 6) AS std0 FROM s WHERE NOT (n >= 2 AND sd > 14 * (1 + 1e-12::DOUBLE))"""


@query(LABEL_SQL)
def replay_log(spark, d):
    """The log is stored, read back and aggregated again."""
    path = scratch_path(spark, "log")
    st.append_observations(t.observations(spark, d), path)
    labels = st.replay(spark, path, 1, t.OBS_ORDER, **LABEL_RULES)
    return labels.select("pool_idx", "n", F.round("agg0", 6).alias("agg0"), F.round("std0", 6).alias("std0"))


@query(f"""WITH {t.DEDUPED}, {t.LEDGER}
SELECT job_id, status, item_id, deduped.pool_idx, deduped.kind FROM deduped JOIN ledger USING (job_id)""")
def ledger_roundtrip(spark, d):
    """Jobs and their items, stored as two tables, read back and joined."""
    from pickwise.operators.observations import dedupe

    items = dedupe(t.observations(spark, d), t.OBS_ORDER).select(
        "job_id", "item_id", "smiles", "pool_idx", "kind", "compound_id",
        F.lit(None).cast("string").alias("well_id"), F.lit(None).cast("string").alias("replicate_of"),
    )
    path = scratch_path(spark, "ledger")
    st.save_ledger(t.ledger(spark, d), items, path)
    return st.flat_items(*st.load_ledger(spark, path), ["job_id", "status"]).select("job_id", "status", "item_id", "pool_idx", "kind")


@query("""SELECT event_id::VARCHAR AS item_id, user_id AS pool_idx, 'COMPLETED' AS state, value AS v0, false AS qc_passed,
 'experimental' AS kind, '' AS message, json_extract_string(props, '$.k')::BIGINT AS k FROM events""")
def obs_from_json(spark, d):
    ev = t.table(spark, d, "events")
    body = F.struct(
        F.col("event_id").cast("string").alias("item_id"), F.col("user_id").alias("pool_idx"),
        F.lit("COMPLETED").alias("state"), F.array("value").alias("values"), F.col("props").alias("raw"),
    )
    obs = doc.observations_from_json(ev.select(F.to_json(body).alias("doc")))
    k = F.get_json_object("raw", "$.k").cast("bigint").alias("k")
    return obs.select("item_id", "pool_idx", "state", F.get("values", F.lit(0)).alias("v0"), "qc_passed", "kind", "message", k)


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pool_idx, -p_retailprice AS activity FROM part")
def scan_truth(spark, d):
    return src.truth_by_row(t.raw_labels(spark, d).withColumnRenamed("pool_idx", "ord"), "ord")


PLATE_ITEMS = f"""WITH {t.DEDUPED}, {t.LEDGER}, it AS (SELECT job_id, campaign_id, round, item_id, deduped.kind, compound_id, smiles, pool_idx FROM deduped JOIN ledger USING (job_id))"""


@query(PLATE_ITEMS + """ SELECT job_id, count(*) AS n_items, min(item_id) AS first_well, campaign_id, max(round) AS round,
 sum(pool_idx)::BIGINT AS idx_sum, 'v1' AS version FROM it GROUP BY job_id, campaign_id""")
def plate_payload(spark, d):
    """Submit documents per job, read back field by field."""
    docs = doc.plate_documents(_plate_items(spark, d))
    items = F.from_json(F.get_json_object("payload", "$.plate"), "ARRAY<STRUCT<well: STRING, pool_idx: BIGINT>>")
    field = lambda n: F.get_json_object("payload", f"$.{n}")
    return docs.withColumn("_i", items).select(
        "job_id", "n_items", F.get("_i", F.lit(0))["well"].alias("first_well"), field("campaign_id").alias("campaign_id"),
        field("round").cast("int").alias("round"),
        F.aggregate("_i", F.lit(0).cast("bigint"), lambda a, x: a + x["pool_idx"]).alias("idx_sum"),
        field("protocol_version").alias("version"),
    )


def _plate_items(spark, d):
    from pickwise.operators.observations import dedupe

    obs = dedupe(t.observations(spark, d), t.OBS_ORDER)
    return obs.join(t.ledger(spark, d).select("job_id", "campaign_id", "round"), "job_id").select(
        "job_id", "campaign_id", "round", "item_id", "kind", "compound_id", "smiles", "pool_idx",
        F.lit("").alias("well_id"), F.lit(None).cast("string").alias("replicate_of"),
    )


@query("""SELECT o_orderkey AS job_id, CASE
 WHEN o_orderstatus = 'P' THEN 'unsupported protocol_version: v0'
 WHEN o_orderpriority LIKE '1%' THEN 'missing field: campaign_id'
 WHEN o_custkey < 300 THEN 'missing field: round'
 WHEN o_totalprice < 100000 THEN 'missing field: plate'
 WHEN o_totalprice < 200000 THEN 'plate is not a list with items' END AS reason FROM orders""")
def payload_validate(spark, d):
    o = t.table(spark, d, "orders")
    plate = F.when(F.col("o_totalprice") < 100_000, F.lit(None)).when(F.col("o_totalprice") < 200_000, F.array().cast("array<bigint>")).otherwise(F.array("o_custkey"))
    body = F.struct(
        F.when(F.col("o_orderstatus") == "P", F.lit("v0")).otherwise(F.lit("v1")).alias("protocol_version"),
        F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias("campaign_id"),
        F.when(F.col("o_custkey") >= 300, F.lit(1)).alias("round"), plate.alias("plate"),
    )
    docs = o.select(F.col("o_orderkey").alias("job_id"), F.to_json(body).alias("payload"))
    return doc.validate_plates(docs).select("job_id", "reason")


@query(PLATE_ITEMS + """ SELECT job_id, round, item_id, pool_idx, kind, 'COMPLETED' AS state, pool_idx * 0.5::DOUBLE AS v0, false AS qc_passed, 'robot' AS source, '' AS message FROM it""")
def results_explode(spark, d):
    """Result documents of whole jobs back to observation rows; the well stands in for the item id."""
    items = _plate_items(spark, d)
    row = F.struct(
        F.col("item_id").alias("well"), "kind", "smiles", "pool_idx", F.lit("COMPLETED").alias("state"),
        F.array(F.col("pool_idx") * 0.5).alias("values"),
    )
    docs = items.groupBy("job_id", "campaign_id", "round").agg(F.collect_list(row).alias("results")).select(
        F.to_json(F.struct(F.col("job_id").cast("string").alias("job_id"), "campaign_id", "round", "results")).alias("doc")
    )
    obs = doc.results_to_observations(docs)
    return obs.select(
        F.col("job_id").cast("bigint").alias("job_id"), "round", "item_id", "pool_idx", "kind", "state",
        F.get("values", F.lit(0)).alias("v0"), "qc_passed", "source", "message",
    )


@query("""SELECT s_suppkey AS item_id, CASE WHEN s_nationkey < 5 THEN NULL ELSE s_acctbal END AS score FROM supplier""")
def parse_logs(spark, d):
    """Docking output: header, an unreadable first mode for some rows, and no modes at all for others."""
    s = t.table(spark, d, "supplier")
    header = F.lit("mode | affinity\n-----+---------\n")
    bad = F.when(F.col("s_nationkey") > 15, F.lit("1 n/a 0 0\n")).otherwise(F.lit(""))
    line = F.when(F.col("s_nationkey") >= 5, F.concat(F.lit("  1   "), F.col("s_acctbal").cast("string"), F.lit("  0 0\n   2  -1.0 0 0\n"))).otherwise(F.lit("12 5.0\n"))
    logs = s.select(F.col("s_suppkey").alias("item_id"), F.concat(header, bad, line).alias("text"))
    return doc.parse_logs(logs).select("item_id", "score")


@query(f"WITH {t.RAW_LABELS} SELECT pool_idx, -dock AS activity, qed, -sa AS sa_ease FROM raw_labels")
def objective_projection(spark, d):
    """Columns of a schema given as mappings, a source and a direction each."""
    schema = resolve_objectives({
        "objectives": [{"name": "activity", "maximize": False, "source": "dock"}],
        "static_properties": ["qed", {"name": "sa_ease", "maximize": False, "source": "sa"}],
    })
    return t.raw_labels(spark, d).select("pool_idx", *schema.columns())


@query("SELECT p_partkey AS pool_idx, -p_retailprice AS lower, p_retailprice AS higher, p_retailprice AS back FROM part")
def maximize_map(spark, d):
    low, high = Objective("dock", maximize=False), Objective("dock")
    raw = F.col("dock")
    return t.raw_labels(spark, d).select(
        "pool_idx", low.maximized(raw).alias("lower"), high.maximized(raw).alias("higher"), low.maximized(low.maximized(raw)).alias("back")
    )


@query(f"WITH {t.RAW_LABELS} SELECT pool_idx, -dock AS activity, qed, -sa AS sa_ease FROM raw_labels")
def derive_labels(spark, d):
    return src.derive_labels(t.raw_labels(spark, d))


@query(f"WITH {t.CANDIDATES} SELECT pool_idx, qed, sa_ease FROM candidates")
def static_cols(spark, d):
    c = t.candidates(spark, d)
    return c.select("pool_idx", *static_columns(c, ["qed", "sa_ease"]))


@query(f"WITH {t.TRUTH}, {t.LABELLED} SELECT pool_idx, activity, qed, sa_ease FROM truth WHERE pool_idx IN (SELECT pool_idx FROM labelled)")
def reveal_labels(spark, d):
    return jb.reveal_labels(t.labelled(spark, d), t.truth(spark, d), ["activity", "qed", "sa_ease"])


OBS_OUT = ["item_id", "pool_idx", "kind", "quantity", "price"]


@query(f"WITH {t.OBS} SELECT item_id, pool_idx, kind, quantity, price FROM obs WHERE {t.CONTRIBUTES} AND kind = 'experimental'")
def usable_obs(spark, d):
    return t.observations(spark, d).filter(usable()).select(*OBS_OUT)


@query(f"WITH {t.OBS} SELECT item_id, pool_idx, kind, quantity, price FROM obs WHERE {t.CONTRIBUTES}")
def contributing_obs(spark, d):
    return t.observations(spark, d).filter(contributes()).select(*OBS_OUT)


STOCK_SQL = "('0x' || substr(md5(p_partkey || ':7'), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= 0.3::DOUBLE"


@query(f"SELECT p_partkey AS pool_idx, {STOCK_SQL} AS in_stock FROM part")
def stock_mask(spark, d):
    return t.candidates(spark, d).select("pool_idx", fe.in_stock(0.3, 7).alias("in_stock"))


@query(f"""SELECT p_partkey AS pool_idx FROM part WHERE -p_size >= (SELECT quantile_cont(-p_size::DOUBLE, 0.1) FROM part) AND {STOCK_SQL}""")
def feasible(spark, d):
    c = t.candidates(spark, d)
    return fe.feasible(c, c, 0.1, fe.in_stock(0.3, 7)).rows.select("pool_idx")


@query(f"""WITH hard AS (SELECT * FROM part WHERE -p_size < (SELECT quantile_cont(-p_size::DOUBLE, 0.1) FROM part)),
cut AS (SELECT unnest([0.05, 0.02, 0.0]) AS q, unnest([(SELECT quantile_cont(-p_size::DOUBLE, 0.05) FROM part), (SELECT quantile_cont(-p_size::DOUBLE, 0.02) FROM part), (SELECT min(-p_size)::DOUBLE FROM part)]) AS c),
ok AS (SELECT hard.p_partkey, q FROM hard, cut WHERE -p_size >= c AND {STOCK_SQL})
SELECT p_partkey AS pool_idx, q AS quantile FROM ok WHERE q = (SELECT max(q) FROM ok)""".replace("[0.05, 0.02, 0.0]", "[0.05::DOUBLE, 0.02::DOUBLE, 0.0::DOUBLE]"))
def feasible_relax(spark, d):
    """Only candidates below the strict cut are available, so the rule has to relax."""
    c = t.candidates(spark, d)
    hard = c.filter(F.col("sa_ease") < F.lit(fe.quantiles(c, "sa_ease", [0.1])[0]))
    f = fe.feasible(hard, c, 0.1, fe.in_stock(0.3, 7), "relax")
    return f.rows.select("pool_idx", F.lit(f.quantile).alias("quantile"))


@query("""SELECT count(*) FILTER (WHERE s_acctbal > 5000) AS n_positive, count(*) FILTER (WHERE s_acctbal <= 5000) AS n_negative,
 count(*) FILTER (WHERE s_acctbal > 5000) >= 4 AND count(*) FILTER (WHERE s_acctbal <= 5000) >= 4 AS ok FROM supplier""")
def controls_check(spark, d):
    from pickwise.operators.plates import Plate
    from pickwise.operators.plates import controls_check as check

    kind = F.when(F.col("s_acctbal") > 5000, F.lit("positive")).otherwise(F.lit("negative")).alias("kind")
    return check(t.table(spark, d, "supplier").select(kind), Plate())


PAIR_BITS_SQL = """WITH toks AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, list_transform(w, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % 2048) AS h FROM toks WHERE len(w) >= 2),
b AS (SELECT DISTINCT doc_id, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, greatest(len(h) - k, 0)::BIGINT + 1), lambda i: (h[i] * 1031 + h[i + k] * 733 + k * 379) % 2048)))) AS bit FROM h)"""


@query(PAIR_BITS_SQL + """ SELECT toks.doc_id, len(w) >= 2 AS valid, (SELECT count(*) FROM b WHERE b.doc_id = toks.doc_id) AS popcount,
 coalesce((SELECT sum(bit)::BIGINT FROM b WHERE b.doc_id = toks.doc_id), 0) AS bit_sum FROM toks""")
def pair_fingerprint(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", "text")
    fps = fpf.fingerprint(use_all_cores(docs))
    total = F.aggregate("fp", F.lit(0).cast("bigint"), lambda a, x: a + x)
    count = F.coalesce("popcount", F.lit(0)).cast("bigint")
    return fps.select("doc_id", "valid", count.alias("popcount"), F.coalesce(total, F.lit(0)).alias("bit_sum"))


@query("""WITH bad AS (SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) < 2)
SELECT count(*) AS n_invalid, coalesce((SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM bad ORDER BY doc_id LIMIT 20)), '') AS invalid_ids FROM bad""")
def invalid_report(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", "text")
    valid = fpf.has_pair(F.col("text")).alias("valid")
    return fpf.invalid_report(docs.select("doc_id", valid), "doc_id")


@query("""WITH w AS (SELECT vec_id AS pool_idx, list_filter(range(64), lambda i: embedding[i + 1] > 0) AS fp FROM embeddings)
SELECT pool_idx, len(fp) AS popcount, (SELECT sum(1::HUGEINT << b::INT) FROM (SELECT unnest(fp) AS b) WHERE b < 32)::BIGINT AS low_bits FROM w""")
def packed_fingerprint(spark, d):
    """Packed words: 64 on-bits per word."""
    fps = t.fingerprints(spark, d).withColumn("w", F.get(fpf.packed_words(F.col("fp"), t.EMBEDDING_BITS), F.lit(0)))
    return fps.select("pool_idx", F.bit_count("w").alias("popcount"), F.col("w").bitwiseAND(F.lit((1 << 32) - 1)).alias("low_bits"))


@query("""SELECT c_custkey AS id, ('0x' || substr(md5(c_custkey || ':3'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM customer""")
def seeded_hash(spark, d):
    return t.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), seeded_uniform(3, F.col("c_custkey")).alias("u"))
