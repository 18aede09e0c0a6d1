"""Queries over joins, aggregates, Pareto geometry and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pickwise.operators import align as al
from pickwise.operators import jobs as jb
from pickwise.operators import metrics as me
from pickwise.operators import observations as ob
from pickwise.operators import pareto as pa
from pickwise.operators import similarity as si
from pickwise.operators.scale import use_all_cores
from pickwise.operators.similarity_join import best_similarity
from pickwise.plans import tables as t
from pickwise.plans.registry import query
from pickwise.session import cut_lineage

# ---- joins --------------------------------------------------------------------------------------


@query("""WITH lib AS (SELECT p_name AS smiles, arg_max(p_partkey, p_partkey) AS lib_ord, arg_max(p_brand, p_partkey) AS brand FROM part GROUP BY p_name)
SELECT p.p_partkey AS ord, p.p_name AS smiles, lib_ord, brand, p.p_retailprice AS dock FROM part p JOIN lib ON lib.smiles = p.p_name""")
def align_library(spark, d):
    p = t.table(spark, d, "part")
    labels = p.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("smiles"), F.col("p_retailprice").alias("dock"))
    library = p.select(F.col("p_name").alias("smiles"), F.col("p_partkey").alias("lib_ord"), F.col("p_brand").alias("brand"))
    return al.align(labels, library, "lib_ord").select("ord", "smiles", "lib_ord", "brand", "dock")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pool_idx FROM orders""")
def assign_pool_idx(spark, d):
    from pickwise.operators.scale import global_index

    o = t.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return global_index(o, ["o_orderdate", "o_orderkey"], "pool_idx").select("o_orderkey", "pool_idx")


BUILD_LABELS_SQL = """WITH scores AS (SELECT p_name AS smiles, arg_max(p_retailprice, p_partkey) AS score FROM part WHERE p_size <= 40 AND p_brand <> 'Brand#1' GROUP BY p_name),
 lib AS (SELECT p_partkey AS ord, p_name AS smiles, p_size / 50.0::DOUBLE AS qed, CASE WHEN p_size > 45 THEN NULL ELSE p_size::DOUBLE END AS sa FROM part)"""


def _library_and_scores(spark, d):
    from pickwise.sources.tables import tolerant_scores

    p = t.table(spark, d, "part")
    raw = p.filter((F.col("p_size") <= 40) & (F.col("p_brand") != "Brand#1")).select(
        F.col("p_name").alias("smiles"), F.col("p_retailprice").cast("string").alias("score"), F.col("p_partkey").alias("ord")
    )
    lib = p.select(
        F.col("p_partkey").alias("ord"), F.col("p_name").alias("smiles"), (F.col("p_size") / 50.0).alias("qed"),
        F.when(F.col("p_size") <= 45, F.col("p_size").cast("double")).alias("sa"),
    )
    return lib, tolerant_scores(raw)


@query(BUILD_LABELS_SQL + " SELECT ord, smiles, qed, sa, score AS dock FROM lib JOIN scores USING (smiles) WHERE sa IS NOT NULL")
def build_labels(spark, d):
    lib, scores = _library_and_scores(spark, d)
    return al.build_labels(lib, scores).select("ord", "smiles", "qed", "sa", F.col("score").alias("dock"))


@query(BUILD_LABELS_SQL + """ SELECT count(*) AS n_rows, count(*) FILTER (WHERE score IS NULL) AS n_unscored,
 count(*) FILTER (WHERE score IS NOT NULL AND sa IS NULL) AS n_invalid, count(*) FILTER (WHERE score IS NOT NULL AND sa IS NOT NULL) AS n_kept FROM lib LEFT JOIN scores USING (smiles)""")
def build_labels_report(spark, d):
    return al.build_labels_report(*_library_and_scores(spark, d))


REVEAL_ITEMS = """items AS (SELECT l_orderkey AS job_id, l_linenumber AS line, l_partkey AS part, l_extendedprice AS price,
 CASE WHEN l_discount > 0.08 THEN -1 ELSE l_partkey END AS pool_idx, CASE WHEN l_tax > 0.07 THEN 'blank' ELSE 'experimental' END AS kind FROM lineitem)"""


@query(f"""WITH {REVEAL_ITEMS}, truth AS (SELECT p_partkey AS pool_idx, -p_retailprice AS a FROM part WHERE p_size <= 45)
SELECT job_id, line, part, price, items.kind, CASE WHEN kind = 'blank' OR pool_idx < 0 THEN NULL ELSE a END AS activity,
 CASE WHEN kind = 'blank' OR pool_idx < 0 OR a IS NOT NULL THEN 'COMPLETED' ELSE 'FAILED' END AS state,
 NOT (kind = 'blank' OR pool_idx < 0) AND a IS NOT NULL AS qc_passed,
 CASE WHEN kind = 'blank' OR pool_idx < 0 THEN 'no value expected' WHEN a IS NOT NULL THEN 'ok' ELSE 'missing truth for pool_idx=' || pool_idx END AS message
FROM items LEFT JOIN truth USING (pool_idx)""")
def reveal_batch(spark, d):
    items = t.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_discount") > 0.08, F.lit(-1).cast("bigint")).otherwise(F.col("l_partkey")).alias("pool_idx"),
        F.when(F.col("l_tax") > 0.07, F.lit("blank")).otherwise(F.lit("experimental")).alias("kind"),
    )
    truth = t.raw_labels(spark, d).filter("sa <= 45").select("pool_idx", (-F.col("dock")).alias("activity"))
    out = jb.reveal(items, truth, F.array("activity"))
    return out.select("job_id", "line", "part", "price", "kind", F.get("values", F.lit(0)).alias("activity"), "state", "qc_passed", "message")


@query(f"""WITH {t.DEDUPED}, s AS (SELECT pool_idx, avg(v) AS a FROM deduped WHERE {t.CONTRIBUTES} GROUP BY pool_idx), {t.FPS}
SELECT s.pool_idx, round(a, 6) AS target, len(fp) AS n_features FROM s JOIN fps USING (pool_idx)""")
def training_matrix(spark, d):
    labels = ob.labels_from(t.observations(spark, d), 1, t.OBS_ORDER, max_std=None).withColumn("values", F.array("agg0"))
    m = ob.training_matrix(labels, t.fingerprints(spark, d), 1, "fp")
    return m.select("pool_idx", F.round(F.get("values", F.lit(0)), 6).alias("target"), F.size("fp").cast("bigint").alias("n_features"))


@query(f"WITH {t.CANDIDATES} SELECT l_partkey AS pool_idx, smiles, qed FROM lineitem JOIN candidates ON pool_idx = l_partkey")
def gather(spark, d):
    ids = t.table(spark, d, "lineitem").select(F.col("l_partkey").alias("pool_idx"))
    return si.gather(t.candidates(spark, d), ids, ["smiles", "qed"])


TANIMOTO_SQL = f"""WITH {t.FPS}, refs AS (SELECT pool_idx AS r FROM fps WHERE label = 0),
i AS (SELECT a.pool_idx, b.pool_idx AS r, count(*) AS n FROM bits a JOIN bits b ON a.b = b.b JOIN refs ON refs.r = b.pool_idx GROUP BY ALL),
s AS (SELECT i.pool_idx, max(i.n / (p.n + q.n - i.n)::DOUBLE) AS sim FROM i JOIN pop p ON p.pool_idx = i.pool_idx JOIN pop q ON q.pool_idx = i.r GROUP BY i.pool_idx)"""


@query(TANIMOTO_SQL + " SELECT fps.pool_idx, round(coalesce(sim, 0), 9) AS max_sim FROM fps LEFT JOIN s USING (pool_idx)")
def tanimoto_max(spark, d):
    """Every candidate against all candidates of one class."""
    fps = t.fingerprints(spark, d)
    out = si.max_tanimoto(fps, fps.filter("label = 0"), n_bits=t.EMBEDDING_BITS)
    return out.select("pool_idx", F.round("max_sim", 9).alias("max_sim"))


@query(TANIMOTO_SQL + " SELECT fps.pool_idx, round(coalesce(sim, 0), 9) AS max_sim FROM fps LEFT JOIN s USING (pool_idx)")
def tanimoto_join(spark, d):
    """The same figures by joins on rare bits, for any number of references."""
    fps = t.fingerprints(spark, d)
    return best_similarity(fps, fps.filter("label = 0"), n_bits=t.EMBEDDING_BITS).select("pool_idx", F.round("max_sim", 9).alias("max_sim"))


@query(TANIMOTO_SQL.replace("WHERE label = 0", "").replace("ON refs.r = b.pool_idx", "ON refs.r = b.pool_idx AND refs.r <> a.pool_idx") + " SELECT fps.pool_idx, round(coalesce(sim, 0), 9) AS max_sim FROM fps LEFT JOIN s USING (pool_idx)")
def tanimoto_library(spark, d):
    """Every candidate against the whole rest of the library."""
    fps = t.fingerprints(spark, d)
    return best_similarity(fps, fps, n_bits=t.EMBEDDING_BITS, apart=True).select("pool_idx", F.round("max_sim", 9).alias("max_sim"))


DENSE_SQL = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS e FROM embeddings),
 refs AS (SELECT vec_id AS r, e AS f FROM v WHERE label = 0),
 s AS (SELECT vec_id, max(list_dot_product(e, f) / (list_sum(e) + list_sum(f) - list_dot_product(e, f))) AS sim FROM v, refs GROUP BY vec_id)
SELECT vec_id AS pool_idx, round(sim, 6) AS max_sim FROM s"""


@query(DENSE_SQL)
def tanimoto_dense(spark, d):
    """Non-binary vectors."""
    v = t.fingerprints(spark, d).withColumn("fp", F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    return si.max_tanimoto(v, v.filter("label = 0"), dense=True).select("pool_idx", F.round("max_sim", 6).alias("max_sim"))


@query(f"""WITH {t.OBS}, {t.LEDGER} SELECT DISTINCT pool_idx FROM obs WHERE kind = 'experimental' AND job_id IN (SELECT job_id FROM ledger WHERE status IN ('RUNNING', 'SUBMITTED'))""")
def pending_set(spark, d):
    return jb.pending_set(t.observations(spark, d), t.ledger(spark, d))


@query("""SELECT p_partkey, p_retailprice, p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b
 WHERE b.p_retailprice >= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice > a.p_retailprice OR b.p_size > a.p_size))""")
def pareto_front(spark, d):
    return pa.pareto_front(t.table(spark, d, "part"), ["p_retailprice", "p_size"]).select("p_partkey", "p_retailprice", "p_size")


@query("""WITH v AS (SELECT *, -l_quantity AS few, -l_tax AS low FROM lineitem), g AS (SELECT few, low, l_discount, max(l_extendedprice) AS top FROM v GROUP BY ALL),
f AS (SELECT * FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.few >= a.few AND b.low >= a.low AND b.l_discount >= a.l_discount AND b.top >= a.top
 AND (b.few > a.few OR b.low > a.low OR b.l_discount > a.l_discount OR b.top > a.top)))
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, v.l_discount, l_tax FROM v JOIN f ON v.few = f.few AND v.low = f.low AND v.l_discount = f.l_discount AND l_extendedprice = top""")
def pareto_front_4d(spark, d):
    """Line items that no other beats in four objectives: few pieces, a high price, a large discount, a low tax."""
    items = use_all_cores(t.table(spark, d, "lineitem")).withColumn("few", -F.col("l_quantity")).withColumn("low", -F.col("l_tax"))
    front = pa.pareto_front(items, ["few", "l_extendedprice", "l_discount", "low"])
    return front.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("""WITH c AS (SELECT c_custkey, c_acctbal, c_nationkey, length(c_mktsegment) AS seg FROM customer)
SELECT c_custkey FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.c_acctbal >= a.c_acctbal AND b.c_nationkey <= a.c_nationkey AND b.seg >= a.seg
 AND (b.c_acctbal > a.c_acctbal OR b.c_nationkey < a.c_nationkey OR b.seg > a.seg))""")
def pareto_front_3d(spark, d):
    c = t.table(spark, d, "customer").withColumn("seg", F.length("c_mktsegment")).withColumn("low", -F.col("c_nationkey"))
    return pa.pareto_front(c, ["c_acctbal", "low", "seg"]).select("c_custkey")


JOB_STATS_SQL = f"""WITH {t.DEDUPED} SELECT job_id, count(*) FILTER (WHERE {t.CONTRIBUTES}) AS completed,
 count(*) FILTER (WHERE state = 'FAILED') AS failed, count(*) FILTER (WHERE state = 'QC_REJECTED') AS qc_rejected FROM deduped GROUP BY job_id"""


@query(JOB_STATS_SQL)
def job_stats(spark, d):
    obs = ob.dedupe(t.observations(spark, d), t.OBS_ORDER)
    return ob.outcome_counts(None, obs)


@query("""WITH new AS (SELECT o_orderkey AS job_id, o_custkey AS k FROM orders WHERE o_orderstatus <> 'F'), old AS (SELECT o_orderkey AS job_id, o_custkey AS k FROM orders WHERE o_orderstatus = 'F'),
f AS (SELECT k, min(job_id) AS j FROM new GROUP BY k), o AS (SELECT k, min(job_id) AS j FROM old GROUP BY k)
SELECT new.job_id, coalesce(o.j, f.j) AS assigned_job_id, o.j IS NULL AS is_new FROM new JOIN f USING (k) LEFT JOIN o USING (k)""")
def idempotent_submit(spark, d):
    o = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("idempotency_key"), "o_orderstatus")
    done = F.col("o_orderstatus") == "F"
    return jb.submit_once(o.filter(~done), o.filter(done), "job_id").select("job_id", "assigned_job_id", "is_new")


CACHE_SQL = f"""WITH {t.OBS}, k AS (SELECT DISTINCT job_id, item_id FROM obs), c AS (SELECT job_id, item_id, max(quantity) AS score FROM obs WHERE state = 'COMPLETED' GROUP BY ALL)
SELECT k.job_id, k.item_id, c.score, c.score IS NOT NULL AS cached FROM k LEFT JOIN c USING (job_id, item_id)"""


@query(CACHE_SQL)
def score_cache(spark, d):
    obs = t.observations(spark, d)
    requests = obs.select("job_id", "item_id").distinct()
    cache = obs.filter("state = 'COMPLETED'").groupBy("job_id", "item_id").agg(F.max("quantity").alias("score"))
    stored, todo = jb.with_score_cache(requests, cache)
    return stored.withColumn("cached", F.lit(True)).unionByName(
        todo.withColumn("score", F.lit(None).cast("double")).withColumn("cached", F.lit(False))
    )


# ---- aggregates ---------------------------------------------------------------------------------


@query(f"WITH {t.DEDUPED} SELECT item_id, pool_idx, quantity, price FROM deduped")
def dedupe_obs(spark, d):
    return ob.dedupe(t.observations(spark, d), t.OBS_ORDER).select("item_id", "pool_idx", "quantity", "price")


@query("""SELECT user_id || ':' || event_type || ':experimental' AS key, min(value) AS first_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS rn FROM events) WHERE rn = 1 GROUP BY ALL""")
def dedupe_without_ids(spark, d):
    """Events without item ids: candidate, state and kind make the key."""
    ev = t.events(spark, d).withColumn("item_id", F.lit("")).withColumn("state", F.col("event_type"))
    first = ob.dedupe(ev, ["ts"])
    return first.select(F.concat_ws(":", F.col("pool_idx").cast("string"), "state", "kind").alias("key"), F.col("value").alias("first_value"))


AGG_SQL = f"""WITH {t.DEDUPED}, s AS (SELECT pool_idx, count(*) AS n, avg(v) AS mean, median(v) AS med, stddev_pop(v) AS sd,
 max(ts) AS ts, arg_min(smiles, struct_pack(a := ts, b := quantity, c := price)) AS smiles FROM deduped WHERE {t.CONTRIBUTES} GROUP BY pool_idx)"""


def _stats(spark, d, method):
    stats = ob.replicate_stats(ob.dedupe(t.observations(spark, d), t.OBS_ORDER), 1, t.OBS_ORDER, method)
    return stats.select("pool_idx", "n", F.round("agg0", 6).alias("agg0"), F.round("std0", 6).alias("std0"), F.year("ts").alias("last_year"), "smiles", "item_id")


@query(AGG_SQL + " SELECT pool_idx, n, round(mean, 6) AS agg0, round(sd, 6) AS std0, year(ts) AS last_year, smiles, 'agg:' || pool_idx || ':n' || n AS item_id FROM s")
def agg_mean(spark, d):
    return _stats(spark, d, "mean")


@query(AGG_SQL + " SELECT pool_idx, n, round(med, 6) AS agg0, round(sd, 6) AS std0, year(ts) AS last_year, smiles, 'agg:' || pool_idx || ':n' || n AS item_id FROM s")
def agg_median(spark, d):
    return _stats(spark, d, "median")


@query(AGG_SQL + " SELECT pool_idx, n, round(sd, 6) AS std0, n >= 2 AND sd > 14 * (1 + 1e-12::DOUBLE) AS rejected FROM s")
def agg_qc(spark, d):
    stats = ob.replicate_stats(ob.dedupe(t.observations(spark, d), t.OBS_ORDER), 1, t.OBS_ORDER)
    good, bad = ob.split_labels(stats, 14.0)
    cols = ["pool_idx", "n", F.round("std0", 6).alias("std0")]
    return good.select(*cols, F.lit(False).alias("rejected")).unionByName(bad.select(*cols, F.lit(True).alias("rejected")))


@query(f"WITH {t.DEDUPED}, s AS (SELECT pool_idx, count(*) AS n FROM deduped WHERE {t.CONTRIBUTES} GROUP BY pool_idx) SELECT item_id, pool_idx, 'agg:' || pool_idx || ':n' || n AS label_id FROM deduped JOIN s USING (pool_idx) WHERE {t.CONTRIBUTES}")
def label_items(spark, d):
    first = ob.dedupe(t.observations(spark, d), t.OBS_ORDER)
    return ob.label_items(first, ob.replicate_stats(first, 1, t.OBS_ORDER))


@query(f"""WITH {t.OBS} SELECT count(*) AS n_new FROM (SELECT DISTINCT pool_idx FROM obs WHERE {t.CONTRIBUTES})
 WHERE pool_idx NOT IN (SELECT pool_idx FROM obs WHERE {t.CONTRIBUTES} AND ts < TIMESTAMP '1998-01-01')""")
def newly_labelled(spark, d):
    ok = ob.contributing(t.observations(spark, d))
    before = ok.filter(F.col("ts") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return ob.newly_labelled(before, ok).agg(F.count_distinct("pool_idx").alias("n_new"))


@query("""SELECT round(min(p_retailprice) - 0.05::DOUBLE * (max(p_retailprice) - min(p_retailprice)), 6) AS p_retailprice,
 round(min(p_size) - 0.05::DOUBLE * (max(p_size) - min(p_size)), 6) AS p_size FROM part""")
def ref_point(spark, d):
    r = pa.reference_point(t.table(spark, d, "part"), ["p_retailprice", "p_size"])
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query("""WITH r AS (SELECT p_retailprice AS x, p_size::DOUBLE AS y FROM part WHERE p_retailprice > 905 AND p_size > 5),
g AS (SELECT x, max(y) AS y FROM r GROUP BY x), h AS (SELECT x, max(y) OVER (ORDER BY x DESC) AS top, lead(x, 1, 905.0::DOUBLE) OVER (ORDER BY x DESC) AS nx FROM g)
SELECT round(sum((x - nx) * (top - 5)), 5) AS hypervolume FROM h""")
def hypervolume_2d(spark, d):
    hv = pa.hypervolume_2d(t.table(spark, d, "part"), "p_retailprice", "p_size", (905.0, 5.0))
    return hv.select(F.round("hypervolume", 5).alias("hypervolume"))


@query("""WITH p AS (SELECT DISTINCT c_acctbal AS x, c_nationkey::DOUBLE AS y, length(c_mktsegment)::DOUBLE AS z FROM customer WHERE c_acctbal > 0 AND c_nationkey > 1 AND length(c_mktsegment) > 5),
zs AS (SELECT z, z - lag(z, 1, 5.0::DOUBLE) OVER (ORDER BY z) AS dz FROM (SELECT DISTINCT z FROM p)),
g AS (SELECT zs.z, dz, p.x, max(p.y) AS y FROM zs JOIN p ON p.z >= zs.z GROUP BY zs.z, dz, p.x),
h AS (SELECT z, dz, x, max(y) OVER (PARTITION BY z ORDER BY x DESC) AS top, lead(x, 1, 0.0::DOUBLE) OVER (PARTITION BY z ORDER BY x DESC) AS nx FROM g)
SELECT round(sum(dz * (x - nx) * (top - 1)), 4) AS hypervolume FROM h""")
def hypervolume_3d(spark, d):
    c = t.table(spark, d, "customer").withColumn("seg", F.length("c_mktsegment").cast("double"))
    hv = pa.hypervolume(c, ["c_acctbal", "c_nationkey", "seg"], [0.0, 1.0, 5.0])
    return hv.select(F.round("hypervolume", 4).alias("hypervolume"))


HITS = f"""{t.TRUTH}, {t.LABELLED}, n AS (SELECT count(*) AS n FROM truth),
ranked AS (SELECT pool_idx, activity, row_number() OVER (ORDER BY activity DESC, pool_idx) - 1 AS r FROM truth),
hits AS (SELECT pool_idx, activity, r FROM ranked, n WHERE r < greatest(1, ceil(0.01::DOUBLE * n))), found AS (SELECT * FROM hits WHERE pool_idx IN (SELECT pool_idx FROM labelled))"""


@query(f"WITH {HITS} SELECT (SELECT count(*) FROM hits) AS n_hits, (SELECT count(*) FROM found) AS n_found, round((SELECT count(*) FROM found) / (SELECT count(*) FROM hits)::DOUBLE, 9) AS recall")
def hit_recall(spark, d):
    hits = me.top_fraction(t.truth(spark, d), "activity", 0.01)
    return me.hit_recall(t.labelled(spark, d), hits).withColumn("recall", F.round("recall", 9))


@query(f"""WITH {HITS}, c AS (SELECT (SELECT count(*) FROM labelled) AS n_labeled, (SELECT count(*) FROM hits) AS n_hits, (SELECT count(*) FROM found) AS n_found, n FROM n)
SELECT n_labeled, n_hits, n_found, round((n_found / n_labeled::DOUBLE) / (n_hits / n::DOUBLE), 9) AS ef FROM c""")
def enrichment_factor(spark, d):
    truth = t.truth(spark, d)
    hits = me.top_fraction(truth, "activity", 0.01)
    return me.enrichment_factor(t.labelled(spark, d), hits, truth.count()).withColumn("ef", F.round("ef", 9))


@query(f"""WITH {HITS}, c AS (SELECT count(*) AS k FROM found)
SELECT round(least(1.0::DOUBLE, sum(exp(-20.0::DOUBLE * (r + 1) / n)) / (SELECT sum(exp(-20.0::DOUBLE * i / n)) FROM range(1, (SELECT k FROM c) + 1) x(i), n)), 9) AS bedroc FROM found, n""")
def bedroc_ranks(spark, d):
    truth = t.truth(spark, d)
    ranks = me.hit_ranks(truth, "activity", 0.01).join(t.labelled(spark, d).select("pool_idx"), "pool_idx", "left_semi")
    return me.bedroc_of_ranks(ranks, truth.count()).select(F.round("bedroc", 9).alias("bedroc"))


@query(f"""WITH {HITS}, c AS (SELECT count(*) AS k FROM hits)
SELECT round(least(1.0::DOUBLE, sum(exp(-20.0::DOUBLE * (r + 1) / n)) / (SELECT sum(exp(-20.0::DOUBLE * i / n)) FROM range(1, (SELECT k FROM c) + 1) x(i), n)), 9) AS bedroc FROM found, n""")
def bedroc_truth(spark, d):
    return me.bedroc_against_truth(t.truth(spark, d), t.labelled(spark, d), "activity").select(F.round("bedroc", 9).alias("bedroc"))


REPORT_SQL = f"""WITH {HITS}, lab AS (SELECT t.* FROM truth t JOIN labelled USING (pool_idx)),
lim AS (SELECT min(activity) - 0.05::DOUBLE * (max(activity) - min(activity)) AS rx, min(qed) - 0.05::DOUBLE * (max(qed) - min(qed)) AS ry FROM truth),
front AS (SELECT pool_idx FROM truth a WHERE NOT EXISTS (SELECT 1 FROM truth b WHERE b.activity >= a.activity AND b.qed >= a.qed AND (b.activity > a.activity OR b.qed > a.qed))),
ga AS (SELECT activity AS x, max(qed) AS y FROM truth GROUP BY 1), gl AS (SELECT activity AS x, max(qed) AS y FROM lab GROUP BY 1),
ha AS (SELECT x, max(y) OVER w AS top, lead(x) OVER w AS nx FROM ga WINDOW w AS (ORDER BY x DESC)), hl AS (SELECT x, max(y) OVER w AS top, lead(x) OVER w AS nx FROM gl WINDOW w AS (ORDER BY x DESC)),
va AS (SELECT sum((x - coalesce(nx, rx)) * (top - ry)) AS v FROM ha, lim), vl AS (SELECT sum((x - coalesce(nx, rx)) * (top - ry)) AS v FROM hl, lim),
k AS (SELECT greatest(1, ceil(0.01::DOUBLE * n)) AS k1, greatest(1, ceil(0.001::DOUBLE * n)) AS k01, n FROM n)
SELECT (SELECT count(*) FROM lab) AS n_labeled, round((SELECT avg(activity) FROM lab), 6) AS mean_activity,
 round((SELECT count(*) FROM found, k WHERE r < k01) / k01, 9) AS top01_recall, round((SELECT count(*) FROM found) / k1, 9) AS top1_recall,
 round(((SELECT count(*) FROM found) / (SELECT count(*) FROM lab)::DOUBLE) / (k1 / n), 9) AS ef_top1,
 round((SELECT coalesce(sum(exp(-20.0::DOUBLE * (r + 1) / n)), 0) FROM found) / (SELECT sum(exp(-20.0::DOUBLE * i / n)) FROM range(1, k1::BIGINT + 1) x(i)), 9) AS bedroc,
 (SELECT count(*) FROM found) AS n_hits_top1, round((SELECT v FROM vl) / (SELECT v FROM va), 9) AS hv_frac,
 round((SELECT count(*) FROM front JOIN lab USING (pool_idx)) / (SELECT count(*) FROM front)::DOUBLE, 9) AS pareto_recall, round((SELECT v FROM va), 5) AS global_hv FROM k"""


@query(REPORT_SQL)
def benchmark_report(spark, d):
    """All figures of a labelled set against the whole truth, two objectives."""
    r = me.report(t.truth(spark, d), t.labelled(spark, d), ["activity", "qed"])
    digits = {"mean_activity": 6, "global_hv": 5}
    return r.select(*[F.round(c, digits.get(c, 9)).alias(c) if ty == "double" else c for c, ty in r.dtypes])


@query("""SELECT o_orderpriority AS campaign_id, count(*) FILTER (WHERE o_orderstatus IN ('P', 'O')) AS n_inflight FROM orders GROUP BY 1""")
def inflight_count(spark, d):
    state = t.ledger(spark, d).select("campaign_id", F.col("status").alias("phase"))
    return jb.inflight_counts(state, ["campaign_id"])


@query(f"WITH {t.LEDGER} SELECT job_id, campaign_id FROM ledger WHERE status <> 'DONE'")
def open_jobs(spark, d):
    return jb.open_jobs(t.ledger(spark, d)).select("job_id", "campaign_id")


PROGRESS = f"WITH {t.OBS}, i AS (SELECT DISTINCT job_id, item_id FROM obs), h AS (SELECT DISTINCT item_id FROM obs WHERE state <> 'QC_REJECTED')"


@query(PROGRESS + " SELECT job_id, count(*) AS n_items, count(*) FILTER (WHERE h.item_id IS NULL) AS n_pending, count(*) FILTER (WHERE h.item_id IS NULL) = 0 AS done FROM i LEFT JOIN h USING (item_id) GROUP BY job_id")
def job_progress(spark, d):
    obs = t.observations(spark, d)
    return jb.job_progress(obs, obs.filter("state <> 'QC_REJECTED'"))


@query(f"""WITH {t.OBS}, h AS (SELECT DISTINCT item_id FROM obs WHERE state = 'COMPLETED') SELECT job_id, item_id, pool_idx, kind, 'CANCELLED' AS state,
 false AS qc_passed, 'cancel' AS source, 'cancelled' AS message FROM obs WHERE item_id NOT IN (SELECT item_id FROM h)""")
def cancel_rows(spark, d):
    obs = t.observations(spark, d)
    return jb.cancel_rows(obs, obs.filter("state = 'COMPLETED'"))


@query("""WITH a AS (SELECT min(p_retailprice) AS d0, max(p_retailprice) AS d1, min(p_size) / 50.0::DOUBLE AS q0, max(p_size) / 50.0::DOUBLE AS q1, min(p_size)::DOUBLE AS s0, max(p_size)::DOUBLE AS s1 FROM part)
SELECT 'dock' AS name, d0 AS lo, d1 AS hi FROM a UNION ALL SELECT 'qed', q0, q1 FROM a UNION ALL SELECT 'sa', s0, s1 FROM a""")
def label_summary(spark, d):
    return me.value_ranges(t.raw_labels(spark, d), ["dock", "qed", "sa"])


@query("""WITH runs AS (SELECT o_orderpriority AS strategy, year(o_orderdate) AS round, o_totalprice AS m FROM orders)
SELECT strategy, round, count(*) AS n_seeds, round(avg(m), 4) AS m_mean, round(stddev_pop(m), 4) AS m_std FROM runs GROUP BY ALL""")
def seed_summary(spark, d):
    runs = t.table(spark, d, "orders").select(F.col("o_orderpriority").alias("strategy"), F.year("o_orderdate").alias("round"), F.col("o_totalprice").alias("m"))
    out = me.seed_summary(runs, ["m"])
    return out.select("strategy", "round", "n_seeds", F.round("m_mean", 4).alias("m_mean"), F.round("m_std", 4).alias("m_std"))


@query("""WITH r AS (SELECT o_custkey AS c, CASE o_orderstatus WHEN 'F' THEN 'serial' ELSE 'parallel' END AS mode, o_orderkey AS run, o_totalprice AS wall FROM orders),
b AS (SELECT c, max(wall) AS w FROM r WHERE mode = 'serial' GROUP BY c) SELECT run, mode, round(w / wall, 9) AS speedup FROM r JOIN b USING (c)""")
def speedup(spark, d):
    runs = t.table(spark, d, "orders").select(
        F.col("o_custkey").alias("c"), F.when(F.col("o_orderstatus") == "F", F.lit("serial")).otherwise(F.lit("parallel")).alias("mode"),
        F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("wall"),
    )
    return me.speedup(runs, ["c"]).select("run", "mode", F.round("speedup", 9).alias("speedup"))


@query(f"""WITH {HITS}, o AS (SELECT pool_idx, row_number() OVER (ORDER BY ts, pool_idx) AS n FROM labelled),
f AS (SELECT n, row_number() OVER (ORDER BY n) AS k FROM o WHERE pool_idx IN (SELECT pool_idx FROM hits))
SELECT min(n) AS budget FROM f WHERE k >= 0.2::DOUBLE * (SELECT count(*) FROM hits)""")
def budget_to_recall(spark, d):
    """Labels in time order; the place in that order is the only sort key needed."""
    done = t.labelled(spark, d).withColumn("at", F.col("ts") * F.lit(1 << 32) + F.col("pool_idx"))
    hits = me.top_fraction(t.truth(spark, d), "activity", 0.01)
    return me.budget_to_recall(done, hits, 0.2, "at")


@query(f"""WITH {t.DEDUPED}, {t.LEDGER}, it AS (SELECT d.*, campaign_id, l.round FROM deduped d JOIN ledger l USING (job_id)),
f AS (SELECT campaign_id, pool_idx, min(round) AS round FROM it WHERE {t.CONTRIBUTES} GROUP BY ALL), g AS (SELECT campaign_id, round, count(*) AS g FROM f GROUP BY ALL),
s AS (SELECT campaign_id, round, count(*) AS submitted, count(*) FILTER (WHERE {t.CONTRIBUTES}) AS completed, count(*) FILTER (WHERE state = 'FAILED') AS failed, count(*) FILTER (WHERE state = 'QC_REJECTED') AS qc_rejected FROM it GROUP BY ALL)
SELECT s.*, sum(coalesce(g, 0)) OVER (PARTITION BY campaign_id ORDER BY round)::BIGINT AS n_labeled FROM s LEFT JOIN g USING (campaign_id, round)""")
def round_history(spark, d):
    led = t.ledger(spark, d).select("job_id", "campaign_id", "round")
    obs = ob.dedupe(t.observations(spark, d).drop("smiles", "compound_id"), t.OBS_ORDER)
    # wanted three times below: de-duplicated once
    items = cut_lineage(obs.join(led, "job_id").drop("ts", "quantity", "price"))
    outcomes = ob.outcome_counts(items, items).join(led, "job_id")
    return me.round_history(ob.contributing(items), items, outcomes)


@query(f"WITH {HITS} SELECT pool_idx FROM found")
def set_intersect(spark, d):
    hits = me.top_fraction(t.truth(spark, d), "activity", 0.01)
    return t.labelled(spark, d).select("pool_idx").intersect(hits.select("pool_idx"))


@query(f"WITH {t.LABELLED}, {t.CANDIDATES} SELECT pool_idx, pool_idx IN (SELECT pool_idx FROM labelled) AS labelled FROM candidates")
def labelled_mask(spark, d):
    return ob.labelled_mask(t.candidates(spark, d), t.labelled(spark, d)).select("pool_idx", "labelled")


@query("""WITH n AS (SELECT count(*) AS n FROM lineitem), r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey * 8 + l_linenumber) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM r, n WHERE rn <= ceil(0.3::DOUBLE * n)""")
def top_fraction(spark, d):
    """A long top list by exact cut: no sort, no gathering."""
    from pickwise.operators.scale import top_k

    li = t.table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    k = me.top_count(li.count(), 0.3)
    return top_k(li, "l_extendedprice", k, tie="id", limit=1000).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT round(quantile_cont(l_extendedprice, 0.1), 6) AS q10, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.999), 6) AS q999 FROM lineitem")
def exact_quantiles(spark, d):
    """Quantiles by binned order statistics, as for a column too large for one aggregate."""
    from pickwise.operators.scale import quantiles

    q = quantiles(t.table(spark, d, "lineitem"), "l_extendedprice", [0.1, 0.5, 0.999], small=0)
    return spark.range(1).select(*[F.round(F.lit(v), 6).alias(n) for n, v in zip(("q10", "q50", "q999"), q)])
