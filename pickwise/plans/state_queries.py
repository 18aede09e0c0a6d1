"""Queries over lifecycles, ledgers, gates and plates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pickwise.functions.states import available as is_available
from pickwise.operators import jobs as jb
from pickwise.operators import lifecycle as lc
from pickwise.operators import observations as ob
from pickwise.operators import plates as pl
from pickwise.plans import tables as t
from pickwise.plans.registry import query

START = "{'p': 'AVAILABLE', 'j': NULL::VARCHAR, 'f': 0, 'q': 0}"
# one event on one state, for result events only
STEP_OBS = """CASE e.state
 WHEN 'CANCELLED' THEN {'p': 'AVAILABLE', 'j': NULL::VARCHAR, 'f': s.f, 'q': s.q}
 WHEN 'FAILED' THEN {'p': CASE WHEN s.f + 1 <= 1 THEN 'RETRYABLE' ELSE 'FAILED' END, 'j': s.j, 'f': s.f + 1, 'q': s.q}
 WHEN 'QC_REJECTED' THEN {'p': CASE WHEN s.q + 1 <= 1 THEN 'RETRYABLE' ELSE 'QC_REJECTED' END, 'j': s.j, 'f': s.f, 'q': s.q + 1}
 WHEN 'COMPLETED' THEN {'p': CASE WHEN s.p = 'CONTROL' THEN s.p ELSE 'RUNNING' END, 'j': s.j, 'f': s.f, 'q': s.q}
 WHEN 'RUNNING' THEN {'p': 'RUNNING', 'j': s.j, 'f': s.f, 'q': s.q}
 ELSE s END"""
FOLD_SQL = f"""WITH {t.EVENTS}, g AS (SELECT pool_idx, list({{'state': state}} ORDER BY ord) AS es FROM ev GROUP BY pool_idx),
fold AS (SELECT pool_idx, list_reduce(es, lambda s, e: {STEP_OBS}, {START}) AS r FROM g),
state AS (SELECT pool_idx, r.p AS phase, r.f AS fail_retries, r.q AS qc_retries FROM fold)"""


@query("""WITH e AS (SELECT user_id AS pool_idx, event_type, epoch_us(ts) AS ord, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
c AS (SELECT pool_idx, count(*) FILTER (WHERE event_type = 'error') AS f, count(*) FILTER (WHERE event_type = 'signup') AS q, arg_max(event_type, ord) AS last FROM e GROUP BY pool_idx)
SELECT pool_idx, CASE last WHEN 'purchase' THEN 'RUNNING' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'AVAILABLE'
 WHEN 'error' THEN CASE WHEN f <= 1 THEN 'RETRYABLE' ELSE 'FAILED' END ELSE CASE WHEN q <= 1 THEN 'RETRYABLE' ELSE 'QC_REJECTED' END END AS phase,
 f::INT AS fail_retries, q::INT AS qc_retries FROM c""", name="candidate_phases")
def candidate_phases(spark, d):
    """Phases from result events, checked by a second formulation."""
    return lc.observation_phases(t.events(spark, d), "ord")


MIXED_EVENTS = """mixed AS (SELECT user_id AS pool_idx, epoch_us(ts) AS ord, CASE WHEN value < 0.3 THEN 'positive' WHEN value < 5 THEN 'replicate' ELSE 'experimental' END AS kind,
  CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'QC_REJECTED' WHEN 'view' THEN CASE WHEN value < 12 THEN 'RUNNING' ELSE 'SUBMITTED' END ELSE 'CANCELLED' END AS state FROM events)"""


def _mixed(spark, d):
    """Result events of all kinds."""
    ev = t.events(spark, d)
    kind = F.when(F.col("value") < 0.3, F.lit("positive")).when(F.col("value") < 5, F.lit("replicate")).otherwise(F.lit("experimental"))
    state = F.when((F.col("event_type") == "view") & (F.col("value") >= 12), F.lit("SUBMITTED")).otherwise(F.col("state"))
    return ev.withColumn("kind", kind).withColumn("state", state)


STEP_MIXED = f"""CASE WHEN e.kind = 'positive' THEN {{'p': 'CONTROL', 'j': s.j, 'f': s.f, 'q': s.q}}
 WHEN e.kind = 'replicate' THEN CASE WHEN e.state = 'RUNNING' AND s.p IN ('SELECTED', 'SUBMITTED') THEN {{'p': 'RUNNING', 'j': s.j, 'f': s.f, 'q': s.q}} ELSE s END
 WHEN e.state = 'SUBMITTED' THEN {{'p': 'SUBMITTED', 'j': s.j, 'f': s.f, 'q': s.q}}
 ELSE {STEP_OBS} END"""


@query(f"""WITH {MIXED_EVENTS}, g AS (SELECT pool_idx, list({{'kind': kind, 'state': state}} ORDER BY ord) AS es FROM mixed GROUP BY pool_idx),
fold AS (SELECT pool_idx, list_reduce(es, lambda s, e: {STEP_MIXED}, {START}) AS r FROM g)
SELECT pool_idx, r.p AS phase, r.f AS fail_retries, r.q AS qc_retries FROM fold""")
def candidate_fold(spark, d):
    """Lifecycle of every candidate from result events of all kinds, as one grouped aggregate."""
    return lc.observation_phases(_mixed(spark, d), "ord")


MARK_OPS = """CASE event_type WHEN 'signup' THEN 'SELECTED' WHEN 'view' THEN 'SUBMITTED' WHEN 'click' THEN 'RUNNING'
 WHEN 'purchase' THEN CASE WHEN value > 20 THEN 'LABELED' WHEN value > 10 THEN 'STOCKOUT' ELSE 'OBS_MEASURED' END
 ELSE CASE WHEN value > 15 THEN 'OBS_FAILED' WHEN value > 9 THEN 'OBS_QC_REJECTED' WHEN value > 1 THEN 'OBS_CANCELLED' ELSE 'CONTROL' END END"""
JOB = "('J' || (json_extract_string(props, '$.k')::BIGINT // 25))"


def _marks(spark, d, release: bool):
    ev = t.events(spark, d)
    kind, v = F.col("event_type"), F.col("value")
    done = F.when(v > 20, F.lit("LABELED")).when(v > 10, F.lit("STOCKOUT")).otherwise(F.lit("OBS_MEASURED"))
    bad = F.when(v > 15, F.lit("OBS_FAILED")).when(v > 9, F.lit("OBS_QC_REJECTED")).when(v > 1, F.lit("OBS_CANCELLED")).otherwise(F.lit("CONTROL"))
    op = (
        F.when(kind == "signup", F.lit("SELECTED")).when(kind == "view", F.lit("SUBMITTED")).when(kind == "click", F.lit("RUNNING"))
        .when(kind == "purchase", done).otherwise(bad)
    )
    if release:
        op = F.when(kind == "purchase", F.lit("RELEASE")).otherwise(op)
    job = F.concat(F.lit("J"), F.floor(F.get_json_object("props", "$.k").cast("bigint") / 25).cast("string"))
    return ev.select("pool_idx", "ord", op.alias("op"), job.alias("job_id"))


def _s(p: str, j: str = "s.j", f: str = "s.f", q: str = "s.q") -> str:
    return f"{{'p': {p}, 'j': {j}, 'f': {f}, 'q': {q}}}"


STEP_MARKS = f"""CASE
 WHEN e.op IN ('CONTROL', 'LABELED') THEN {_s('e.op')}
 WHEN e.op = 'SUBMITTED' THEN {_s("'SUBMITTED'", 'e.job')}
 WHEN e.op = 'STOCKOUT' THEN {_s("CASE WHEN s.p = 'AVAILABLE' THEN 'STOCKOUT' ELSE s.p END")}
 WHEN e.op = 'SELECTED' THEN CASE WHEN s.p IN ('AVAILABLE', 'RETRYABLE') THEN {_s("'SELECTED'", 'e.job')} ELSE s END
 WHEN e.op = 'RUNNING' THEN {_s("CASE WHEN s.p IN ('SELECTED', 'SUBMITTED') THEN 'RUNNING' ELSE s.p END")}
 WHEN e.op = 'RELEASE' THEN CASE WHEN s.p IN ('SELECTED', 'SUBMITTED', 'RUNNING') AND (s.j IS NULL OR s.j = e.job) THEN {_s("'AVAILABLE'", 'NULL::VARCHAR')} ELSE s END
 WHEN s.p = 'LABELED' THEN s
 WHEN e.op = 'OBS_CANCELLED' THEN {_s("'AVAILABLE'", 'NULL::VARCHAR')}
 WHEN e.op = 'OBS_FAILED' THEN CASE WHEN s.f + 1 <= 1 THEN {_s("'RETRYABLE'", 'NULL::VARCHAR', 's.f + 1')} ELSE {_s("'FAILED'", f='s.f + 1')} END
 WHEN e.op = 'OBS_QC_REJECTED' THEN CASE WHEN s.q + 1 <= 1 THEN {_s("'RETRYABLE'", 'NULL::VARCHAR', q='s.q + 1')} ELSE {_s("'QC_REJECTED'", q='s.q + 1')} END
 ELSE {_s("CASE WHEN s.p = 'CONTROL' THEN s.p ELSE 'RUNNING' END")} END"""


def _marks_sql(op: str) -> str:
    return f"""WITH e AS (SELECT user_id AS pool_idx, epoch_us(ts) AS ord, {op} AS op, {JOB} AS job FROM events),
g AS (SELECT pool_idx, list({{'op': op, 'job': job}} ORDER BY ord) AS es FROM e GROUP BY pool_idx),
fold AS (SELECT pool_idx, list_reduce(es, lambda s, e: {STEP_MARKS}, {START}) AS r FROM g)
SELECT pool_idx, r.p AS phase, coalesce(r.j, '-') AS job_id, r.f AS fail_retries, r.q AS qc_retries FROM fold"""


@query(_marks_sql(MARK_OPS))
def candidate_marks(spark, d):
    """Marks mixed with results."""
    return lc.fold_events(_marks(spark, d, False), "ord").withColumn("job_id", F.coalesce("job_id", F.lit("-")))


@query(_marks_sql(f"CASE WHEN event_type = 'purchase' THEN 'RELEASE' ELSE {MARK_OPS} END"))
def candidate_release(spark, d):
    """Releases take effect only for the job that holds the candidate."""
    return lc.fold_events(_marks(spark, d, True), "ord").withColumn("job_id", F.coalesce("job_id", F.lit("-")))


SYNC_SQL = FOLD_SQL + """, l AS (SELECT user_id AS pool_idx, stddev_pop(value) AS sd, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1),
lab AS (SELECT pool_idx FROM l WHERE NOT (n >= 2 AND sd > 10 * (1 + 1e-12::DOUBLE))), bad AS (SELECT pool_idx FROM l WHERE n >= 2 AND sd > 10 * (1 + 1e-12::DOUBLE)),
m AS (SELECT state.*, pool_idx IN (SELECT pool_idx FROM lab) AS is_lab, pool_idx IN (SELECT pool_idx FROM bad) AND phase NOT IN ('LABELED', 'QC_REJECTED', 'DEAD_LETTER', 'RETRYABLE', 'FAILED', 'CONTROL') AS is_bad FROM state)
SELECT pool_idx, CASE WHEN is_lab THEN 'LABELED' WHEN is_bad THEN CASE WHEN qc_retries + 1 <= 1 THEN 'RETRYABLE' ELSE 'QC_REJECTED' END ELSE phase END AS phase,
 fail_retries, CASE WHEN is_bad AND NOT is_lab THEN qc_retries + 1 ELSE qc_retries END AS qc_retries FROM m"""


@query(SYNC_SQL)
def candidate_sync(spark, d):
    ev = t.events(spark, d).withColumn("smiles", F.lit("")).withColumn("compound_id", F.lit(""))
    labels, bad = ob.split_labels(ob.replicate_stats(ev, 1, ["ord"]), 10.0)
    return lc.sync_labels(lc.observation_phases(ev, "ord"), labels, bad)


@query(FOLD_SQL + " SELECT pool_idx, phase FROM state WHERE phase NOT IN ('SELECTED', 'SUBMITTED', 'RUNNING', 'LABELED', 'FAILED', 'QC_REJECTED', 'DEAD_LETTER', 'CONTROL', 'STOCKOUT')")
def available(spark, d):
    return lc.observation_phases(t.events(spark, d), "ord").filter(is_available()).select("pool_idx", "phase")


@query(FOLD_SQL + " SELECT count(*) FILTER (WHERE phase IN ('SELECTED', 'SUBMITTED', 'RUNNING')) AS n_inflight FROM state")
def inflight(spark, d):
    return jb.inflight_counts(lc.observation_phases(t.events(spark, d), "ord"))


@query(f"""WITH {t.OBS}, seen AS (SELECT DISTINCT job_id, item_id FROM obs WHERE ts < TIMESTAMP '1998-01-01')
SELECT item_id, job_id, state, price FROM obs WHERE state IN ('COMPLETED', 'FAILED') AND (job_id, item_id) NOT IN (SELECT (job_id, item_id) FROM seen)""".replace("(job_id, item_id) NOT IN (SELECT (job_id, item_id) FROM seen)", "NOT EXISTS (SELECT 1 FROM seen WHERE seen.job_id = obs.job_id AND seen.item_id = obs.item_id)"))
def new_terminal(spark, d):
    """Results still running do not count as reported."""
    obs = t.observations(spark, d).withColumn("state", F.when(F.col("state") == "QC_REJECTED", F.lit("RUNNING")).otherwise(F.col("state")))
    seen = obs.filter(F.col("ts") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return jb.new_terminal(obs, seen).select("item_id", "job_id", "state", "price")


SCORED = """sc AS (SELECT l_orderkey AS job_id, l_linenumber AS line, l_partkey AS part, l_extendedprice AS price, CASE WHEN l_tax > 0.07 THEN 'blank' ELSE 'experimental' END AS kind,
 CASE WHEN l_discount > 0.08 THEN -1 ELSE l_partkey END AS pool_idx, CASE WHEN l_quantity > 10 THEN -l_quantity / 5.0::DOUBLE END AS score,
 CASE WHEN l_quantity > 10 THEN 'ok' WHEN l_quantity > 7 THEN 'timeout' WHEN l_quantity > 4 THEN '' ELSE 'embed failed' END AS message, l_linenumber - 1 AS attempts FROM lineitem)"""


def _scored(spark, d):
    q = F.col("l_quantity")
    return t.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_tax") > 0.07, F.lit("blank")).otherwise(F.lit("experimental")).alias("kind"),
        F.when(F.col("l_discount") > 0.08, F.lit(-1).cast("bigint")).otherwise(F.col("l_partkey")).alias("pool_idx"),
        F.when(q > 10, -q / 5.0).alias("score"),
        F.when(q > 10, F.lit("ok")).when(q > 7, F.lit("timeout")).when(q > 4, F.lit("")).otherwise(F.lit("embed failed")).alias("message"),
        (F.col("l_linenumber") - 1).alias("attempts"),
    )


@query(f"""WITH {SCORED} SELECT job_id, line, part, price, CASE WHEN b THEN 'COMPLETED' WHEN t THEN 'TIMEOUT' WHEN n THEN 'FAILED' ELSE 'COMPLETED' END AS task_state,
 CASE WHEN b OR NOT (t OR n) THEN 'COMPLETED' ELSE 'FAILED' END AS state, NOT (b OR t OR n) AS qc_passed, CASE WHEN NOT (b OR t OR n) THEN -score END AS activity,
 CASE WHEN b THEN 'blank' WHEN t THEN 'evaluation timeout' WHEN n THEN CASE WHEN message = '' THEN 'evaluation failed' ELSE message END ELSE 'ok' END AS message
FROM (SELECT *, kind = 'blank' OR pool_idx < 0 AS b, message = 'timeout' AS t, score IS NULL AS n FROM sc)""")
def classify_results(spark, d):
    return jb.classify(_scored(spark, d)).select("job_id", "line", "part", "price", "task_state", "state", "qc_passed", "activity", "message")


@query(f"WITH {SCORED} SELECT job_id, line, part, price FROM sc WHERE score IS NULL AND message <> 'timeout' AND attempts <= 1")
def retry_eligible(spark, d):
    return _scored(spark, d).filter(jb.retry_eligible(1)).select("job_id", "line", "part", "price")


@query(f"WITH {SCORED} SELECT job_id, line, part, price FROM sc WHERE kind IN ('experimental', 'replicate') AND pool_idx >= 0")
def job_candidates(spark, d):
    return jb.job_candidates(_scored(spark, d)).select("job_id", "line", "part", "price")


@query(f"""WITH {t.LEDGER} SELECT campaign_id, count(*) FILTER (WHERE acquisition <> 'init' AND status = 'DONE') AS completed_rounds,
 count(*) FILTER (WHERE acquisition <> 'init' AND status <> 'DONE') AS inflight_rounds, count(*) FILTER (WHERE acquisition = 'init' AND status <> 'DONE') AS open_init,
 count(*) FILTER (WHERE acquisition <> 'init') < 2700 AS may_submit FROM ledger GROUP BY 1""")
def round_gate(spark, d):
    return jb.round_gate(t.ledger(spark, d), 2700)


@query("""SELECT o_custkey AS owner, arg_max(o_orderkey, o_orderdate::DATE::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS job_id, arg_max(o_orderstatus, o_orderdate::DATE::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS status FROM orders GROUP BY 1""")
def ledger_latest(spark, d):
    """Latest ledger row per owner."""
    o = t.table(spark, d, "orders")
    order = F.concat(F.to_date("o_orderdate").cast("string"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    rows = o.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), order.alias("at"))
    return jb.latest(rows, "owner", "at").select("owner", "job_id", "status")


OUTCOME = "CASE WHEN event_type = 'purchase' AND value > 40 THEN 'DONE' WHEN event_type = 'signup' AND value > 24 THEN 'LOST' WHEN event_type IN ('view', 'click') AND value > 12 THEN 'RUNNING' ELSE 'ERROR' END"
STEP_POLL = """CASE WHEN s.st IN ('DONE', 'FAILED') THEN s
 WHEN e.o = 'DONE' THEN {'st': 'DONE', 'r': s.r, 'e': 0, 'n': s.n + 1}
 WHEN e.o = 'RUNNING' THEN {'st': 'RUNNING', 'r': s.r, 'e': 0, 'n': s.n + 1}
 WHEN e.o = 'LOST' THEN CASE WHEN s.r >= 3 THEN {'st': 'FAILED', 'r': s.r, 'e': s.e, 'n': s.n + 1} ELSE {'st': 'RUNNING', 'r': s.r + 1, 'e': s.e, 'n': s.n + 1} END
 ELSE {'st': CASE WHEN s.e + 1 >= 8 THEN 'FAILED' ELSE s.st END, 'r': s.r, 'e': s.e + 1, 'n': s.n + 1} END"""


@query(f"""WITH e AS (SELECT user_id AS job_id, epoch_us(ts) AS ord, {OUTCOME} AS o FROM events),
g AS (SELECT job_id, list({{'o': o}} ORDER BY ord) AS es FROM e GROUP BY 1),
f AS (SELECT job_id, list_reduce(es, lambda s, e: {STEP_POLL}, {{'st': 'SUBMITTED', 'r': 0, 'e': 0, 'n': 0}}) AS r FROM g)
SELECT job_id, r.st AS status, r.r AS retry_count, r.e AS poll_fail_count, r.n AS n_polls FROM f""")
def poll_outcomes(spark, d):
    """Job status from its poll log: eight errors in a row or a fourth loss end a job."""
    ev = t.table(spark, d, "events")
    kind, v = F.col("event_type"), F.col("value")
    outcome = (
        F.when((kind == "purchase") & (v > 40), F.lit("DONE")).when((kind == "signup") & (v > 24), F.lit("LOST"))
        .when(kind.isin("view", "click") & (v > 12), F.lit("RUNNING")).otherwise(F.lit("ERROR"))
    )
    polls = ev.select(F.col("user_id").alias("job_id"), outcome.alias("outcome"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ord"))
    return jb.poll_outcomes(polls, "ord")


PLATE = pl.Plate(n_experimental=4, n_positive=2, n_negative=1, n_blank=1, n_replicate=2, rows=2, cols=6)
BATCHES = """b AS (SELECT job_id, pool_idx, row_number() OVER (PARTITION BY job_id ORDER BY pool_idx) AS rank FROM (SELECT DISTINCT l_orderkey AS job_id, l_partkey AS pool_idx FROM lineitem)),
x AS (SELECT job_id, pool_idx, rank - 1 AS slot FROM b WHERE rank <= 4), n AS (SELECT job_id, count(*) AS n FROM x GROUP BY 1),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ('0x' || substr(md5(job_id || ':' || pool_idx || ':5'), 1, 8))::BIGINT, pool_idx) AS k FROM x) WHERE k <= 2)"""


def _well_sql(s: str) -> str:
    return f"chr((65 + {s} // 6)::INT) || lpad(({s} % 6 + 1)::VARCHAR, 2, '0')"


def _batches(spark, d):
    pairs = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("pool_idx")).distinct()
    return pairs.withColumn("rank", F.col("pool_idx"))


def _controls(spark, d):
    s = t.table(spark, d, "supplier")
    kind = F.when(F.col("s_acctbal") > 1000, F.lit("positive")).otherwise(F.lit("negative"))
    return s.select(kind.alias("kind"), F.col("s_suppkey").alias("rank"), F.col("s_suppkey").alias("pool_idx"))


@query(f"""WITH {BATCHES}, p AS (SELECT s_suppkey AS pool_idx, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier WHERE s_acctbal > 1000),
m AS (SELECT s_suppkey AS pool_idx, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier WHERE s_acctbal <= 1000),
w AS (SELECT job_id, slot, pool_idx, 'experimental' AS kind, '-' AS replicate_of FROM x
 UNION ALL SELECT job_id, n + k - 1, pool_idx, 'positive', '-' FROM n, p WHERE k <= 2
 UNION ALL SELECT job_id, n + 2 + k - 1, pool_idx, 'negative', '-' FROM n, m WHERE k <= 1
 UNION ALL SELECT job_id, n + 3, -1, 'blank', '-' FROM n
 UNION ALL SELECT r.job_id, n + 4 + k - 1, pool_idx, 'replicate', {_well_sql('slot')} FROM r JOIN n USING (job_id))
SELECT job_id, slot, pool_idx, kind, replicate_of, {_well_sql('slot')} AS well_id, job_id || ':' || {_well_sql('slot')} AS item_id,
 CASE WHEN pool_idx >= 0 THEN format('CMP{{:07d}}', pool_idx) ELSE '' END AS compound_id FROM w""")
def plate_layout(spark, d):
    """One plate per job: experimental wells, controls, a blank and replicates."""
    wells = pl.layout(_batches(spark, d), _controls(spark, d), PLATE, seed=5)
    return wells.withColumn("replicate_of", F.coalesce("replicate_of", F.lit("-"))).withColumn("slot", F.col("slot").cast("bigint"))


@query(f"WITH {BATCHES} SELECT job_id, pool_idx, k AS pick FROM r")
def replicates(spark, d):
    chosen = pl.top_k_per(_batches(spark, d), ["job_id"], [F.asc("rank")], PLATE.n_experimental, "_n")
    return pl.replicate_picks(chosen, PLATE, 5).select("job_id", "pool_idx", F.col("_in_role").cast("bigint").alias("pick"))


@query("""WITH n AS (SELECT l_orderkey AS job_id, count(*) AS n_items FROM lineitem GROUP BY 1) SELECT job_id, n_items FROM n WHERE n_items > 12""")
def plates_over_capacity(spark, d):
    items = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"))
    return pl.over_capacity(items, PLATE)


@query("""SELECT job_id, job_id || ':i' || (rank - 1) AS item_id, pool_idx, 'experimental' AS kind, format('CMP{:07d}', pool_idx) AS compound_id FROM (
 SELECT job_id, pool_idx, row_number() OVER (PARTITION BY job_id ORDER BY pool_idx) AS rank FROM (SELECT DISTINCT l_orderkey AS job_id, l_partkey AS pool_idx FROM lineitem))""")
def make_job_items(spark, d):
    return pl.job_items(_batches(spark, d), ["pool_idx"])


@query(f"""WITH {t.LEDGER}, old AS (SELECT campaign_id, max(round - 1990) AS last FROM ledger WHERE status = 'DONE' GROUP BY 1),
new AS (SELECT job_id, campaign_id, row_number() OVER (PARTITION BY campaign_id ORDER BY job_id) - 1 AS n FROM ledger WHERE status <> 'DONE')
SELECT job_id, campaign_id, coalesce(last + 1, 0) + n AS batch_seq FROM new LEFT JOIN old USING (campaign_id)""")
def number_batches(spark, d):
    led = t.ledger(spark, d)
    known = led.filter("status = 'DONE'").select("campaign_id", (F.col("round") - 1990).alias("batch_seq"))
    return pl.number_batches(led.filter("status <> 'DONE'").select("job_id", "campaign_id"), known, ["job_id"])
