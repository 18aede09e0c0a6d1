"""Queries over acquisition, surrogates and closed-loop campaigns."""

from __future__ import annotations

from pyspark.sql import functions as F

from pickwise.operators import acquire as ac
from pickwise.operators import similarity as si
from pickwise.operators.diversity import diversify as reorder
from pickwise.operators.metrics import report
from pickwise.operators.surrogate import ColumnSurrogate, ForestSurrogate, dense_features
from pickwise.plans import campaign as ca
from pickwise.plans import tables as t
from pickwise.plans.registry import query

U = "('0x' || substr(md5(pool_idx || ':{seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def _out(selection, digits: int = 9):
    return selection.select(F.col("rank").cast("bigint").alias("rank"), "pool_idx", F.round("score", digits).alias("score"), "strategy")


@query(f"""WITH c AS (SELECT p_partkey AS pool_idx FROM part), s AS (SELECT pool_idx, {U.format(seed=11)} AS score FROM c)
SELECT row_number() OVER (ORDER BY score DESC, pool_idx) AS rank, pool_idx, round(score, 9) AS score, 'random' AS strategy FROM s QUALIFY rank <= 50""")
def acq_random(spark, d):
    return _out(ac.random_batch(t.predictions(spark, d), 50, ac.Params(seed=11)))


RANGES = "lim AS (SELECT min(agg0) AS lo0, max(agg0) AS hi0, min(agg1) AS lo1, max(agg1) AS hi1 FROM known)"


def _weighted_sql(name: str, beta: str, w0: str, w1: str, k: int, extra: str = "") -> str:
    term = lambda i, w: f"((mean{i} + {beta} * std{i} - lo{i}) / CASE WHEN hi{i} - lo{i} > 1e-9::DOUBLE THEN hi{i} - lo{i} ELSE 1.0::DOUBLE END) * {w}"
    return f"""WITH {t.KNOWN}, {RANGES}{extra}, s AS (SELECT pool_idx, {term(0, w0)} + {term(1, w1)} AS score FROM pred, lim{', wt' if extra else ''})
SELECT row_number() OVER (ORDER BY score DESC, pool_idx) AS rank, pool_idx, round(score, 9) AS score, '{name}' AS strategy FROM s QUALIFY rank <= {k}"""


def _params(spark, d, **kw):
    return ac.Params(n_objectives=2, labels=t.known_labels(spark, d), **kw)


@query(_weighted_sql("greedy", "0.0::DOUBLE", "0.5::DOUBLE", "0.5::DOUBLE", 50))
def acq_greedy(spark, d):
    return _out(ac.greedy_batch(t.predictions(spark, d), 50, _params(spark, d)))


@query(_weighted_sql("ucb", "0.5::DOUBLE", "0.5::DOUBLE", "0.5::DOUBLE", 50))
def acq_ucb(spark, d):
    return _out(ac.ucb_batch(t.predictions(spark, d), 50, _params(spark, d, beta=0.5)))


def _weight(i: int) -> str:
    return f"('0x' || substr(md5('w:{i}:3'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(_weighted_sql("weighted", "0.0::DOUBLE", "w0", "w1", 50, f", wt AS (SELECT {_weight(0)} / ({_weight(0)} + {_weight(1)}) AS w0, {_weight(1)} / ({_weight(0)} + {_weight(1)}) AS w1)"))
def acq_weighted(spark, d):
    return _out(ac.weighted_batch(t.predictions(spark, d), 50, _params(spark, d, seed=3)))


@query(f"""WITH {t.PREDICTIONS}, lim AS (SELECT min(mean0) AS lo0, max(mean0) AS hi0, min(mean1) AS lo1, max(mean1) AS hi1 FROM pred),
s AS (SELECT pool_idx, (mean0 + 0.5::DOUBLE * std0 - lo0) / (hi0 - lo0) * 0.5::DOUBLE + (mean1 + 0.5::DOUBLE * std1 - lo1) / (hi1 - lo1) * 0.5::DOUBLE AS score FROM pred, lim)
SELECT row_number() OVER (ORDER BY score DESC, pool_idx) AS rank, pool_idx, round(score, 9) AS score, 'ucb' AS strategy FROM s QUALIFY rank <= 50""")
def acq_ucb_unlabelled(spark, d):
    """Without labels the raw predicted means give the range."""
    return _out(ac.ucb_batch(t.predictions(spark, d), 50, ac.Params(n_objectives=2, beta=0.5)))


PENDING_SQL = f"""WITH {t.FPS}, refs AS (SELECT pool_idx AS r FROM fps WHERE label = 1),
i AS (SELECT a.pool_idx, b.pool_idx AS r, count(*) AS n FROM bits a JOIN bits b ON a.b = b.b JOIN refs ON refs.r = b.pool_idx GROUP BY ALL),
s AS (SELECT i.pool_idx, max(i.n / (p.n + q.n - i.n)::DOUBLE) AS sim FROM i JOIN pop p ON p.pool_idx = i.pool_idx JOIN pop q ON q.pool_idx = i.r GROUP BY i.pool_idx),
sc AS (SELECT fps.pool_idx, label::DOUBLE - 0.5::DOUBLE * coalesce(sim, 0) AS score FROM fps LEFT JOIN s USING (pool_idx))"""


@query(PENDING_SQL + " SELECT row_number() OVER (ORDER BY score DESC, pool_idx) AS rank, pool_idx, round(score, 9) AS score, 'greedy' AS strategy FROM sc QUALIFY rank <= 40")
def acq_pending(spark, d):
    """Candidates similar to those under evaluation are ranked down."""
    fps = t.fingerprints(spark, d).withColumn("score", F.col("label").cast("double"))
    rated = si.pending_penalty(fps, fps.filter("label = 1"), 0.5, n_bits=t.EMBEDDING_BITS)
    return _out(ac.ranked(ac.top_k(rated, "score", 40), 40, "greedy"))


PARETO_SQL = f"""WITH {t.KNOWN}, lim AS (SELECT min(agg0) - 0.05::DOUBLE * (max(agg0) - min(agg0)) AS rx, min(agg1) - 0.05::DOUBLE * (max(agg1) - min(agg1)) AS ry FROM known),
opt AS (SELECT pool_idx, mean0 + 0.5::DOUBLE * std0 AS x, mean1 + 0.5::DOUBLE * std1 AS y FROM pred), cap AS (SELECT * FROM opt ORDER BY x + y DESC, pool_idx LIMIT 400),
cand AS (SELECT NULL AS pool_idx UNION ALL SELECT pool_idx FROM cap),
pts AS (SELECT cand.pool_idx, agg0 AS x, agg1 AS y FROM cand, known UNION ALL SELECT pool_idx, x, y FROM cap),
g AS (SELECT pool_idx, x, max(y) AS y FROM pts, lim WHERE x > rx AND y > ry GROUP BY ALL),
h AS (SELECT pool_idx, x, max(y) OVER w AS top, lead(x) OVER w AS nx FROM g WINDOW w AS (PARTITION BY pool_idx ORDER BY x DESC)),
v AS (SELECT pool_idx, sum((x - coalesce(nx, rx)) * (top - ry)) AS v FROM h, lim GROUP BY pool_idx),
gain AS (SELECT pool_idx, v - (SELECT v FROM v WHERE pool_idx IS NULL) AS gain FROM v WHERE pool_idx IS NOT NULL)"""


def _pareto_params(spark, d):
    from pickwise.operators.pareto import reference_point

    labels = t.known_labels(spark, d)
    ref = tuple(reference_point(labels, ["agg0", "agg1"]).first())
    return ac.Params(n_objectives=2, beta=0.5, labels=labels, ref_point=ref, candidate_cap=ac.CANDIDATE_CAP)


@query(PARETO_SQL + " SELECT pool_idx, round(gain, 4) AS gain FROM gain ORDER BY round(gain, 6) DESC, pool_idx LIMIT 1")
def acq_pareto_step(spark, d):
    """First greedy step: the candidate that adds most hypervolume."""
    first = ac.pareto_batch(t.predictions(spark, d), 1, _pareto_params(spark, d))
    return first.select("pool_idx", F.round("score", 4).alias("gain"))


def _pareto_steps(k: int) -> str:
    """The step query unrolled: every pick joins the known points of the next step."""
    out = PARETO_SQL[: PARETO_SQL.index(",\ncand AS")] + ", known0 AS (SELECT agg0 AS x, agg1 AS y FROM known), picked0 AS (SELECT -1 AS pool_idx, 0 AS rank, 0.0::DOUBLE AS gain)"
    for n in range(1, k + 1):
        m = n - 1
        out += f""", left{n} AS (SELECT * FROM cap WHERE pool_idx NOT IN (SELECT pool_idx FROM picked{m})), cand{n} AS (SELECT NULL AS pool_idx UNION ALL SELECT pool_idx FROM left{n}),
pts{n} AS (SELECT pool_idx, x, y FROM cand{n}, known{m} UNION ALL SELECT pool_idx, x, y FROM left{n}), g{n} AS (SELECT pool_idx, x, max(y) AS y FROM pts{n}, lim WHERE x > rx AND y > ry GROUP BY ALL),
h{n} AS (SELECT pool_idx, x, max(y) OVER w AS top, lead(x) OVER w AS nx FROM g{n} WINDOW w AS (PARTITION BY pool_idx ORDER BY x DESC)),
v{n} AS (SELECT pool_idx, sum((x - coalesce(nx, rx)) * (top - ry)) AS v FROM h{n}, lim GROUP BY pool_idx),
gain{n} AS (SELECT pool_idx, v - (SELECT v FROM v{n} WHERE pool_idx IS NULL) AS gain FROM v{n} WHERE pool_idx IS NOT NULL),
best{n} AS (SELECT pool_idx, {n} AS rank, gain FROM gain{n} ORDER BY round(gain, 6) DESC, pool_idx LIMIT 1),
picked{n} AS (SELECT * FROM picked{m} UNION ALL SELECT * FROM best{n}), known{n} AS (SELECT * FROM known{m} UNION ALL SELECT x, y FROM cap WHERE pool_idx IN (SELECT pool_idx FROM best{n}))"""
    return out + f" SELECT rank::INT AS rank, pool_idx, round(gain, 4) AS score, 'pareto' AS strategy FROM picked{k} WHERE rank > 0"


@query(_pareto_steps(3))
def acq_pareto(spark, d):
    """Three greedy steps, each counting what the picks before it have gained."""
    return ac.pareto_batch(t.predictions(spark, d), 3, _pareto_params(spark, d)).select("rank", "pool_idx", F.round("score", 4).alias("score"), "strategy")


@query(f"""WITH done AS (SELECT DISTINCT l_partkey AS pool_idx FROM lineitem WHERE l_returnflag = 'N'), c AS (SELECT p_partkey AS pool_idx FROM part WHERE p_partkey NOT IN (SELECT pool_idx FROM done)
 UNION ALL SELECT p_partkey FROM part WHERE p_size > 25 AND p_partkey IN (SELECT pool_idx FROM done)), s AS (SELECT pool_idx, {U.format(seed=4)} AS score FROM c)
SELECT row_number() OVER (ORDER BY score DESC, pool_idx) AS rank, pool_idx, round(score, 9) AS score, 'random' AS strategy FROM s
QUALIFY rank <= least(80, greatest(1, floor(0.02::DOUBLE * (SELECT count(*) FROM part))))""")
def init_batch(spark, d):
    """First random batch from what is available, within one plate."""
    part = t.table(spark, d, "part").select(F.col("p_partkey").alias("pool_idx"), "p_size")
    done = t.table(spark, d, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_partkey").alias("pool_idx")).distinct()
    state = done.join(part.filter("p_size <= 25"), "pool_idx").select("pool_idx", F.lit("LABELED").alias("phase"))
    free = ca.available_candidates(part, state)
    return _out(ac.initial_batch(free, part.count(), 0.02, 4, 80))


DIVERSIFY_SQL = """WITH f AS (SELECT vec_id AS pool_idx, label, list_filter(range(64), lambda i: embedding[i + 1] > 0) AS fp, ('0x' || substr(md5(vec_id || ':2'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS score FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, pool_idx) AS rk FROM f), b AS (SELECT *, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS g FROM r WHERE rk <= 12 WINDOW w AS (PARTITION BY label)),
one AS (SELECT * FROM b WHERE rk = 1),
s1 AS (SELECT b.*, len(list_intersect(b.fp, one.fp)) / (len(b.fp) + len(one.fp) - len(list_intersect(b.fp, one.fp)))::DOUBLE AS m FROM b JOIN one USING (label)),
two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY 0.6::DOUBLE * g - 0.4::DOUBLE * m DESC, rk) AS k FROM s1 WHERE rk > 1) WHERE k = 1),
s2 AS (SELECT s1.*, greatest(s1.m, len(list_intersect(s1.fp, two.fp)) / (len(s1.fp) + len(two.fp) - len(list_intersect(s1.fp, two.fp)))::DOUBLE) AS m2, two.pool_idx AS second FROM s1 JOIN two USING (label)),
three AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY 0.6::DOUBLE * g - 0.4::DOUBLE * m2 DESC, rk) AS k FROM s2 WHERE rk > 1 AND pool_idx <> second) WHERE k = 1)
SELECT label, pool_idx, 1 AS div_rank FROM one UNION ALL SELECT label, pool_idx, 2 FROM two UNION ALL SELECT label, pool_idx, 3 FROM three"""


@query(DIVERSIFY_SQL)
def diversify(spark, d):
    """Three diverse picks out of the best twelve of every class, all classes at once."""
    from pickwise.functions.hashing import seeded_uniform

    f = t.fingerprints(spark, d).withColumn("score", seeded_uniform(2, F.col("pool_idx")))
    return reorder(f, ["label"], 3, 0.4, t.EMBEDDING_BITS, oversample=4).select("label", "pool_idx", "div_rank")

POOL_SQL = """WITH f AS (SELECT vec_id AS pool_idx, list_filter(range(64), lambda i: embedding[i + 1] > 0) AS fp, ('0x' || substr(md5(vec_id || ':5'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS score FROM embeddings),
b AS (SELECT *, (score - (SELECT min(score) FROM f)) / ((SELECT max(score) FROM f) - (SELECT min(score) FROM f)) AS g, 0.0::DOUBLE AS m FROM f),
one AS (SELECT * FROM b ORDER BY g DESC, pool_idx LIMIT 1)"""


def _pool_steps(k: int) -> str:
    """The greedy rule unrolled: every pick raises the similarities of the next step."""
    out, prev = POOL_SQL, "b"
    out = out.replace("one AS", "p1 AS")
    for n in range(2, k + 1):
        near = "len(list_intersect(a.fp, p.fp))"
        out += f""", s{n} AS (SELECT a.pool_idx, a.fp, a.score, a.g, greatest(a.m, {near} / greatest(len(a.fp) + len(p.fp) - {near}, 1)::DOUBLE) AS m FROM {prev} a, p{n - 1} p WHERE a.pool_idx <> p.pool_idx),
p{n} AS (SELECT * FROM s{n} ORDER BY (1 - 0.4::DOUBLE) * g - 0.4::DOUBLE * m DESC, pool_idx LIMIT 1)"""
        prev = f"s{n}"
    return out + " " + " UNION ALL ".join(f"SELECT {n} AS div_rank, pool_idx, round(score, 9) AS score FROM p{n}" for n in range(1, k + 1))


@query(_pool_steps(20))
def diversify_pool(spark, d):
    """Twenty diverse picks out of the whole library."""
    from pickwise.functions.hashing import seeded_uniform
    from pickwise.operators.diverse_pool import diversify_pool as lazy

    f = t.fingerprints(spark, d).withColumn("score", seeded_uniform(5, F.col("pool_idx")))
    return lazy(f, 20, 0.4, t.EMBEDDING_BITS).select("div_rank", "pool_idx", F.round("score", 9).alias("score"))


# ---- surrogate and campaigns --------------------------------------------------------------------

RULES = ca.Rules(batch_size=20, init_fraction=0.04, n_trees=20, beta=0.5, max_depth=12)


def _library(spark, d):
    """Candidates with model features, and their hidden labels apart."""
    e = dense_features(t.table(spark, d, "embeddings"), "embedding")
    candidates = e.select(F.col("vec_id").alias("pool_idx"), "features")
    truth = e.select(F.col("vec_id").alias("pool_idx"), F.col("label").cast("double").alias("activity"))
    return candidates, truth


COUNTED = """c AS (SELECT vec_id AS pool_idx, label::DOUBLE AS a, len(list_filter(range(64), lambda i: embedding[i + 1] > 0))::DOUBLE AS p FROM embeddings),
 n AS (SELECT count(*) AS n FROM c), h AS (SELECT pool_idx FROM (SELECT pool_idx, row_number() OVER (ORDER BY a DESC, pool_idx) AS rk FROM c), n WHERE rk <= greatest(1, ceil(0.01::DOUBLE * n)))"""
BY_COUNT = ColumnSurrogate(("popcount",), ("wobble",))


def _counted(spark, d):
    """The library with a score of an outside model: the number of positive features, and its remainder by seven as spread."""
    candidates, truth = _library(spark, d)
    bits = t.fingerprints(spark, d).select("pool_idx", F.col("popcount").cast("double").alias("popcount"))
    return candidates.join(bits, "pool_idx").withColumn("wobble", F.col("popcount") % 7), truth


@query("SELECT vec_id AS pool_idx, true AS mean_in_range, true AS spread_in_range FROM embeddings")
def rf_fit_predict(spark, d):
    """Forest mean and spread for every candidate, trained on the revealed ones: a tree mean lies among the labels, a spread within half
    their range."""
    candidates, truth = _library(spark, d)
    first = ac.initial_batch(candidates, candidates.count(), 0.2, 0)
    training = first.select("pool_idx").join(candidates, "pool_idx").join(truth, "pool_idx")
    out = ForestSurrogate(20, 0, 12).fit(training, ["activity"]).predict(candidates)
    low, high = training.agg(F.min("activity"), F.max("activity")).first()
    return out.select(
        "pool_idx", F.col("mean0").between(low - 1e-9, high + 1e-9).alias("mean_in_range"),
        F.col("std0").between(0.0, (high - low) / 2 + 1e-9).alias("spread_in_range"),
    )


@query(f"WITH {COUNTED} SELECT pool_idx, round(avg(a) OVER (PARTITION BY p % 7), 9) AS mean0, 0::DOUBLE AS std0 FROM c")
def forest_leaf_means(spark, d):
    """Fully grown trees over one feature of seven values, every row seen once: each leaf holds one value, and its prediction is the
    average label of that value."""
    candidates, truth = _counted(spark, d)
    one = dense_features(candidates.select("pool_idx", F.array("wobble").alias("wobble")), "wobble")
    out = ForestSurrogate(3, 0, 12, bootstrap=False).fit(one.join(truth, "pool_idx"), ["activity"]).predict(one)
    return out.select("pool_idx", F.round("mean0", 9).alias("mean0"), F.round("std0", 9).alias("std0"))


@query(f"""WITH {COUNTED}, lab AS (SELECT c.*, row_number() OVER (ORDER BY {U.format(seed=0)} DESC, pool_idx) AS k FROM c),
first AS (SELECT * FROM lab, n WHERE k <= greatest(1, floor(0.2::DOUBLE * n))), lim AS (SELECT min(a) AS lo, max(a) AS hi FROM first), cut AS (SELECT quantile_cont(-p, 0.1) AS q FROM c),
s AS (SELECT pool_idx, (p + 0.5::DOUBLE * (p % 7) - lo) / (hi - lo) AS score FROM c, lim, cut WHERE pool_idx NOT IN (SELECT pool_idx FROM first) AND -p >= q)
SELECT row_number() OVER (ORDER BY score DESC, pool_idx) AS rank, pool_idx, round(score, 9) AS score, 'ucb' AS strategy FROM s QUALIFY rank <= 20""")
def select_round(spark, d):
    """One round: availability, feasibility, surrogate, acquisition."""
    from dataclasses import replace

    candidates, truth = _counted(spark, d)
    ease = candidates.withColumn("sa_ease", -F.col("popcount"))
    first = ac.initial_batch(candidates, candidates.count(), 0.2, 0).select("pool_idx")
    labels = first.join(candidates, "pool_idx").join(truth, "pool_idx")
    rules = replace(RULES, acquisition="ucb", ease_quantile=0.1)
    return _out(ca.select_round(ease, labels, rules, taken=first, surrogate=BY_COUNT))


def _chain(name: str, order: str, rounds: int, k: int = 20, start: float = 0.04) -> str:
    """CTEs of a campaign's picks: a random share ``start``, then ``k`` rows a round by ``order``; {{r}} in it is the round."""
    parts = [f"{name}0 AS (SELECT pool_idx, a, 0 AS round FROM (SELECT c.*, row_number() OVER (ORDER BY {U.format(seed=0)} DESC, pool_idx) AS k FROM c), n WHERE k <= greatest(1, floor({start}::DOUBLE * n)))"]
    for r in range(1, rounds + 1):
        taken = " UNION ALL ".join(f"SELECT pool_idx FROM {name}{i}" for i in range(r))
        parts.append(f"{name}{r} AS (SELECT pool_idx, a, {r} AS round FROM (SELECT c.*, row_number() OVER (ORDER BY {order.replace('{r}', str(r))}, pool_idx) AS k FROM c WHERE pool_idx NOT IN ({taken})) WHERE k <= {k})")
    parts.append(f"{name} AS ({' UNION ALL '.join(f'SELECT * FROM {name}{i}' for i in range(rounds + 1))})")
    return ", ".join(parts)


RANDOM_ORDER = U.replace("{seed}", "{r}") + " DESC"
FIGURES = """count(*) AS n_labeled, round(avg(a), 9) AS mean_activity, round(count(*) FILTER (WHERE pool_idx IN (SELECT pool_idx FROM h)) / (SELECT count(*) FROM h)::DOUBLE, 9) AS top1_recall"""


def _pick(prev: str, r: int, seed: int, k: str) -> str:
    u = U.format(seed=seed)
    return f"""r{r} AS (SELECT pool_idx, a, {r} AS round FROM (SELECT pool_idx, a, row_number() OVER (ORDER BY {u} DESC, pool_idx) AS n FROM tr WHERE pool_idx NOT IN (SELECT pool_idx FROM ({prev}))) WHERE n <= {k})"""


BACKTEST_SQL = f"""WITH tr AS (SELECT vec_id AS pool_idx, label::DOUBLE AS a FROM embeddings),
{_pick('SELECT -1 AS pool_idx', 0, 0, '(SELECT greatest(1, floor(0.04::DOUBLE * count(*))) FROM tr)')}, {_pick('FROM r0', 1, 1, '20')},
{_pick('FROM r0 UNION ALL FROM r1', 2, 2, '20')}, l AS (FROM r0 UNION ALL FROM r1 UNION ALL FROM r2), rounds AS (SELECT DISTINCT round FROM l),
ranked AS (SELECT pool_idx, row_number() OVER (ORDER BY a DESC, pool_idx) AS rk FROM tr), h AS (SELECT pool_idx FROM ranked WHERE rk <= greatest(1, ceil(0.01::DOUBLE * (SELECT count(*) FROM tr))))
SELECT rounds.round, count(*) AS n_labeled, round(avg(a), 9) AS mean_activity, round(count(*) FILTER (WHERE pool_idx IN (SELECT pool_idx FROM h)) / (SELECT count(*) FROM h)::DOUBLE, 9) AS top1_recall
FROM rounds JOIN l ON l.round <= rounds.round GROUP BY 1"""
BACKTEST_SQL = BACKTEST_SQL.replace("SELECT pool_idx FROM (FROM r0 UNION ALL FROM r1)", "SELECT pool_idx FROM r0 UNION ALL SELECT pool_idx FROM r1").replace("SELECT pool_idx FROM (FROM r0)", "SELECT pool_idx FROM r0")


@query(BACKTEST_SQL)
def backtest_random(spark, d):
    """The closed loop under random selection, which SQL can follow step by step."""
    from dataclasses import replace

    candidates, truth = _library(spark, d)
    labels = ca.run_campaign(candidates, ca.evaluate_from(truth, ["activity"]), replace(RULES, acquisition="random"), 2)
    r = ca.history(truth, labels, ["activity"])
    return r.select("round", "n_labeled", F.round("mean_activity", 9).alias("mean_activity"), F.round("top1_recall", 9).alias("top1_recall"))


@query(f"""WITH {t.TRUTH}, obs AS (SELECT DISTINCT l_returnflag AS g, l_partkey AS pool_idx FROM lineitem), m AS (SELECT g, t.* FROM obs JOIN truth t USING (pool_idx)),
lim AS (SELECT min(activity) - 0.05::DOUBLE * (max(activity) - min(activity)) AS rx, min(qed) - 0.05::DOUBLE * (max(qed) - min(qed)) AS ry FROM truth),
ga AS (SELECT 'all' AS g, activity AS x, max(qed) AS y FROM truth GROUP BY ALL UNION ALL SELECT g, activity, max(qed) FROM m GROUP BY ALL),
h AS (SELECT g, x, max(y) OVER w AS top, lead(x) OVER w AS nx FROM ga WINDOW w AS (PARTITION BY g ORDER BY x DESC)), v AS (SELECT g, sum((x - coalesce(nx, rx)) * (top - ry)) AS v FROM h, lim GROUP BY g),
front AS (SELECT pool_idx FROM truth a WHERE NOT EXISTS (SELECT 1 FROM truth b WHERE b.activity >= a.activity AND b.qed >= a.qed AND (b.activity > a.activity OR b.qed > a.qed)))
SELECT g, count(*) AS n_labeled, round(max(v) / (SELECT v FROM v WHERE g = 'all'), 9) AS hv_frac, round(count(*) FILTER (WHERE pool_idx IN (SELECT pool_idx FROM front)) / (SELECT count(*) FROM front)::DOUBLE, 9) AS pareto_recall
FROM m JOIN v USING (g) GROUP BY g""")
def grouped_report(spark, d):
    """One report row per group of labelled candidates, with the Pareto figures."""
    li = t.table(spark, d, "lineitem")
    labelled = li.select(F.col("l_returnflag").alias("g"), F.col("l_partkey").alias("pool_idx"))
    r = report(t.truth(spark, d), labelled, ["activity", "qed"], by=["g"])
    return r.select("g", "n_labeled", F.round("hv_frac", 9).alias("hv_frac"), F.round("pareto_recall", 9).alias("pareto_recall"))


@query(f"""WITH {COUNTED}, {_chain('g', 'p DESC', 3)} SELECT r.round, {FIGURES.replace('pool_idx', 'g.pool_idx').replace('SELECT g.pool_idx', 'SELECT pool_idx')},
 round((count(*) FILTER (WHERE g.pool_idx IN (SELECT pool_idx FROM h)) / count(*)::DOUBLE) / ((SELECT count(*) FROM h) / (SELECT n FROM n)::DOUBLE), 9) AS ef_top1
 FROM (SELECT DISTINCT round FROM g) r JOIN g ON g.round <= r.round GROUP BY r.round""")
def backtest(spark, d):
    """A closed loop of three rounds, reported per round."""
    from dataclasses import replace

    candidates, truth = _counted(spark, d)
    labels = ca.run_campaign(candidates, ca.evaluate_from(truth, ["activity"]), replace(RULES, acquisition="greedy"), 3, surrogate=BY_COUNT)
    r = ca.history(truth, labels, ["activity"])
    return r.select("round", "n_labeled", *[F.round(c, 9).alias(c) for c in ("mean_activity", "top1_recall", "ef_top1")])


def text_library(spark, d):
    """Documents as candidates: pair fingerprints stored once, text length as the hidden activity."""
    from pickwise.functions.fingerprints import fingerprint
    from pickwise.operators.scale import use_all_cores
    from pickwise.session import scratch_path
    from pickwise.sources.tables import read_fingerprints, write_fingerprints

    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("pool_idx"), "text")
    path = scratch_path(spark, "fingerprints")
    write_fingerprints(fingerprint(use_all_cores(docs), packed=True), path, also=["packed"])
    truth = t.table(spark, d, "documents").select(F.col("doc_id").alias("pool_idx"), F.log(F.col("n_chars") + 1.0).alias("activity"))
    return read_fingerprints(spark, path), truth


ENRICHMENT = ca.Rules(batch_size=50, init_fraction=0.005, n_trees=40, beta=0.5, pending_lambda=0.0, max_bins=2, features="packed")


# only documents of two tokens or more have a fingerprint; the hits are sought among all documents
ENRICHED = r"""c AS (SELECT doc_id AS pool_idx, n_chars AS a FROM documents WHERE regexp_matches(coalesce(text, ''), '[^ \t\n\x0B\f\r][ \t\n\x0B\f\r]+[^ \t\n\x0B\f\r]')),
 n AS (SELECT count(*) AS n FROM c), h AS (SELECT doc_id AS pool_idx FROM documents QUALIFY row_number() OVER (ORDER BY n_chars DESC, doc_id) <= greatest(1, ceil(0.01::DOUBLE * count(*) OVER ())))"""


@query(f"""WITH {ENRICHED}, {_chain('r', RANDOM_ORDER, 5, 50, 0.005)}, figures AS (SELECT count(*) AS n_labeled, round(avg(ln(a + 1.0)), 9) AS random_mean,
 round(count(*) FILTER (WHERE pool_idx IN (SELECT pool_idx FROM h)) / (SELECT count(*) FROM h)::DOUBLE, 9) AS random_recall FROM r)
SELECT s AS strategy, 0 AS seed, figures.* FROM figures, (VALUES ('random'), ('greedy'), ('ucb')) v(s)""")
def enrichment_campaign(spark, d):
    """The published comparison: five rounds of fifty over a fingerprint library, three strategies. The random one, which the others are
    held against, can be followed in SQL."""
    r = enrichment(spark, d)
    random = r.filter("strategy = 'random'").select(F.round("mean_activity", 9).alias("random_mean"), F.round("top1_recall", 9).alias("random_recall"))
    return r.select("strategy", "seed", "n_labeled").join(F.broadcast(random), F.lit(True))


def enrichment(spark, d):
    candidates, truth = text_library(spark, d)
    r = ca.compare(candidates, truth, ENRICHMENT, ["random", "greedy", "ucb"], 5)
    return r.select("strategy", "seed", "n_labeled", "mean_activity", "top01_recall", "top1_recall", "ef_top1", "bedroc", "n_hits_top1")


@query(f"""WITH {COUNTED}, {_chain('r', RANDOM_ORDER, 2)}, {_chain('g', 'p DESC', 2)}, {_chain('u', 'p + 0.5::DOUBLE * (p % 7) DESC', 2)},
every AS (SELECT 'random' AS strategy, * FROM r UNION ALL SELECT 'greedy', * FROM g UNION ALL SELECT 'ucb', * FROM u) SELECT strategy, 0 AS seed, {FIGURES} FROM every GROUP BY strategy""")
def compare_strategies(spark, d):
    """Random, greedy and upper confidence bound under the same budget."""
    candidates, truth = _counted(spark, d)
    r = ca.compare(candidates, truth, RULES, ["random", "greedy", "ucb"], 2, surrogate=BY_COUNT)
    return r.select("strategy", "seed", "n_labeled", *[F.round(c, 9).alias(c) for c in ("mean_activity", "top1_recall")])


def _tries(rounds: int, k: int, start: str) -> str:
    """CTEs of a loop with failures: a candidate leaves after one result or two failures. ``o`` (pool_idx, a, out)."""
    parts = [f"p0 AS (SELECT pool_idx, a, out, 0 AS round FROM (SELECT o.*, row_number() OVER (ORDER BY {U.format(seed=0)} DESC, pool_idx) AS k FROM o) WHERE k <= {start})"]
    for r in range(1, rounds + 1):
        before = " UNION ALL ".join(f"SELECT pool_idx, out FROM p{i}" for i in range(r))
        gone = f"SELECT pool_idx FROM ({before}) GROUP BY pool_idx HAVING count(*) > 1 OR max(out) = 'COMPLETED'"
        parts.append(f"p{r} AS (SELECT pool_idx, a, out, {r} AS round FROM (SELECT o.*, row_number() OVER (ORDER BY {U.format(seed=r)} DESC, pool_idx) AS k FROM o WHERE pool_idx NOT IN ({gone})) WHERE k <= {k})")
    parts.append(f"p AS ({' UNION ALL '.join(f'SELECT * FROM p{i}' for i in range(rounds + 1))})")
    return ", ".join(parts)


LOOP_SQL = """counts AS (SELECT round, count(*) AS submitted, count(*) FILTER (out = 'COMPLETED') AS completed, count(*) FILTER (out = 'FAILED') AS failed, count(*) FILTER (out = 'QC_REJECTED') AS qc_rejected FROM p GROUP BY round),
known AS (SELECT c.round, count(*) AS n_labeled, round(avg(a), 9) AS mean_activity FROM counts c JOIN p ON p.round <= c.round AND p.out = 'COMPLETED' GROUP BY c.round)
SELECT 'round-' || round AS job_id, round, submitted, completed, failed, qc_rejected, n_labeled, mean_activity, 'random' AS acquisition FROM counts JOIN known USING (round)"""
LOOP_COLUMNS = ("job_id", "round", "submitted", "completed", "failed", "qc_rejected", "n_labeled")


def _loop_rows(history):
    return history.select(*LOOP_COLUMNS, F.round("mean_activity", 9).alias("mean_activity"), "acquisition")


@query(f"""WITH c AS (SELECT vec_id AS pool_idx, label::DOUBLE AS a FROM embeddings), o AS (SELECT pool_idx, a, CASE WHEN {U.format(seed=77)} < 0.3 THEN 'FAILED' WHEN {U.format(seed=78)} < 0.15 THEN 'QC_REJECTED' ELSE 'COMPLETED' END AS out FROM c),
{_tries(4, 20, '(SELECT greatest(1, floor(0.04::DOUBLE * count(*))) FROM c)')}, {LOOP_SQL}""")
def backtest_failures(spark, d):
    """The closed loop over the observation log with failing and rejected evaluations, each tried twice."""
    from dataclasses import replace

    from pickwise.functions.hashing import seeded_uniform
    from pickwise.operators.jobs import reveal
    from pickwise.plans import closed_loop as cl

    candidates, truth = _library(spark, d)
    candidates = candidates.withColumn("smiles", F.concat(F.lit("S"), F.col("pool_idx").cast("string")))

    def evaluate(items):
        seen = reveal(items, truth, F.array("activity"))
        bad, poor = seeded_uniform(77, F.col("pool_idx")) < 0.3, seeded_uniform(78, F.col("pool_idx")) < 0.15
        state = F.when(bad, "FAILED").when(poor, "QC_REJECTED").otherwise(F.col("state"))
        return seen.withColumn("state", state).withColumns({"values": F.when(state == "COMPLETED", F.col("values")), "qc_passed": F.col("state") == "COMPLETED"})

    rules = replace(RULES, acquisition="random")
    log = cl.run_loop(candidates, evaluate, rules, 4)
    return _loop_rows(cl.loop_history(truth, log, rules))


@query(f"""WITH c AS (SELECT p_partkey AS pool_idx, length(p_name)::DOUBLE AS a, p_name, p_size FROM part), o AS (SELECT pool_idx, a, CASE WHEN p_size > 40 OR length(p_name) > 12 THEN 'FAILED' ELSE 'COMPLETED' END AS out FROM c),
{_tries(2, 40, '(SELECT greatest(1, floor(0.04::DOUBLE * count(*))) FROM c)')}, {LOOP_SQL}""")
def backtest_plugin(spark, d):
    """A user function evaluates the batches of the closed loop."""
    from dataclasses import replace

    from pickwise.plans import closed_loop as cl

    part = t.table(spark, d, "part")
    candidates = part.select(F.col("p_partkey").alias("pool_idx"), F.concat_ws("/", "p_name", F.col("p_size").cast("string")).alias("smiles"), F.lit(0).alias("features"))
    truth = part.select(F.col("p_partkey").alias("pool_idx"), F.length("p_name").cast("double").alias("activity"))
    rules = replace(RULES, acquisition="random", batch_size=40)
    log = cl.run_loop(candidates, ca.evaluate_with(_score_text), rules, 2)
    return _loop_rows(cl.loop_history(truth, log, rules))


@query(f"""WITH {t.LABELLED}, tr AS (SELECT vec_id AS pool_idx, label::DOUBLE AS a FROM embeddings), n AS (SELECT count(*) AS n FROM tr),
ranked AS (SELECT pool_idx, a, row_number() OVER (ORDER BY a DESC, pool_idx) - 1 AS r FROM tr), h AS (SELECT * FROM ranked, n WHERE r < greatest(1, ceil(0.01::DOUBLE * n))),
lab AS (SELECT tr.* FROM tr JOIN labelled USING (pool_idx)), f AS (SELECT * FROM h JOIN (SELECT pool_idx FROM lab) USING (pool_idx))
SELECT (SELECT count(*) FROM lab) AS n_labeled, round((SELECT avg(a) FROM lab), 6) AS mean_activity, round((SELECT count(*) FROM f) / (SELECT count(*) FROM h)::DOUBLE, 9) AS top1_recall""")
def single_objective_report(spark, d):
    """With one objective the Pareto figures do not apply."""
    _, truth = _library(spark, d)
    r = report(truth, t.labelled(spark, d), ["activity"])
    return r.select("n_labeled", F.round("mean_activity", 6).alias("mean_activity"), F.round("top1_recall", 9).alias("top1_recall"))


EVAL_SQL = """WITH e AS (SELECT p_partkey AS pool_idx, CASE WHEN p_size > 45 THEN 'timeout' WHEN p_size > 40 THEN 'embed failed' WHEN length(p_name) > 12 THEN 'name too long' ELSE 'ok' END AS m, length(p_name) AS n FROM part)
SELECT pool_idx, CASE m WHEN 'ok' THEN 'COMPLETED' ELSE 'FAILED' END AS state, CASE m WHEN 'timeout' THEN 'evaluation timeout' ELSE m END AS message, CASE m WHEN 'ok' THEN n::DOUBLE END AS activity FROM e"""


def _score_text(text: str):
    """Stand-in for a user's evaluation function: value by length, some failures, some errors."""
    name, size = text.rsplit("/", 1)
    if int(size) > 45:
        return None, "timeout"
    if int(size) > 40:
        return None, "embed failed"
    if len(name) > 12:
        raise ValueError("name too long")
    return -float(len(name)), "ok"


@query(EVAL_SQL)
def evaluate_plugin(spark, d):
    """A user function scores every item in Spark tasks; its errors become row messages."""
    items = t.table(spark, d, "part").select(
        F.col("p_partkey").alias("pool_idx"), F.lit("experimental").alias("kind"),
        F.concat_ws("/", "p_name", F.col("p_size").cast("string")).alias("smiles"),
    )
    return ca.evaluate_with(_score_text)(items).select("pool_idx", "state", "message", "activity")
