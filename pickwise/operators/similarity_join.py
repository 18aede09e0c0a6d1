"""Largest similarity of every candidate to any number of references, as joins and expressions of the JVM alone.

Fingerprints are packed into 64-bit words and equal ones are one kind. On-bits are ordered by how rare they are among the references.
Two fingerprints of similarity ``t`` or more share at least one bit among the first ``size - ceil(t size) + 1`` of either, and their
sizes differ by a factor of ``1 / t`` at most. So references are indexed by those bits and by bands of their size, and candidates look
only there. Levels fall: what has found a partner of similarity ``t`` is done after that level, the rest go on, and the last level looks
through every bit. Lists of an index longer than ``LIST_ROWS`` are split, and a candidate visits every part of them. Where fingerprints are
so dense that a level's lists hold more pairs than there are, every pair is looked at once instead, blocks of references against all
candidates. Neither candidates nor references ever come to the driver; broadcast are the lengths of the lists, at most bits times bands,
and one block.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwise.functions.fingerprints import packed_words
from pickwise.session import cut_lineage

LEVELS = (0.75, 0.5, 0.25, 0.0)
LIST_ROWS = 4000
SCAN_ROWS = 256  # where all pairs are looked at, small tables are cut into blocks of so many references, ...
SCAN_PARTS = 96  # ... at most so many of them, so that every core has some; larger ones into blocks of LIST_ROWS
_BAND = math.log(1.25)


def _fresh(df: DataFrame, name: str) -> str:
    """A column name the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _band(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / F.lit(_BAND) + 1e-9).cast("int")


def _needed(size: Column, level: Column) -> Column:
    """Bits of ``size`` that a partner of similarity ``level`` shares at least."""
    return F.greatest(F.ceil(size * level - 1e-9), F.lit(1)).cast("int")


def _kinds(words: DataFrame) -> DataFrame:
    """(words, size, bits): different fingerprints with at least one bit."""
    return words.groupBy("words").agg(F.first("bits").alias("bits")).select("words", "bits", F.size("bits").alias("size")).filter("size > 0")


def _twin(same: str, apart: bool) -> Column:
    """Whether some reference, ``apart`` from the row's own id, has the row's fingerprint."""
    there = F.col(same).isNotNull()
    if apart:
        there = there & ~(F.col(f"{same}.low").eqNullSafe(F.col("pool_idx")) & F.col(f"{same}.high").eqNullSafe(F.col("pool_idx")))
    return F.coalesce(there, F.lit(False))


def _best_of_others(kinds: DataFrame, refs: DataFrame, n_bits: int, levels: Sequence[float], list_rows: int) -> DataFrame:
    """(kid, best) of kinds (kid, words, bits, size) among references of other fingerprints; kinds that share no bit are missing."""
    width = n_bits // 64
    counts = {r.bit: r.n for r in refs.select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(range(n_bits), key=lambda b: (counts.get(b, 0), b))
    place = [0] * n_bits
    for at, b in enumerate(order):
        place[b] = at
    ranks = F.from_json(F.lit(json.dumps(place)), "array<int>")
    ordered = F.array_sort(F.transform("bits", lambda b: F.get(ranks, b)))
    refs = cut_lineage(refs.select("words", "size", ordered.alias("bits"), _band(F.col("size")).alias("band")))
    left = cut_lineage(kinds.select("kid", "words", "size", ordered.alias("bits"), F.lit(0.0).alias("best")))
    n_refs = refs.count()
    done = None
    for level in levels:
        mine = F.slice("bits", F.lit(1), F.col("size") - _needed(F.col("size"), F.lit(float(level))) + 1)
        index = refs.select("words", "size", "band", F.explode(mine).alias("bit"))
        lists = cut_lineage(index.groupBy("bit", "band").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / F.lit(list_rows)).cast("int").alias("parts")))
        # a candidate only looks for what is better than it has
        least = F.greatest(F.lit(float(level)), F.col("best"))
        low, high = _band(_needed(F.col("size"), least)), F.when(least > 0, _band(F.least(F.col("size") / least + 1e-9, F.lit(float(n_bits))))).otherwise(_band(F.lit(n_bits)))
        mine = F.slice("bits", F.lit(1), F.col("size") - _needed(F.col("size"), least) + 1)
        asked = left.select("kid", "words", "size", "best", F.explode(mine).alias("bit"), F.sequence(low, high).alias("bands"))
        asked = asked.withColumn("band", F.explode("bands")).drop("bands")
        visits = asked.groupBy("bit", "band").agg(F.count(F.lit(1)).alias("asking")).join(lists, ["bit", "band"]).agg(F.sum(F.col("asking") * F.col("n"))).first()[0] or 0
        if visits > left.count() * n_refs:
            # dense fingerprints: the lists hold more than all pairs do, so every pair is looked at, once
            found = _scan(left, refs, width, list_rows)
            now = left.join(found, "kid", "left").select("kid", F.greatest("best", F.coalesce("value", F.lit(0.0))).alias("best"))
            return now if done is None else done.unionByName(now)
        lists = F.broadcast(lists.select("bit", "band", "parts"))
        blocks = _blocks(index.join(lists, ["bit", "band"]).withColumn("part", _part(F.col("parts"))), ["bit", "band", "part"])
        asked = asked.join(lists, ["bit", "band"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        found = _better(asked.join(blocks, ["bit", "band", "part"]), width)
        now = cut_lineage(left.join(found, "kid", "left").withColumn("best", F.greatest("best", F.coalesce("value", F.lit(0.0)))).drop("value"))
        over = now.filter(F.col("best") >= float(level)).select("kid", "best")
        done = over if done is None else done.unionByName(over)
        left = now.filter(F.col("best") < float(level))
        if left.isEmpty():
            break
    return done


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64("words"), parts).cast("int")


def _blocks(refs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """References of a list as one row: their sizes, and their words one after another."""
    own = refs.groupBy(*keys).agg(F.collect_list(F.struct("size", "words")).alias("refs"))
    return own.select(*keys, F.col("refs.size").alias("sizes"), F.flatten("refs.words").alias("flat"))


def _better(met: DataFrame, width: int) -> DataFrame:
    """(kid, value): the best of the blocks each candidate met, if it beats what the candidate has. Pairs are met in one generated loop, and only
    those that gain go on to the aggregate."""
    # shared / (a + b - shared) > best needs shared > (a + b) best / (1 + best); a little less, so that rounding drops nothing
    met = met.select("kid", "words", "size", "best", (F.col("best") / (F.col("best") + 1) * (1 - 1e-9)).alias("cut"), "flat", F.posexplode("sizes").alias("at", "other_size"))
    shared = F.lit(0)
    for i in range(width):
        shared = shared + F.bit_count(F.get("words", F.lit(i)).bitwiseAND(F.get("flat", F.col("at") * width + i)))
    value = shared / (F.col("size") + F.col("other_size") - shared)
    gains = met.filter(shared >= (F.col("size") + F.col("other_size")) * F.col("cut")).select("kid", "best", value.alias("value"))
    return gains.filter((F.col("value") > F.col("best")) & (F.col("value") < 1.0)).groupBy("kid").agg(F.max("value").alias("value"))


def _scan(left: DataFrame, refs: DataFrame, width: int, list_rows: int) -> DataFrame:
    """(kid, value) over all references in blocks: the first block, broadcast, gives every candidate a bound that few of the other pairs beat."""
    spark = left.sparkSession
    n = refs.count()
    parts = max(-(-n // list_rows), min(SCAN_PARTS, -(-n // SCAN_ROWS)))
    blocks = cut_lineage(_blocks(refs.withColumn("part", _part(F.lit(parts))), ["part"]))
    first = blocks.agg(F.min("part")).first()[0]
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    rows = left.select("kid", "words", "size", "best").repartition(spread, "kid")
    found = _better(rows.join(F.broadcast(blocks.filter(F.col("part") == first).drop("part")), F.lit(True)), width)
    rows = cut_lineage(rows.join(found, "kid", "left").withColumn("best", F.greatest("best", F.coalesce("value", F.lit(0.0)))).drop("value"))
    others = blocks.filter(F.col("part") != first).repartition(spread, "part")
    asked = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).filter(F.col("part") != first).repartition(spread, "part")
    more = _better(asked.join(others, "part"), width)
    return rows.join(more, "kid", "left").select("kid", F.greatest("best", F.coalesce("value", F.lit(0.0))).alias("value"))


def best_similarity(
    candidates: DataFrame, refs: DataFrame, fp: str = "fp", n_bits: int = 2048, name: str = "max_sim", apart: bool = False,
    levels: Sequence[float] = LEVELS, list_rows: int = LIST_ROWS,
) -> DataFrame:
    """``candidates`` with the largest Tanimoto similarity of their on-bits ``fp`` to any row of ``refs``; 0 with none.

    ``apart`` leaves a candidate's own ``pool_idx`` out of its references, for a library held against itself. A NULL ``fp`` counts as one
    without bits, and such a row has similarity 0 to all. Repeated rows stay; other columns of ``candidates`` are kept, those of
    ``refs`` ignored. ``levels`` fall to 0; they and ``list_rows`` change the work, never the result.
    """
    if list(levels) != sorted(levels, reverse=True) or levels[-1] != 0:
        raise ValueError("levels must fall to 0")
    n_bits = 64 * max(1, -(-n_bits // 64))
    key = _fresh(candidates, "packed")
    bits = F.array_distinct(F.coalesce(F.col(fp).cast("array<int>"), F.array().cast("array<int>")))
    ours = candidates.withColumn(key, packed_words(bits, n_bits))
    theirs = refs.select(*(["pool_idx"] if apart else []), packed_words(bits, n_bits).alias("words"), bits.alias("bits"))
    # who has an equal fingerprint among the references
    told = [F.min("pool_idx").alias("low"), F.max("pool_idx").alias("high")] if apart else [F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high")]
    ref_kinds = cut_lineage(theirs.groupBy("words").agg(F.first("bits").alias("bits"), *told).withColumn("size", F.size("bits")).filter("size > 0"))
    equal = ref_kinds.select(F.col("words").alias(key), F.struct("low", "high").alias("same"))
    same = ours.select(*([F.col("pool_idx")] if apart else []), key, bits.alias("bits")).join(equal, key, "left")
    open_kinds = _kinds(same.filter(~_twin("same", apart)).select(F.col(key).alias("words"), "bits"))
    kinds = cut_lineage(open_kinds.withColumn("kid", F.monotonically_increasing_id()))
    best = _best_of_others(kinds, ref_kinds.select("words", "bits", "size"), n_bits, levels, list_rows)
    best = kinds.select("kid", F.col("words").alias(key)).join(best, "kid").select(key, F.col("best").alias("other"))
    facts = _fresh(candidates, "facts")
    table = equal.join(best, key, "full").select(key, F.struct("same", "other").alias(facts))
    out = ours.join(table, key, "left")
    value = F.when(_twin(f"{facts}.same", apart), F.lit(1.0)).otherwise(F.coalesce(F.col(f"{facts}.other"), F.lit(0.0)))
    return out.withColumn(name, value).drop(key, facts)
