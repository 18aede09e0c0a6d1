"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwise.session import cut_lineage


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task makes of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def held_out(doc_id: Column) -> Column:
    """True for the fold kept from training: crc32 of the id as text, modulo 5, is 0. A NULL id is never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_sample(df: DataFrame, keys: Sequence[str], size: Column, rows: int, chars: int, label: str | None = None) -> DataFrame:
    """A fixed pseudo-random sample of at most ``rows`` different rows of ``keys`` and at most ``chars`` characters, for fitting only.

    Rows that repeat in ``keys`` count once and are taken in the order of a hash. With a ``label``, one of the keys, every label enters
    with its shortest row, if those fit, and has an equal share of both bounds; what some labels leave over goes to the others. Of more
    labels than ``rows``, the most frequent enter. A row that does not fit what is left is skipped. The driver sees hashes and sizes of little more than ``rows`` rows.
    """
    told = df.select(F.xxhash64(*keys).alias("m"), F.coalesce(size, F.lit(0)).cast("long").alias("n"), (F.col(label) if label else F.lit("")).alias("label"))
    # equal keys have equal sizes and labels
    marks = cut_lineage(told.groupBy("m").agg(F.min("n").alias("n"), F.min("label").alias("label")).filter(F.col("n") <= chars))
    kinds = marks.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.min(F.when(F.col("n") > 0, F.struct("n", "m"))).alias("least")).orderBy(F.desc("rows"), "label").limit(rows).collect()
    if not kinds:
        return df.limit(0)
    share = chars // len(kinds)
    fit = {r.label: r.rows for r in marks.filter(F.col("n") <= share).groupBy("label").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "label").limit(rows).collect()}
    quota = _shares({r.label: fit.get(r.label, 0) for r in kinds}, rows)
    # hashes are uniform: this many of the range hold the quota, but for six standard deviations
    bounds = []
    for r in kinds:
        part = (quota[r.label] + 6 * quota[r.label] ** 0.5 + 20) / max(1, fit.get(r.label, 0))
        bounds.append((r.label, (1 << 63) - 1 if part >= 1 else int(part * (1 << 64)) - (1 << 63)))
    top = df.sparkSession.createDataFrame(bounds, marks.select("label", F.col("m").alias("top")).schema)
    some = marks.filter(F.col("n") <= share).join(F.broadcast(top), "label").filter(F.col("m") <= F.col("top")).select("label", "m", "n").collect()
    queues: dict = {r.label: [] for r in kinds}
    for r in some:
        queues[r.label].append((r.m, r.n))
    least = [(r.least.m, r.least.n) for r in kinds if label and r.least]
    chosen = df.sparkSession.createDataFrame([(m,) for m in _picked(least, [sorted(q) for q in queues.values()], rows, chars)], "m long")
    return df.join(F.broadcast(chosen), F.xxhash64(*keys) == F.col("m"), "left_semi").select(*keys).distinct()


def _shares(have: dict, total: int) -> dict:
    """As equal parts of ``total`` as the numbers in ``have`` allow."""
    out, left = {}, total
    for i, k in enumerate(sorted(have, key=lambda k: have[k])):
        out[k] = min(have[k], -(-left // (len(have) - i)))
        left -= out[k]
    return out


def _picked(least: list[tuple[int, int]], queues: list[list[tuple[int, int]]], rows: int, chars: int) -> list[int]:
    """Marks of ``least``, shortest first, and from ``queues`` of (mark, size), one of each in turn: within equal shares of what is
    left of ``chars``, then from what that leaves over."""
    out: dict[int, None] = {}

    def turns(lists, room, place):
        passed = [[] for _ in lists]
        for turn in range(max(map(len, lists), default=0)):
            for k, q in enumerate(lists):
                if turn < len(q) and q[turn][0] not in out:
                    if len(out) < rows and q[turn][1] <= room[place(k)]:
                        out[q[turn][0]] = None
                        room[place(k)] -= q[turn][1]
                    else:
                        passed[k].append(q[turn])
        return passed

    free = [chars]
    turns([sorted(least, key=lambda x: (x[1], x[0]))], free, lambda k: 0)
    room = [free[0] // len(queues)] * len(queues)
    free[0] -= sum(room)
    later = turns(queues, room, lambda k: k)
    free[0] += sum(room)
    turns(later, free, lambda k: 0)
    return list(out)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b): the smallest id that can be reached.

    Large-star and small-star rounds: every step is a group-by and a join on edges, written to the shared folder, so no group is
    ever collected and a lost executor costs one step. NULL ends are ignored; loops give an id its own component.
    """
    nodes = cut_lineage(edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct())
    pairs = nodes.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = cut_lineage(pairs)
    last = None
    while True:
        # every neighbour above a node is linked to the smallest of the node and its neighbours
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # the lower neighbours of a node, and the node, are linked to the smallest of them
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        pairs = cut_lineage(small.filter("a <> b").distinct())
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    ids = nodes.select(F.col("a").alias("id")).unionByName(nodes.select(F.col("b").alias("id"))).distinct()
    found = pairs.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    out = ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return out
