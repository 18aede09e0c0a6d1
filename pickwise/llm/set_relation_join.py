"""Exact Jaccard self-join of word-shingle sets with set-relation skipping, and its connected components.

Equal sets are one class. Index lists hold, for each shingle, the classes that have it in their prefix: the first tokens in one global
order, of which two linked sets must share one. The order puts frequent shingles last; any order is right, so approximate counts will do.

Index-level skipping: lists are sorted by set size, and entries carry their place in the prefix; runs of a list whose sizes or places
cannot reach the overlap are passed over. Answer-level skipping: in a long list the members are first compared with the one most similar
to all of them (fewest rare shingles). Those found linked share its component, and what is linked to one member is not asked
again of the others: a second pass over the list compares only members of different components. So a large group of near copies costs
one comparison per member, yet every link that joins two components is found.

Candidates pass a parity bitmap test, which never rejects a link, before whole sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.llm.common import connected_components, fresh, slices
from pickwise.llm.words import mix, per_text, shingle_set
from pickwise.session import cut_lineage

_U = np.uint64


@dataclass(frozen=True)
class Join:
    """``words`` to a shingle; linked if percent * union <= 100 * intersection. ``frequent`` bounds the list of shingles put last in the
    order (16 bytes each, sent to every task); it changes costs, never results, and so do
    ``least``, the sum of counts from which a shingle is on it, and ``counted``, the shingles a task counts at a time."""

    words: int = 5
    percent: int = 75
    frequent: int = 200_000
    least: int = 12
    counted: int = 4_000_000

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Tokens of which a set of size n shares one with any set it is linked to."""
        return n - -(-self.percent * n // 100) + 1

    def index_prefix(self, n: np.ndarray) -> np.ndarray:
        """The same for links to sets that are not smaller."""
        return n - -(-2 * self.percent * n // (100 + self.percent)) + 1

    def overlap(self, a, b):
        """The least intersection of linked sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))


def class_id(s: np.ndarray) -> int:
    """64-bit digest of a sorted set; with the size it names the class."""
    folded = np.bitwise_xor.reduce(mix(s), keepdims=True) + s.sum(keepdims=True) * _U(0x9E3779B97F4A7C15) + _U(len(s))
    return int(mix(folded).view(np.int64)[0])


def parity(s: np.ndarray) -> bytes:
    """Parity of the number of tokens that fall on each bit; as many bits as the next power of two of the size, 64 at least.

    Two sets differ in at least as many tokens as their bitmaps differ in bits. Halves of a bitmap xor to the next smaller one.
    """
    bits = 1 << max(6, (len(s) - 1).bit_length())
    count = np.bincount((mix(s) & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


_FACTS = "key long, doc_id long, n int, cls long, bits binary, token long, df int"
_FACTS_ARROW = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("cls", pa.int64()), ("bits", pa.binary()), ("token", pa.int64()), ("df", pa.int32())])


def _facts(p: Join):
    """Per document its size, class and bitmap; per some million shingles those that several of their classes share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple[int, int], np.ndarray] = {}
        size = 0
        for batch in slices(batches):
            n, cls, bits = [], [], []
            for _, words, _, _ in per_text(batch["text"].to_pylist()):
                s = shingle_set(words, p.words)
                n.append(len(s))
                cls.append(class_id(s) if len(s) else None)
                new = len(s) and (cls[-1], len(s)) not in sets
                bits.append(parity(s) if new else None)
                if new:
                    sets[cls[-1], len(s)] = s
                    size += len(s)
            docs = [batch["key"], batch["doc_id"], pa.array(n, pa.int32()), pa.array(cls, pa.int64()), pa.array(bits, pa.binary())]
            docs += [pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int32())]
            yield pa.RecordBatch.from_arrays(docs, schema=_FACTS_ARROW)
            if size > p.counted:
                yield shared(sets)
                sets, size = {}, 0
        if sets:
            yield shared(sets)

    def shared(sets) -> pa.RecordBatch:
        token, df = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        token, df = token[df > 1], df[df > 1]
        if len(token) > p.frequent // 8:
            top = np.argpartition(-df, p.frequent // 8)[: p.frequent // 8]
            token, df = token[top], df[top]
        none = [pa.nulls(len(token), f.type) for f in list(_FACTS_ARROW)[:5]]
        return pa.RecordBatch.from_arrays([*none, pa.array(token.view(np.int64)), pa.array(df.astype(np.int32))], schema=_FACTS_ARROW)

    return run


_POSTINGS = "token long, cls long, n int, at int, rare int, often boolean"
_POSTINGS_ARROW = pa.schema([("token", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("rare", pa.int32()), ("often", pa.bool_())])


def _postings(p: Join, shared):
    """The prefix of every class: one row per token; a class is left out where its task has met it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, df = shared.value
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches):
            if len(seen) > 1_000_000:  # copies met again later are told apart by the lists
                seen.clear()
            out = []
            for _, words, _, _ in per_text(batch["text"].to_pylist()):
                s = shingle_set(words, p.words)
                if not len(s):
                    continue
                cls = class_id(s)
                if (cls, len(s)) in seen:
                    continue
                seen.add((cls, len(s)))
                k = int(p.prefix(np.int64(len(s))))
                if len(token):
                    place = np.minimum(np.searchsorted(token, s), len(token) - 1)
                    count = np.where(token[place] == s, df[place], 0)
                    rare = int((count == 0).sum())
                    if rare < k:
                        order = np.lexsort((s, count))[:k]
                        out.append((s[order], cls, len(s), rare))
                        continue
                    s = s[count == 0]
                    out.append((s[:k], cls, int(len(count)), rare))
                else:
                    out.append((s[:k], cls, len(s), len(s)))
            lengths = np.array([len(o[0]) for o in out], dtype=np.int64)
            at = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths]) if out else np.empty(0, dtype=np.int32)
            wide = lambda i, kind: np.repeat(np.array([o[i] for o in out], dtype=kind), lengths)
            tokens = np.concatenate([o[0] for o in out]).view(np.int64) if out else np.empty(0, dtype=np.int64)
            rare = wide(3, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (tokens, wide(1, np.int64), wide(2, np.int32), at, rare, at >= rare)], schema=_POSTINGS_ARROW)

    return run


_PAIRS = "a long, b long"


def _short_lists(p: Join):
    """Candidate pairs of lists sorted by (token, n, cls); a list may span batches."""

    def pairs(token, cls, n, at):
        got_a, got_b = [], []
        i, step = np.arange(len(token)), 1
        while True:
            i = i[i + step < len(token)]
            i = i[token[i] == token[i + step]]
            if not len(i):
                break
            j = i + step
            need = p.overlap(n[i], n[j])
            fits = (at[i] < p.index_prefix(n[i])) & (1 + np.minimum(n[i] - at[i], n[j] - at[j]) - 1 >= need) & (n[i] >= need) & (cls[i] != cls[j])
            got_a.append(cls[i[fits]])
            got_b.append(cls[j[fits]])
            step += 1
        if not got_a:
            return None
        a, b = np.concatenate(got_a), np.concatenate(got_b)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            cols = [batch[c].to_numpy() for c in ("token", "cls")] + [batch[c].to_numpy().astype(np.int64) for c in ("n", "at")]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last list may go on in the next batch
            rest = [c[cut:] for c in cols]
            if cut and (found := pairs(*[c[:cut] for c in cols])) is not None:
                yield found
        if rest is not None and (found := pairs(*rest)) is not None:
            yield found

    return run


def _near(p: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, n, x, y in zip(batch["n_a"].to_pylist(), batch["n_b"].to_pylist(), batch["bits_a"].to_pylist(), batch["bits_b"].to_pylist()):
                keep.append(m + n - parity_distance(x, y) >= 2 * p.overlap(m, n))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], names=["a", "b"])

    return run


def _sets(p: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            wanted, cls, data = batch["cls"].to_pylist(), [], []
            for i, words, _, _ in per_text(batch["text"].to_pylist()):
                s = shingle_set(words, p.words)
                if len(s) and class_id(s) == wanted[i]:
                    cls.append(wanted[i])
                    data.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(data, pa.binary())], names=["cls", "data"])

    return run


def _linked(p: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["data_a"], batch["data_b"]):
                x, y = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * same >= p.percent * (len(x) + len(y) - same))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, p: Join) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose sets are linked."""
    side = lambda s: classes.select(F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    near = cut_lineage(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_near(p), _PAIRS))
    needed = near.select(F.col("a").alias("cls")).unionByName(near.select(F.col("b").alias("cls"))).distinct()
    needed = needed.join(classes.select("cls", "doc_id"), "cls")
    # few rows build the hash table; the texts stream past it unsorted
    texts = docs.alias("d").join(needed.alias("u").hint("shuffle_hash"), F.expr("d.doc_id <=> u.doc_id")).select("u.cls", "d.text")
    sets = cut_lineage(texts.mapInArrow(_sets(p), "cls long, data binary").dropDuplicates(["cls"]))
    both = near.join(sets.select(F.col("cls").alias("a"), F.col("data").alias("data_a")), "a").join(sets.select(F.col("cls").alias("b"), F.col("data").alias("data_b")), "b")
    return both.mapInArrow(_linked(p), _PAIRS)


def components(docs: DataFrame, p: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    NULL or blank text: 0 shingles, linked with nothing. component_id is the smallest doc_id reachable by links; a row with a NULL id takes
    part and gets the smallest id of its component, NULL if there is none. Repeated rows are linked; other columns are ignored.
    """
    return _components(docs, p).drop("key", "component")


def _key():
    """Tells rows apart that differ in id or text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _components(docs: DataFrame, p: Join) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    facts = cut_lineage(docs.mapInArrow(_facts(p), _FACTS))
    rows = facts.filter("token IS NULL").select("key", "doc_id", "n", "cls")
    classes = cut_lineage(
        facts.filter("cls IS NOT NULL").groupBy("cls").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.max("bits").alias("bits"))
    )
    # at most ``frequent`` rows reach the driver
    hot = facts.filter("token IS NOT NULL").groupBy("token").agg(F.sum("df").alias("df")).filter(F.col("df") >= p.least)
    hot = hot.orderBy(F.desc("df"), "token").limit(p.frequent).toArrow()
    token, df = hot["token"].to_numpy().view(np.uint64), hot["df"].to_numpy()
    order = np.argsort(token)
    shared = spark.sparkContext.broadcast((token[order], df[order]))
    postings = cut_lineage(docs.mapInArrow(_postings(p, shared), _POSTINGS))

    few = postings.filter(~F.col("often")).select("token", "cls", "n", "at").repartition("token").sortWithinPartitions("token", "n", "cls")
    pairs = few.mapInArrow(_short_lists(p), _PAIRS)
    many = cut_lineage(postings.filter("often").select("token", "cls", "n", "at", "rare").distinct().withColumnRenamed("at", "place"))
    hubs = many.groupBy("token").agg(F.min(F.struct("rare", "n", "cls")).alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    need = lambda x, y: F.ceil(F.lit(p.percent) * (x + y) / (100 + p.percent))
    star = many.join(hubs, "token").filter("cls <> hub.cls").filter(F.least("n", "hub.n") >= need(F.col("n"), F.col("hub.n")))
    star = star.select(F.least("cls", "hub.cls").alias("a"), F.greatest("cls", "hub.cls").alias("b"))
    tried = cut_lineage(pairs.unionByName(star).distinct())
    edges = cut_lineage(_verified(tried, classes, docs, p))

    again = _across(many, edges, tried, p)
    if not again.isEmpty():
        edges = edges.unionByName(cut_lineage(_verified(again, classes, docs, p)))
    found = connected_components(edges)
    whole = classes.join(found.withColumnRenamed("id", "cls"), "cls", "left").select("cls", "doc_id", F.coalesce("component", "cls").alias("component"))
    least = whole.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = whole.join(least, "component").select("cls", "component", "component_id")
    joined = rows.join(by_class, "cls", "left")
    return joined.select(
        "key", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component"
    )


def _across(many: DataFrame, edges: DataFrame, tried: DataFrame, p: Join) -> DataFrame:
    """Pairs of long lists whose components still differ and that were not tried: members outside a list's largest component
    against all others. A list that is one component by now is skipped whole."""
    found = connected_components(edges).withColumnRenamed("id", "cls")
    told = cut_lineage(many.join(found, "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    sizes = told.groupBy("token", "component").agg(F.count(F.lit(1)).alias("members"))
    lists = sizes.groupBy("token").agg(F.max(F.struct("members", "component")).alias("m"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    told = told.join(lists.select("token", F.col("m.component").alias("main")), "token")
    x, y = told.filter("component <> main").alias("x"), told.alias("y")
    met = x.join(y, F.expr("x.token = y.token AND x.component <> y.component"))
    need = F.ceil(F.lit(p.percent) * (F.col("x.n") + F.col("y.n")) / (100 + p.percent))
    room = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    met = met.filter((F.least("x.n", "y.n") >= need) & (room >= need))
    pairs = met.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
    return cut_lineage(pairs.join(tried, ["a", "b"], "left_anti"))


def one_of_each(docs: DataFrame, p: Join = Join()) -> DataFrame:
    """One row of ``docs``, all columns, for each component, and the rows without words.

    The row with the smallest doc_id stays, NULL last; of several with that id, the one with the smallest key. Of rows that repeat in id
    and text one stays.
    """
    every = cut_lineage(_components(docs, p).groupBy("key").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.min("component").alias("component"),
    ))
    first = every.filter("n > 0").groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "key", "_rows")).alias("m"))
    key, rows = fresh(docs, "_key"), fresh(docs, "_rows")
    found = every.filter("n = 0").select("key", "_rows").unionByName(first.select("m.key", "m._rows"))
    found = cut_lineage(found.select(F.col("key").alias(key), F.col("_rows").alias(rows)))
    joined = docs.join(found.hint("shuffle_hash"), _key() == F.col(key))
    kept = joined.select(*[docs[c] for c in docs.columns], rows)
    if found.filter(F.col(rows) > 1).isEmpty():
        return kept.drop(rows)
    single = kept.filter(F.col(rows) == 1).drop(rows)
    return single.unionByName(kept.filter(F.col(rows) > 1).drop(rows).dropDuplicates(["doc_id", "text"]))
