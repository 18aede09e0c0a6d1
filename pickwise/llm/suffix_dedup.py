"""Passages that repeat across documents, by a sparse suffix array over words.

Suffixes are kept only where they start at a minimiser: the k-word gram with the smallest hash among those of some window of as many words
as the shortest match asked for. Minimisers depend on content alone, so equal passages keep the same suffixes, about one in sixteen.

Suffixes whose first gram occurs in one document only are dropped. The others get the words around them as context, as far as a
minimiser can lie from the end of a shortest match; equal contexts are one entry, whatever the number of copies. Entries are sorted as
a suffix array, by their words to the right, and once more by their words to the left; each is compared with its neighbours in either
order and the match extended to both sides. Entries that agree with more others than are compared go through an exact step: two entries
share a shortest match if and only if, for some i, their i words to the left and the remaining words to the right are equal, so they are
grouped by each of these keys. Chained over a document's minimisers, matches of any length are covered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.llm.common import slices
from pickwise.llm.words import gram_at, mix, ngrams, per_text
from pickwise.session import cut_lineage

_U = np.uint64


@dataclass(frozen=True)
class Match:
    """``least`` words make a match; ``gram`` words begin a suffix; ``near`` neighbours on either side are compared before the
    exact step. Rows of a gram with more than ``heavy`` of them are not brought together, and at most ``ends`` rows from the ends of
    partitions are compared in one task (more than 2 * ``near`` + 2). These three change costs, never results."""

    least: int = 50
    gram: int = 20
    near: int = 8
    heavy: int = 50_000
    ends: int = 200_000

    @property
    def reach(self) -> int:
        """Words by which a match can go beyond a minimiser on one side before the next minimiser takes over."""
        return self.least - self.gram


def minimisers(words: np.ndarray, m: Match) -> np.ndarray:
    """Places of the kept suffixes; none if the text is shorter than a match."""
    if len(words) < m.least:
        return np.empty(0, dtype=np.int64)
    g = ngrams(words, m.gram)
    view = np.lib.stride_tricks.sliding_window_view(g, m.reach + 1)
    return np.unique(np.argmin(view, axis=1) + np.arange(len(view)))


def _ends(place: np.ndarray, n: int, m: Match) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(place - m.reach, 0), np.minimum(place + m.gram + m.reach, n)


_SAMPLE = "token long, context long, key long, place int"
_SAMPLE_NAMES = ["token", "context", "key", "place"]


def _sample(m: Match):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, out = batch["key"].to_pylist(), []
            for i, words, _, _ in per_text(batch["text"].to_pylist()):
                at = minimisers(words, m)
                if len(at):
                    a, b = _ends(at, len(words), m)
                    gram = ngrams(words, m.gram)[at]
                    context = mix(gram_at(words, a, b) ^ ((at - a) * 1000 + (b - at)).astype(np.uint64))
                    out.append((gram.view(np.int64), context.view(np.int64), np.full(len(at), keys[i], dtype=np.int64), at.astype(np.int32)))
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, dtype=np.int64)] * 3 + [np.empty(0, dtype=np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_SAMPLE_NAMES)

    return run


def _shared(sample: DataFrame, m: Match) -> tuple[DataFrame, DataFrame]:
    """The rows of ``sample`` whose token occurs under two keys, and the tokens of more than ``m.heavy`` rows among these.

    Tokens are judged by partial aggregates. The rows of a heavy token stay where they are, whatever its share: such tokens are fewer
    than rows by ``m.heavy``, and Spark broadcasts their list, or splits the skewed join, by its written size.
    """
    tokens = sample.groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n"))
    tokens = cut_lineage(tokens.filter("low <> high").select("token", "n"))
    heavy = cut_lineage(tokens.filter(F.col("n") > m.heavy).select("token"))
    light = tokens.filter(F.col("n") <= m.heavy).select("token")
    rest = sample.join(heavy, "token", "left_anti").join(light, "token", "left_semi")
    return sample.join(heavy, "token", "left_semi").unionByName(rest), heavy


def _with_widest(members: DataFrame, widest: DataFrame, heavy: DataFrame, m: Match) -> DataFrame:
    """``members`` with the widest match of their context; a context of more than ``m.heavy`` copies is not brought together either."""
    context = ["token", "context"]
    copies = members.join(heavy, "token", "left_semi").groupBy(*context).agg(F.count(F.lit(1)).alias("n"))
    many = cut_lineage(copies.filter(F.col("n") > m.heavy).select(*context))
    wide = cut_lineage(widest.join(many, context, "left_semi"))
    return members.join(many, context, "left_anti").join(widest, context).unionByName(members.join(wide, context))


_ENTRY = "token long, context long, one long, two long, left binary, right binary"
_ENTRY_NAMES = ["token", "context", "one", "two", "left", "right"]


def _entries(m: Match):
    """The words around the wanted places of a text; the left ones nearest first. Four bytes a word, most significant first, so that
    binary order is word order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            wanted = batch["wanted"].to_pylist()
            out = []
            for i, words, _, _ in per_text(batch["text"].to_pylist()):
                short = (words >> _U(32)).astype(">u4")
                for w in wanted[i]:
                    p = w["place"]
                    left = short[max(0, p - m.reach) : p][::-1].tobytes()
                    right = short[p + m.gram : p + m.gram + m.reach].tobytes()
                    out.append((w["token"], w["context"], w["one"], w["two"], left, right))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_ENTRY_NAMES)

    return run


_FOUND = "token long, context long, one long, two long, left binary, right binary, before int, after int"
_FOUND_NAMES = _ENTRY_NAMES + ["before", "after"]
_CROWDED = -1  # ``before`` of an entry that needs the exact step


def _matrix(column: pa.Array, reach: int) -> tuple[np.ndarray, np.ndarray]:
    data = [x.as_py() for x in column]
    size = np.array([len(x) // 4 for x in data], dtype=np.int64)
    flat = np.frombuffer(b"".join(x.ljust(4 * reach, b"\0") for x in data), dtype="<u4").reshape(len(data), reach)
    return flat, size


def _compare(m: Match, side: str):
    """Entries sorted by ``side`` first -> the widest match of each, as words before and after its gram; the entries that agree on
    ``side`` with one beyond the compared neighbours; and the rows at both ends of the partition, whose neighbours may lie in another
    one. The latter two come with their contexts.

    A match has half of its words beyond the gram, or more, on one side. Those that have them on ``side`` are neighbours in this order,
    so an entry in neither order's crowd has met all its matches."""
    wide = m.near + 1

    def extend(a, b, size_a, size_b):
        return np.minimum(np.cumprod(a == b, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64), np.minimum(size_a, size_b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        first = True
        tail: pa.RecordBatch | None = None
        schema = pa.schema([(n, pa.int64()) for n in _ENTRY_NAMES[:4]] + [("left", pa.binary()), ("right", pa.binary()), ("before", pa.int32()), ("after", pa.int32())])

        def edge(rows: pa.RecordBatch, mark: int | None = None) -> pa.RecordBatch:
            marks = pa.array([mark] * rows.num_rows, pa.int32())
            return pa.RecordBatch.from_arrays([*(rows[n] for n in _ENTRY_NAMES), marks, marks], schema=schema)

        for batch in batches:
            batch = batch.select(_ENTRY_NAMES)
            if not batch.num_rows:
                continue
            if first:
                yield edge(batch.slice(0, wide))
                first = False
            if held is not None:
                batch = pa.Table.from_batches([held, batch.cast(held.schema)]).combine_chunks().to_batches()[0]
            held = batch.slice(max(0, batch.num_rows - wide))
            tail = held
            token, context, one, two = (batch[n].to_numpy() for n in _ENTRY_NAMES[:4])
            left, n_left = _matrix(batch["left"], m.reach)
            right, n_right = _matrix(batch["right"], m.reach)
            n = len(token)
            before, after = np.full(n, -1), np.full(n, -1)
            own = one != two  # the same context stands in another document
            whole = own & (n_left + n_right + m.gram >= m.least)
            before[whole], after[whole] = n_left[whole], n_right[whole]
            for d in range(1, min(m.near, n - 1) + 1):
                i = np.flatnonzero(token[:-d] == token[d:])
                if not len(i):
                    break
                j = i + d
                other = own[i] | own[j] | (one[i] != one[j])
                i, j = i[other], j[other]
                l = extend(left[i], left[j], n_left[i], n_left[j])
                r = extend(right[i], right[j], n_right[i], n_right[j])
                enough = l + r + m.gram >= m.least
                for x in (i[enough], j[enough]):
                    np.maximum.at(before, x, l[enough])
                    np.maximum.at(after, x, r[enough])
            i = np.flatnonzero(token[:-wide] == token[wide:])
            if len(i):
                words, size = (right, n_right) if side == "right" else (left, n_left)
                i = i[extend(words[i], words[i + wide], size[i], size[i + wide]) >= m.reach // 2]
                yield edge(batch.take(pa.array(np.unique(np.r_[i, i + wide]))), _CROWDED)
            hit = np.flatnonzero(before >= 0)
            none = pa.nulls(len(hit), pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.array(c[hit]) for c in (token, context, one, two)), none, none, pa.array(before[hit].astype(np.int32)), pa.array(after[hit].astype(np.int32))], schema=schema)
        if tail is not None:
            yield edge(tail)

    return run


_KEYED = "token long, key long, at int, context long, one long, two long"


def _keyed(m: Match):
    """Each entry once for every i up to the reach for which it has i words to the left and the rest to the right, keyed by their hash."""

    def prefixes(words: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), m.reach + 1), dtype=np.uint64)
        for i in range(m.reach):
            out[:, i + 1] = mix(out[:, i] * _U(0x9E3779B97F4A7C15) + words[:, i].astype(np.uint64) + _U(1))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(m.reach + 1)
        for batch in slices(batches):
            left, n_left = _matrix(batch["left"], m.reach)
            right, n_right = _matrix(batch["right"], m.reach)
            key = mix(prefixes(left) + mix(prefixes(right)[:, ::-1] + at.astype(np.uint64)))
            row, i = np.nonzero((at <= n_left[:, None]) & (m.reach - at <= n_right[:, None]))
            token, context, one, two = (batch[n].to_numpy()[row] for n in _ENTRY_NAMES[:4])
            cols = [token, key[row, i].view(np.int64), i.astype(np.int32), context, one, two]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["token", "key", "at", "context", "one", "two"])

    return run


def _exact(crowded: DataFrame, m: Match) -> DataFrame:
    """(token, context, before, after) of the entries that share a match with another document, by keys instead of neighbours.

    The largest shared i is the longest stretch to the left of any match, the smallest one gives the longest to the right.
    """
    keyed = crowded.mapInArrow(_keyed(m), _KEYED)
    shared = keyed.groupBy("token", "key").agg(F.min("one").alias("low"), F.max("two").alias("high")).filter("low <> high").select("token", "key")
    both = keyed.join(shared, ["token", "key"])
    return both.groupBy("token", "context").agg(F.max("at").alias("before"), (F.lit(m.reach) - F.min("at")).alias("after"))


def repeats(docs: DataFrame, m: Match = Match()) -> DataFrame:
    """(doc_id, start, end) of every stretch of words of ``docs`` (doc_id, text) that stands in another document too; end exclusive.

    Words are runs of non-space characters, A-Z as a-z. Stretches of a document do not overlap or touch. NULL, blank and short texts have
    none; rows that repeat in id and text are one document and reported once; a NULL id is kept. Other columns are ignored. Repeats
    within one document alone are not reported.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = keyed.filter(F.col("text").isNotNull()).withColumn("key", F.xxhash64("doc_id", "text"))
    sample = cut_lineage(keyed.select("key", "text").mapInArrow(_sample(m), _SAMPLE))
    shared, heavy = _shared(sample, m)
    members = cut_lineage(shared.distinct())
    entries = members.groupBy("token", "context").agg(F.min("key").alias("one"), F.max("key").alias("two"), F.min(F.struct("key", "place")).alias("at"))
    # as many entries as a text has minimisers at most
    wanted = cut_lineage(entries.groupBy("at.key").agg(F.collect_list(F.struct("at.place", "token", "context", "one", "two")).alias("wanted")))
    texts = keyed.select("key", "text").alias("t").join(wanted.alias("w").hint("shuffle_hash"), "key").select("t.text", "w.wanted")
    around = cut_lineage(texts.mapInArrow(_entries(m), _ENTRY).dropDuplicates(["token", "context"]))
    found, crowded = None, None
    for order in (["token", "right", "left", "context"], ["token", "left", "right", "context"]):
        compare = _compare(m, order[1])
        part = cut_lineage(around.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare, _FOUND))
        both = part.filter("before IS NOT NULL")
        # the rows at the ends of all partitions, a few for each, are compared again until they fit one partition
        while True:
            ends = cut_lineage(part.filter("before IS NULL").select(*_ENTRY_NAMES).distinct())
            parts = -(-ends.count() // m.ends)
            placed = ends.repartitionByRange(parts, *order) if parts > 1 else ends.coalesce(1)
            part = cut_lineage(placed.sortWithinPartitions(*order).mapInArrow(compare, _FOUND))
            both = both.unionByName(part.filter("before IS NOT NULL"))
            if parts <= 1:
                break
        met, left = both.filter(F.col("before") > _CROWDED).select("token", "context", "before", "after"), both.filter(F.col("before") == _CROWDED).select(*_ENTRY_NAMES)
        found = met if found is None else found.unionByName(met)
        crowded = left if crowded is None else crowded.unionByName(left)
    crowded = cut_lineage(crowded.dropDuplicates(["token", "context"]))
    found = found.unionByName(_exact(crowded, m))
    widest = cut_lineage(found.groupBy("token", "context").agg(F.max("before").alias("before"), F.max("after").alias("after")))
    spans = _with_widest(members, widest, heavy, m).select(
        "key", (F.col("place") - F.col("before")).alias("start"), (F.col("place") + m.gram + F.col("after")).alias("end")
    )
    # as many spans as a text has minimisers at most
    merged = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s")).select("key", F.explode(_merged(F.col("s"))).alias("s"))
    ids = keyed.select("key", "doc_id").distinct()
    return merged.join(ids, "key").select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


def _merged(spans):
    """Sorted (start, end) spans with those that overlap or touch joined."""
    kind = "array<struct<start:int,end:int>>"

    def step(acc, x):
        last = F.element_at(acc, -1)
        head = F.slice(acc, 1, F.size(acc) - 1)
        grown = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end")))
        new = F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))
        return F.when(F.size(acc) == 0, new).when(x["start"] <= last["end"], F.concat(head, grown)).otherwise(F.concat(acc, new)).cast(kind)

    return F.aggregate(spans, F.array().cast(kind), step)
