"""Phrase collocations by SON partitioning.

Texts are dealt into a few shards by a hash. A phrase that is frequent in its language must, in at least one shard, reach that shard's
share of the support, in proportion to the shard's words. So every shard is mined completely at that lowered support, the locally
frequent phrases of all shards are united, and one more pass counts every one of them over all texts, exactly.

A shard is not a task: it spans as many tasks as it needs, and its counts are Spark aggregates. Within a shard the lengths follow each
other: a phrase is only counted if both phrases that it holds, one word shorter, are locally frequent. Tasks learn that from a bit table
of bounded size, addressed by a hash; a wrong yes costs work and never a result. Local mining tells phrases apart by 64-bit hashes, which
can only add candidates; the last pass groups by the phrases themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pickwise.llm.common import slices
from pickwise.llm.words import mix, span_hashes
from pickwise.session import cut_lineage

SUPPORT, LONGEST, SHARDS, TOP = 30, 4, 8, 2000
COVERED = (80, 100)  # a candidate goes if a longer one that holds it has this share of its count
MOST_BITS = 1 << 27  # of one bit table: 16 MB
BLOCK_BYTES = 1_500_000  # of text whose words are hashed and counted together
PROBES = 3  # bits of a bit table that stand for one phrase
NO_LANGUAGE = "und"

_U = np.uint64
_STEP = _U(0xD6E8FEB86659FD93)
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True


class Block:
    """Words of some texts, in order, and the phrases they begin. ``keys`` has one 64-bit group key a text."""

    def __init__(self, texts: list[bytes], keys: np.ndarray):
        self.data = b"\n".join(texts).lower()
        raw = np.frombuffer(self.data, dtype=np.uint8)
        edge = np.flatnonzero(np.diff(_GAP[raw].view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = span_hashes(raw, self.start, self.end) if len(self.start) else np.empty(0, dtype=np.uint64)
        # a line break stands between two texts, so no phrase runs from one into the next
        breaks = np.cumsum(_BREAK[raw], dtype=np.int64)
        piece = breaks[self.start] if len(self.start) else np.empty(0, dtype=np.int64)
        self.joined = piece[1:] == piece[:-1]
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.key = np.repeat(keys, np.diff(np.searchsorted(self.start, begin)))
        self.spaced: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, hash of the phrase that begins at each word, whether it lies in one piece)."""
        hashes, whole = self.hash, np.ones(len(self.hash), dtype=bool)
        for n in range(1, longest + 1):
            if n > 1:
                m = max(0, len(self.hash) - n + 1)
                hashes = hashes[:m] * _STEP + self.hash[n - 1 : n - 1 + m]
                whole = whole[:m] & self.joined[n - 2 : n - 2 + m]
            yield n, mix(hashes + _U(n)), whole

    def texts(self, at: np.ndarray, n: int) -> pa.Array:
        """The phrases of n words that begin at the given words, with one space between words."""
        if self.spaced is None:
            raw = np.frombuffer(self.data, dtype=np.uint8)
            # every word with one byte after it, which becomes a space
            size = self.end - self.start + 1
            place = np.cumsum(size) - size
            kept = ~_GAP[raw]
            kept[self.end[:-1]] = True
            flat = np.append(raw[kept], np.uint8(32))
            flat[place + size - 1] = 32
            self.spaced = flat, place, size
        flat, place, size = self.spaced
        first, last = place[at], at + n - 1
        length = place[last] + size[last] - 1 - first
        stop = np.cumsum(length)
        take = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - length - first, length)
        offsets = np.concatenate((np.zeros(1, dtype=np.int32), stop.astype(np.int32)))
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(flat[take])])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of about ``BLOCK_BYTES``; a longer text is a block of its own."""
    for batch in slices(batches, 4000):
        texts = [(t.as_py() or "").encode("utf-8") for t in batch["text"]]
        keys = np.asarray(batch["key"]).view(np.uint64)
        first, size = 0, 0
        for i, text in enumerate(texts):
            if size and size + len(text) > BLOCK_BYTES:
                yield Block(texts[first:i], keys[first:i])
                first, size = i, 0
            size += len(text)
        if first < len(texts):
            yield Block(texts[first:], keys[first:])


def _counted(rows: DataFrame, n: int, known: "BitTable | None") -> DataFrame:
    """(key, phrase, count) of the phrases of n words in every group; ``known`` has the locally frequent ones of n - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            shorter = None
            for m, hashes, whole in block.phrases(n):
                if m == n - 1 and known is not None:
                    shorter = known.has(hashes, block.key[: len(hashes)])
            if shorter is not None:
                whole = whole & shorter[:-1] & shorter[1:]
            at = np.flatnonzero(whole)
            mixed, first, count = np.unique(mix(hashes[at] ^ block.key[at]), return_index=True, return_counts=True)
            if len(mixed):
                at = at[first]
                yield pa.RecordBatch.from_arrays([pa.array(block.key[at].view(np.int64)), pa.array(hashes[at].view(np.int64)), pa.array(count)], ["key", "phrase", "count"])

    return rows.mapInArrow(run, "key long, phrase long, count long").groupBy("key", "phrase").agg(F.sum("count").alias("count"))


class BitTable:
    """A set of (key, phrase hash) pairs as bits; it may hold more than was put in, never less."""

    def __init__(self, words, size: int):
        self.words, self.size = words, size

    @classmethod
    def of(cls, rows: DataFrame) -> "BitTable":
        """From written rows (key, phrase): sixteen bits a row or more, within ``MOST_BITS``. The driver sees the bits only."""
        size = min(MOST_BITS, max(1 << 16, 1 << (16 * rows.count()).bit_length()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mixed = mix(np.asarray(batch["phrase"]).view(np.uint64) ^ np.asarray(batch["key"]).view(np.uint64))
                at = np.concatenate([cls.place(mixed, i, size) for i in range(PROBES)])
                word, each = np.unique(at >> 5, return_inverse=True)
                mask = np.zeros(len(word), dtype=np.int64)
                np.bitwise_or.at(mask, each, np.int64(1) << (at & 31))
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask)], ["word", "mask"])

        told = rows.select("key", "phrase").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        words = np.zeros(size >> 5, dtype=np.uint32)
        words[np.asarray(told["word"])] = np.asarray(told["mask"])
        return cls(rows.sparkSession.sparkContext.broadcast(words), size)

    @staticmethod
    def place(mixed: np.ndarray, probe: int, size: int) -> np.ndarray:
        """The bit of a probe: the halves of a hash step through the table."""
        return ((mixed + _U(probe) * ((mixed >> _U(32)) | _U(1))) & _U(size - 1)).astype(np.int64)

    def has(self, hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), dtype=bool)
        mixed, left = mix(hashes ^ keys), None
        for i in range(PROBES):  # few are left after the first
            at = self.place(mixed if left is None else mixed[left], i, self.size)
            yes = np.flatnonzero((self.words.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1))
            left = yes if left is None else left[yes]
        out[left] = True
        return out


def _rows(docs: DataFrame, shards: int) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE))
    return docs.filter(F.col("text").isNotNull()).select(lang.alias("lang"), F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int").alias("shard"), "text")


def local_support(sizes: DataFrame, support: int) -> DataFrame:
    """Adds ``least`` to (lang, shard, words): the support in proportion to a shard's words, rounded up. Supports of all shards less one
    each add up to less than ``support``, so a phrase below all of them is below it."""
    total = sizes.groupBy("lang").agg(F.sum("words").alias("n"))
    least = F.expr(f"cast((cast({support} as decimal(10,0)) * cast(words as decimal(20,0)) + cast(n as decimal(20,0)) - 1) div cast(n as decimal(20,0)) as long)")
    return sizes.join(total, "lang").withColumn("least", least)


def mined(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Locally frequent phrases of all shards as (key, phrase), key standing for the language, and (lang, n) with all word occurrences."""
    rows = _rows(docs, shards)
    groups = rows.select("lang", "shard").distinct().withColumn("key", F.xxhash64("lang", "shard"))
    keyed = rows.select(F.xxhash64("lang", "shard").alias("key"), "text")
    known, found, supports = None, [], None
    for n in range(1, longest + 1):
        counts = _counted(keyed, n, known)
        if n == 1:
            counts = cut_lineage(counts)
            sizes = counts.groupBy("key").agg(F.sum("count").alias("words")).join(groups, "key")
            supports = cut_lineage(local_support(sizes, support))
        local = counts.join(supports.select("key", "lang", "least"), "key").filter(F.col("count") >= F.col("least"))
        local = cut_lineage(local.select("key", "lang", "phrase"))
        found.append(local)
        known = BitTable.of(local)
    united = found[0]
    for local in found[1:]:
        united = united.unionByName(local)
    return cut_lineage(united.select(F.xxhash64("lang").alias("key"), "phrase").distinct()), supports.groupBy("lang").agg(F.first("n").alias("n"))


def counted(docs: DataFrame, candidates: DataFrame, support: int = SUPPORT, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, words, f) of the candidates with at least ``support`` occurrences in all texts, counted exactly."""
    table = BitTable.of(candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            for n, hashes, whole in block.phrases(longest):
                key = block.key[: len(hashes)]
                at = np.flatnonzero(whole & table.has(hashes, key))
                _, first, count = np.unique(mix(hashes[at] ^ key[at]), return_index=True, return_counts=True)
                at = at[first]
                yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), block.texts(at, n), pa.array(np.full(len(at), n, dtype=np.int32)), pa.array(count)], ["key", "phrase", "words", "count"])

    rows = _rows(docs, 1)
    names = rows.select("lang").distinct().withColumn("key", F.xxhash64("lang"))
    told = rows.select(F.xxhash64("lang").alias("key"), "text").mapInArrow(run, "key long, phrase string, words int, count long")
    told = told.groupBy("key", "phrase", "words").agg(F.sum("count").alias("f")).filter(F.col("f") >= support)
    return told.join(names, "key").select("lang", "phrase", "words", "f")


def _slice(first: int, words: Column) -> Column:
    return F.array_join(F.slice("w", F.lit(first), words), " ")


def maximal(found: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Candidates (two words or more) that no longer candidate with nearly as many occurrences holds."""
    candidates = found.filter(F.col("words") > 1)
    places = [(n, at) for n in range(2, longest) for at in range(1, longest - n + 2)]
    held = F.array(*[F.when((F.col("words") > n) & (F.col("words") >= at + n - 1), _slice(at, F.lit(n))) for n, at in places])
    longer = candidates.filter(F.col("words") > 2).withColumn("w", F.split("phrase", " ")).select("lang", "f", F.explode(held).alias("phrase"))
    top = longer.filter(F.col("phrase").isNotNull()).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    share, whole = COVERED
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = candidates.join(top, ["lang", "phrase"], "left")
    return kept.filter(F.coalesce(wide("longer") * whole < wide("f") * share, F.lit(True))).drop("longer")


_SALTS = {1: 16, 2: 4}  # a single word begins or ends very many phrases, so its count goes to several tasks


def scored(candidates: DataFrame, found: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Adds the counts l and r of the lowest-scoring cut (the earliest of equal ones) and its score."""
    cuts = F.array(*[
        F.when(F.col("words") > k, F.struct(F.lit(k).alias("k"), _slice(1, F.lit(k)).alias("first"), _slice(k + 1, F.col("words") - k).alias("rest")))
        for k in range(1, longest)
    ])
    cut = candidates.withColumn("w", F.split("phrase", " ")).select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(cuts).alias("c")).filter("c IS NOT NULL")
    cut = cut.select("lang", "phrase", "words", "a", "c.k", "c.first", "c.rest")
    salts = lambda k: F.when(k == 1, _SALTS[1]).when(k == 2, _SALTS[2]).otherwise(1)
    spread = found.filter(F.col("words") < longest).select(
        "lang", F.col("phrase").alias("part"), F.col("f").alias("count"), F.explode(F.sequence(F.lit(0), salts(F.col("words")) - 1)).alias("salt")
    )
    for side, words in (("first", F.col("k")), ("rest", F.col("words") - F.col("k"))):
        salted = cut.withColumn("salt", F.pmod(F.hash("phrase"), salts(words)).cast("int"))
        named = spread.select("lang", F.col("part").alias(side), F.col("count").alias("l" if side == "first" else "r"), "salt")
        cut = salted.join(named, ["lang", side, "salt"]).drop("salt", side)
    score = F.expr("cast((cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def ranked(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` rows of each language by score and count, falling, then phrase, with their rank. Every language is cut in 64
    parts first, so what one task ranks in the end does not grow with the data."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(64))).orderBy(*order)
    some = rows.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top).drop("rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` collocations of every language of ``docs`` (text, lang).

    A NULL language is ``und``; a NULL or empty text has no words; other columns, ids among them, are ignored, and repeated rows count
    each. Ties in the score go to the more frequent phrase, then to the lower in byte order. A language without a frequent phrase has no
    row, and an empty table none at all. ``shards`` changes the work, never the result.
    """
    candidates, totals = mined(docs, support, longest, shards)
    found = cut_lineage(counted(docs, candidates, support, longest))
    best = ranked(scored(maximal(found, longest), found, longest), top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
