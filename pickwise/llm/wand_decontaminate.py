"""Benchmark decontamination: BM25 over test items with block-max WAND, then verified overlap.

The test items are the index and every passage of every training text is a query. A passage's score for an item is the BM25 sum over
the item's terms that occur in the passage, divided by the same sum over all the item's terms, so one threshold fits items of any
length. All items above the threshold are retrieved, not a top k. A hit counts if enough of the item's question and of its answer stands
in the passage word for word.

Items are put in classes by their length in words, rounded up to a power of two. Each class has its own index and its own passages, two
cells of the class's length that overlap by one, so every occurrence of an item lies in one passage as a whole, and what is found
depends on the item and the text alone, not on the other items. Before the index is asked, a bound over a
passage's rarer terms is taken for all passages of a batch at once; passages it rules out cannot reach the threshold.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwise.llm.common import slices
from pickwise.llm.words import ngrams, per_text


@dataclass(frozen=True)
class Search:
    threshold: float = 0.6  # of an item's own BM25 sum
    question: float = 0.75  # least share of the question's n-grams in the passage
    answer: float = 0.5
    question_words: int = 5
    answer_words: int = 2
    k1: float = 1.2
    b: float = 0.75
    block: int = 16  # postings a block
    rare: int = 8  # postings of a term up to which the bound over all passages counts it item by item
    least_step: int = 64  # words a cell; a passage is two cells
    shard_chars: int = 16_000_000  # item text that one broadcast index may hold


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-grams; fewer words are one."""
    return np.unique(ngrams(words, min(n, len(words)))) if len(words) else np.empty(0, dtype=np.uint64)


def cell_words(words: int, p: Search) -> int:
    """Words of a cell for items of so many words: the next power of two, or the least."""
    return max(p.least_step, 1 << max(0, words - 1).bit_length())


class Index:
    """Postings of the items of one shard whose cells have ``step`` words, in item order, cut into blocks with their largest impacts."""

    def __init__(self, step: int, ids, q, a, df: dict[int, int], n_items: int, mean: float, p: Search):
        self.p, self.step = p, step
        kept = range(len(ids))
        self.ids = list(ids)
        self.question = [grams(q[i], p.question_words) for i in kept]
        self.answer = [grams(a[i], p.answer_words) for i in kept]
        rows: list[tuple[int, int, float]] = []
        for place, i in enumerate(kept):
            words, tf = np.unique(np.concatenate([q[i], a[i]]), return_counts=True)
            idf = np.array([math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) for w in words.view(np.int64).tolist()])
            impact = idf * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * tf.sum() / mean))
            rows += zip(words.tolist(), [place] * len(words), (impact / impact.sum()).tolist())
        rows.sort()
        self.terms = np.array(sorted({r[0] for r in rows}), dtype=np.uint64)
        self.docs: list[list[int]] = [[] for _ in self.terms]
        self.impacts: list[list[float]] = [[] for _ in self.terms]
        at = {t: k for k, t in enumerate(self.terms.tolist())}
        for t, place, impact in rows:
            self.docs[at[t]].append(place)
            self.impacts[at[t]].append(impact)
        self.top = np.array([max(x) for x in self.impacts])
        self.block_last = [[d[min(i + p.block, len(d)) - 1] for i in range(0, len(d), p.block)] for d in self.docs]
        self.block_top = [[max(x[i : i + p.block]) for i in range(0, len(x), p.block)] for x in self.impacts]
        # frequent terms add at most ``rest`` to an item; the rarer ones must bring what is missing to the threshold
        frequent = np.array([len(d) > p.rare for d in self.docs], dtype=bool)
        per_item = np.zeros(len(kept))
        for t in np.flatnonzero(frequent):
            per_item[self.docs[t]] += self.impacts[t]
        self.rest = per_item
        self.rare = ~frequent
        self.count = np.array([0 if f else len(d) for f, d in zip(frequent, self.docs)], dtype=np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.flat_item = np.array([x for f, d in zip(frequent, self.docs) if not f for x in d], dtype=np.int64)
        self.flat_impact = np.array([x for f, d in zip(frequent, self.impacts) if not f for x in d])

    def possible(self, at: np.ndarray, known: np.ndarray, step: int) -> list[int]:
        """Cells c of ``step`` words such that some item may reach the threshold in cells c and c + 1 of a text."""
        here = np.flatnonzero(known & self.rare[at])
        last = max(0, -(-len(at) // step) - 2)
        met = np.unique((here // step) * len(self.terms) + at[here])
        cell, term = met // len(self.terms), met % len(self.terms)
        n = self.count[term]
        post = np.repeat(self.first[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell, item, impact = np.repeat(cell, n), self.flat_item[post], self.flat_impact[post]
        both = np.concatenate([cell, cell - 1])
        key, place = np.unique(both * len(self.ids) + np.concatenate([item, item]), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([impact, impact]), minlength=len(key))
        reach = total + self.rest[key % len(self.ids)] >= self.p.threshold - 1e-9
        cells = set(np.unique(key[reach] // len(self.ids)).tolist())
        if (self.rest >= self.p.threshold - 1e-9).any():  # an item of frequent terms only
            cells = set(range(last + 1))
        return sorted({min(max(c, 0), last) for c in cells})

    def above(self, terms: list[int]) -> list[tuple[int, float]]:
        """(item, score) of every item that reaches the threshold for a query of distinct terms, by block-max WAND."""
        limit, block = self.p.threshold - 1e-9, self.p.block
        lists = [[self.docs[t][0], t, 0] for t in terms]  # current item, term, position
        out = []

        def advance(entry, item) -> bool:
            docs = self.docs[entry[1]]
            entry[2] = bisect_left(docs, item, entry[2])
            if entry[2] == len(docs):
                return False
            entry[0] = docs[entry[2]]
            return True

        while lists:
            lists.sort()
            total, pivot = 0.0, -1
            for i, e in enumerate(lists):
                total += self.top[e[1]]
                if total >= limit:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            bound, nearest = 0.0, None
            for e in lists[: pivot + 1]:
                k = bisect_left(self.block_last[e[1]], item, e[2] // block)
                if k < len(self.block_last[e[1]]):
                    bound += self.block_top[e[1]][k]
                    end = self.block_last[e[1]][k]
                    nearest = end if nearest is None else min(nearest, end)
            if bound >= limit:
                if lists[0][0] == item:
                    score = sum(self.impacts[e[1]][e[2]] for e in lists[: pivot + 1])
                    if score >= limit:
                        out.append((item, score))
                    target = item + 1
                else:
                    target = item
                moved = range(pivot + 1)
            else:  # no item up to the end of the nearest of these blocks can reach it
                target = nearest + 1 if nearest is not None else item + 1
                if pivot + 1 < len(lists):
                    target = min(target, max(lists[pivot + 1][0], item + 1))
                moved = range(pivot + 1)
            gone = [i for i in moved if lists[i][0] < target and not advance(lists[i], target)]
            for i in reversed(gone):
                del lists[i]
        return out


_OUT = "doc_id long, item_id long, passage_start long, score double, question_hits long, question_grams long, answer_hits long, answer_grams long"
_NAMES = [f.split()[0] for f in _OUT.split(", ")]


def hits_of(words: np.ndarray, index: Index) -> dict[int, tuple]:
    """item -> (passage start, score, question hits, grams, answer hits, grams) of one text: its best passage that passes the check."""
    p, found = index.p, {}
    if not len(words) or not index.ids:
        return found
    at = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    known = index.terms[at] == words
    step = index.step  # a passage is two cells, so an item always lies in one
    for cell in index.possible(at, known, step):
        start, end = cell * step, (cell + 2) * step
        terms = np.unique(at[start:end][known[start:end]])
        sets = None
        for item, score in index.above(terms.tolist()):
            if sets is None:
                part = words[start:end]
                sets = {n: np.unique(ngrams(part, n)) for n in range(1, max(p.question_words, p.answer_words) + 1)}
            counts = []
            for own, n in ((index.question[item], p.question_words), (index.answer[item], p.answer_words)):
                counts += [0 if not len(own) else max(int(np.isin(own, sets[k], assume_unique=True).sum()) for k in ([n] if len(own) > 1 else range(1, n + 1))), len(own)]
            q_hit, q_all, a_hit, a_all = counts
            if q_hit >= p.question * q_all and a_hit >= p.answer * a_all:
                row = (start, round(score, 4), q_hit, q_all, a_hit, a_all)
                old = found.get(item)
                if old is None or (-row[2] - row[4], start) < (-old[2] - old[4], old[0]):
                    found[item] = row
    return found


def indexes(spark: SparkSession, items: DataFrame, p: Search) -> Iterator[Broadcast]:
    """One broadcast list of indexes after another, an index for each class of lengths in it; together they hold all items."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer")).distinct()

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(per_text(batch["question"].to_pylist()), per_text(batch["answer"].to_pylist()))
            words = [np.concatenate([q[1], a[1]]) for q, a in both]
            item, term = batch["item_id"].to_pylist(), [np.unique(w).view(np.int64) for w in words]
            lengths = [len(t) for t in term]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, n in zip(item, lengths) for _ in range(n)], pa.int64()), pa.array([len(w) for w, n in zip(words, lengths) for _ in range(n)], pa.int64()),
                 pa.array(np.concatenate(term) if term else np.empty(0, dtype=np.int64))], names=["item_id", "words", "term"])

    every = items.mapInArrow(terms, "item_id long, words long, term long")
    per_item = every.groupBy("item_id").agg(F.max("words").alias("words"))
    n, mean = per_item.agg(F.count(F.lit(1)), F.avg("words")).first()
    chars = items.agg(F.sum(F.length("question") + F.length("answer"))).first()[0] or 0
    shards = max(1, -(-chars // p.shard_chars))
    df = every.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    for shard in range(shards):
        here = F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard
        rows = items.filter(here).orderBy("item_id", "question", "answer").toArrow()
        known = every.filter(here).select("term").distinct().join(df, "term").toArrow()
        both = dict(zip(known["term"].to_pylist(), known["df"].to_pylist()))
        ids, q, a = rows["item_id"].to_pylist(), *([w[1] for w in per_text(rows[c].to_pylist())] for c in ("question", "answer"))
        classes: dict[int, list[int]] = {}
        for i in range(len(ids)):
            if len(q[i]) + len(a[i]):
                classes.setdefault(cell_words(len(q[i]) + len(a[i]), p), []).append(i)
        pick = lambda x, at: [x[i] for i in at]
        yield spark.sparkContext.broadcast([Index(step, pick(ids, at), pick(q, at), pick(a, at), both, n, mean or 1.0, p) for step, at in sorted(classes.items())])


def contaminated(docs: DataFrame, items: DataFrame, p: Search = Search()) -> DataFrame:
    """One row per (document, item) whose question and answer stand in a passage of the document.

    ``docs`` (doc_id, text), ``items`` (item_id, question, answer). NULL or blank texts match nothing; an item with an empty question or
    answer is judged by the other part. Repeated documents are reported as often as they occur, repeated items once. Items are indexed
    in shards of bounded text, each broadcast by itself; document frequencies and lengths are those of all items.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in indexes(docs.sparkSession, items, p):
        found = narrow.mapInArrow(_search(index), _OUT)
        out = found if out is None else out.unionByName(found)
    return out


def clean_only(docs: DataFrame, items: DataFrame, p: Search = Search(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; a map-only job for each shard of items."""

    def without(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                keep = np.ones(batch.num_rows, dtype=bool)
                for i, words, _, _ in per_text(batch[text_col].to_pylist()):
                    keep[i] = not any(hits_of(words, index) for index in shared.value)
                yield batch.filter(pa.array(keep))

        return run

    for index in indexes(docs.sparkSession, items, p):
        docs = docs.mapInArrow(without(index), docs.schema)
    return docs


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, rows = batch["doc_id"].to_pylist(), []
            for i, words, _, _ in per_text(batch["text"].to_pylist()):
                for index in shared.value:
                    rows += [(ids[i], index.ids[item], *row) for item, row in sorted(hits_of(words, index).items())]
            cols = list(zip(*rows)) if rows else [[] for _ in _NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "score" else pa.int64()) for c, n in zip(cols, _NAMES)], names=_NAMES)

    return run


def split_item(text):
    """(question, answer) columns of an item that is one text: the last quarter of its words, rounded down, stands for the answer."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    cut = n - F.floor(n / 4).cast("int")
    return F.array_join(F.slice(words, 1, F.greatest(cut, F.lit(0))), " "), F.array_join(F.slice(words, cut + 1, F.greatest(n - cut, F.lit(0))), " ")
