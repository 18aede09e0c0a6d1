"""Collocations against plain counting, and the parts of the partitioned mining."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pickwise.llm import phrases
from tests.llm.helpers import UPPER

DOCS = "doc_id long, text string, lang string, rank string, n string, phrase string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y", "z") for i, (t, lang) in enumerate(rows)], DOCS)


def plain(rows, support, top):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {p: c for p, c in counts.items() if c >= support}
        held = {}
        for p, c in frequent.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i : i + m]] = max(c, held.get(p[i : i + m], 0))
        kept = []
        for p, a in frequent.items():
            if len(p) > 1 and not 100 * held.get(p, 0) >= 80 * a:
                score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def made(seed, docs=120):
    rng = random.Random(seed)
    vocab = ["the", "Of", "new", "york", "city", "Élan", "x y", "a", "b", "c"]
    rows = []
    for _ in range(docs):
        words = []
        for _ in range(rng.randint(0, 60)):
            words += rng.choice([[rng.choice(vocab)], ["new", "york", "city"], ["machine", "learning"], ["machine", "learning", "of", "the"]])
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n"]) for w in words)
        rows.append((text, rng.choice(["en", "en", "en", "fr", None])))
    return rows + [(None, "en"), ("", "de"), (" ,. ", "fr"), ("word " * 3000, "en")] + rows[:20]


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_against_plain_counts(spark, shards):
    """More shards than the support has units included; the result does not depend on them."""
    rows = made(1)
    got = phrases.collocations(frame(spark, rows).repartition(7), support=8, top=60, shards=shards)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 8, 60)


def test_ties_cut_at_the_limit(spark):
    rows = [(f"{a}{b} {a}{c}.", "en") for a in "abcdefgh" for b in "xy" for c in "uv" for _ in range(3)]
    got = sorted(map(tuple, phrases.collocations(frame(spark, rows), support=3, top=5).collect()))
    assert got == plain(rows, 3, 5) and len(got) == 5


def test_empty_table_and_nothing_frequent(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert phrases.collocations(frame(spark, [("a b c", "en"), (None, None)])).collect() == []


def test_local_supports_lose_nothing(spark):
    """Supports less one of all shards stay below the support, for very uneven shards too."""
    sizes = spark.createDataFrame([("en", i, w) for i, w in enumerate([1, 1, 5, 1000, 333, 7])] + [("fr", 0, 9), ("de", 0, 10**17), ("de", 1, 3 * 10**17)], "lang string, shard int, words long")
    told = phrases.local_support(sizes, 30).groupBy("lang").agg(F.sum(F.col("least") - 1).alias("below"), F.min("least").alias("low")).collect()
    assert all(r.below < 30 and r.low >= 1 for r in told)


def test_candidates_are_all_frequent_phrases_and_few_others(spark):
    rows = made(2, 400)
    docs = frame(spark, rows)
    candidates, totals = phrases.mined(docs, 20, 4, 4)
    found = phrases.counted(docs, candidates, 20)
    every = phrases.counted(docs, phrases.mined(docs, 1, 4, 1)[0], 20)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(found) == key(every)
    assert candidates.count() < 3 * found.count()
    assert {r.lang for r in totals.collect()} == {"en", "fr", "und"}


def test_one_key_in_every_partition(spark):
    """A pair that stands in every row of many partitions, in a table that is half copies of one text."""
    rows = [(f"very common pair {i % 7}", "en") for i in range(300)] + [("copied text of many rows", "en")] * 300
    got = phrases.collocations(frame(spark, rows).repartition(40), support=30)
    assert sorted(map(tuple, got.collect())) == plain(rows, 30, 2000)


def test_block_boundaries(spark, monkeypatch):
    """Counts do not depend on how texts are put together."""
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 50)
    texts = [b"a b c", b"", b"b c, a b\nb c", b"A B C " * 30]
    whole = phrases.Block(texts, phrases.np.arange(4, dtype=phrases.np.uint64))
    seen = Counter()
    for n, _, ok in whole.phrases(3):
        seen.update(t.encode() for t in whole.texts(phrases.np.flatnonzero(ok), n).to_pylist())
    want = Counter()
    for t in texts:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", t.lower()):
            w = piece.split()
            want.update(b" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert seen == want
