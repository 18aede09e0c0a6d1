"""Operators 1, 3 and 10 on cases made to be hard for them."""

import random

from pickwise.llm.common import connected_components
from pickwise.llm import hamming_topk
from pickwise.llm.hamming_topk import top_k
from pyspark.sql import functions as F

from pickwise.llm.set_relation_join import Join, components, one_of_each
from pickwise.llm.suffix_dedup import Match, repeats
from tests.llm.helpers import components as plain_components
from tests.llm.helpers import documents, words

EDGE = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "ONE"), (None, "one"), (None, None), (6, "a b c d e"), (6, "a b c d e")]


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, base, changes):
    out = list(base)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**9)}"
    return out


def near_copies():
    """A large group of near copies of one text that are often closer to it than to each other, chains, and shared passages."""
    rng = random.Random(5)
    base = prose(rng, 120)
    rows = [base] + [edited(rng, base, rng.randint(1, 5)) for _ in range(60)]
    chain = prose(rng, 80)
    for _ in range(12):
        rows.append(chain)
        chain = edited(rng, chain, 1)
    passage = prose(rng, 60)
    rows += [prose(rng, 40) + passage + prose(rng, 40) for _ in range(30)]
    rows += [["to"] * n for n in (3, 5, 50, 400)]
    rng.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, v) for v in r))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def test_join_matches_brute_force(spark):
    docs = near_copies() + EDGE
    # every shingle of a group of five counts as frequent, so all paths are taken
    for p in (Join(), Join(least=3), Join(frequent=0)):
        assert rows_of(components(documents(spark, docs), p)) == ordered(plain_components(docs))


def test_join_of_an_empty_table_and_other_columns(spark):
    assert components(documents(spark, []).withColumnRenamed("source", "cls")).collect() == []


def test_one_of_each_keeps_rows_without_words_and_single_repeats(spark):
    kept = sorted(((r.doc_id, r.text) for r in one_of_each(documents(spark, EDGE)).collect()), key=str)
    assert kept == sorted([(1, None), (2, ""), (3, " \t\n "), (4, "one"), (None, None), (6, "a b c d e")], key=str)


def test_one_of_each_beside_columns_of_its_own_names(spark):
    docs = documents(spark, EDGE).withColumn("_rows", F.lit(5)).withColumn("_key", F.lit("k"))
    got, plain = one_of_each(docs), one_of_each(documents(spark, EDGE))
    assert got.columns == docs.columns and sorted(map(str, got.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_one_of_each_keeps_one_row_of_equal_or_missing_ids(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    other = "k1 k2 k3 k4 k5 k6 k7 k8 k9 k10 k11 k12 k13 k14 k15 k16 k17 k18 k19 k20 k21 k22 k23 k24 k25 k26"
    docs = [(1, text), (1, text + " one"), (None, text + " two"), (None, other), (None, other + " one")]
    kept = [(r.doc_id, r.text.split()[0]) for r in one_of_each(documents(spark, docs)).collect()]
    assert sorted(kept, key=str) == [(1, "a"), (None, "k1")]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (7, 6), (6, 4), (4, 9), (None, 1)] + [(100 + i, 101 + i) for i in range(40)]
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 5: 5, **{i: 4 for i in (4, 6, 7, 8, 9)}, **{i: 100 for i in range(100, 141)}}


def plain_repeats(docs, least=50):
    """Union of the windows of ``least`` words that stand in another document too."""
    seen = {}
    docs = list(dict.fromkeys(d for d in docs if d[1] is not None))
    for k, (_, text) in enumerate(docs):
        w = words(text)
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i : i + least]), set()).add(k)
    out = []
    for k, (doc, text) in enumerate(docs):
        w, span = words(text), None
        for i in range(len(w) - least + 1):
            if len(seen[tuple(w[i : i + least])]) > 1:
                if span and i <= span[1]:
                    span[1] = i + least
                else:
                    span = [i, i + least]
                    out.append((doc, span))
    return ordered((d, *s) for d, s in out)


def test_repeats_match_brute_force(spark):
    rng = random.Random(9)
    passage, long = prose(rng, 55), prose(rng, 400)
    docs = [(i, " ".join(prose(rng, rng.randint(0, 80)) + passage + prose(rng, rng.randint(0, 80)))) for i in range(40)]
    docs += [(50 + i, " ".join(prose(rng, 10) + long[40 * i : 40 * i + 200] + prose(rng, 10))) for i in range(5)]
    docs += [(70, " ".join(prose(rng, 49))), (71, " ".join(prose(rng, 300)))]
    docs += [(80, docs[0][1].upper()), (81, docs[0][1]), (82, docs[0][1])] + EDGE + [(81, docs[0][1])]
    assert rows_of(repeats(documents(spark, docs))) == plain_repeats(docs)


def test_repeats_around_a_frequent_gram(spark):
    """Boilerplate between headings and endings: many agree more to the right, many others more to the left."""
    rng = random.Random(21)
    body, heads, tails = prose(rng, 44), [prose(rng, 4) for _ in range(25)], [prose(rng, 4) for _ in range(25)]
    docs = [(i, " ".join(prose(rng, 40) + rng.choice(heads) + body + rng.choice(tails) + prose(rng, 40))) for i in range(800)]
    want = plain_repeats(docs)
    assert rows_of(repeats(documents(spark, docs))) == want
    # the frequent gram stays where it is, and the ends of partitions take several passes
    assert rows_of(repeats(documents(spark, docs), Match(heavy=30, ends=40))) == want
    copies = docs[:1] + [(1000 + i, docs[0][1]) for i in range(60)] + docs[1:40]
    assert rows_of(repeats(documents(spark, copies), Match(heavy=30))) == plain_repeats(copies)


def test_repeats_of_an_empty_table(spark):
    assert repeats(documents(spark, [])).collect() == []


def test_top_k_matches_brute_force(spark):
    rng = random.Random(3)
    codes = [rng.getrandbits(64) - (1 << 63) for _ in range(120)]
    rows = [(i, codes[i % 120] ^ (1 << rng.randrange(63)) if i % 3 else codes[0]) for i in range(300)]
    rows += [(7, rows[7][1]), (None, 5), (900, None)]
    frame = spark.createDataFrame(rows, "id long, code long").withColumnRenamed("x", "q")
    asked = frame.filter("id % 20 = 0")
    for k, m in ((5, None), (1, 4), (400, 8)):
        got = {}
        for r in top_k(frame, asked, k, m).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbour_id))
        clean = sorted({r for r in rows if None not in r})
        for q, code in clean:
            if q % 20 == 0:
                want = sorted(((code ^ c) & (1 << 64) - 1).bit_count() * 10**6 + i for i, c in clean)[:k]
                assert [(i + 1, w // 10**6, w % 10**6) for i, w in enumerate(want)] == sorted(got[q])


def test_top_k_of_scattered_codes_writes_no_probes_or_hits(spark, monkeypatch):
    """Codes far from each other need nearly every bucket; as rows, probes and hits were many times the table."""
    rng = random.Random(4)
    rows = [(i, rng.getrandbits(64) - (1 << 63)) for i in range(2000)]
    frame, written, write = spark.createDataFrame(rows, "id long, code long"), [], hamming_topk.cut_lineage

    def counted(df):
        written.append((out := write(df)).count())
        return out

    monkeypatch.setattr(hamming_topk, "cut_lineage", counted)
    got = {}
    for r in top_k(frame, frame.filter("id % 20 = 0"), 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbour_id))
    assert max(written) <= len(rows)
    assert sorted(got) == list(range(0, 2000, 20))
    for q, found in got.items():
        want = sorted(((rows[q][1] ^ c) & (1 << 64) - 1).bit_count() * 10**6 + i for i, c in rows)[:4]
        assert [(i + 1, w // 10**6, w % 10**6) for i, w in enumerate(want)] == sorted(found)


def test_top_k_by_probes_alone_by_comparison_alone_and_over_blocks(spark):
    """Copies, near copies and scattered codes; more and fewer rows than k."""
    rng = random.Random(6)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(200)]
    rows = [(i, base[i % 200] ^ (rng.choice([0, 0, 1, 6 << rng.randrange(60)]))) for i in range(600)]
    frame = spark.createDataFrame(rows, "id long, code long")
    asked = frame.filter("id % 60 = 0")
    for k, m, block, probe in ((7, 8, 1 << 20, 0.0), (7, 8, 90, 0.0), (7, None, 90, 1e9), (700, 4, 150, 16.0)):
        got = {}
        for r in top_k(frame, asked, k, m, block, probe).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbour_id))
        for q in range(0, 600, 60):
            want = sorted(((rows[q][1] ^ c) & (1 << 64) - 1).bit_count() * 10**6 + i for i, c in rows)[:k]
            assert [(i + 1, w // 10**6, w % 10**6) for i, w in enumerate(want)] == sorted(got[q])


def test_top_k_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, code long")
    some = spark.createDataFrame([(1, 1)], "id long, code long")
    assert top_k(none, some, 3).collect() == [] and top_k(some, none, 3).collect() == []
