"""Each stage of the pipeline on a small table against a plain version of its decision."""

import re

import corpus_pipeline
from pickwise.llm.secret_ledger import RULES
from tests.llm.helpers import components, words

SF = "/root/testdata/sf0.001"


def masked(text):
    spans = sorted((m.start(), m.end()) for r in RULES for m in re.finditer(r.pattern, text, re.A) if m.end(r.group) - m.start(r.group) >= r.least)
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.dtypes
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "12 34 !!", "en", "s", 8), (None, "the and of to the", "en", "s", 17)], docs.schema)
    docs = docs.unionByName(extra)
    state = {name: None for name, _ in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES:
        rows = [r.asDict() for r in docs.collect()]
        docs = stage(spark, docs, SF)
        state[name] = (rows, [r.asDict() for r in docs.collect()])
        if name != "pack":
            assert docs.dtypes == columns
            docs = spark.createDataFrame([tuple(r[c] for c, _ in columns) for r in state[name][1]], docs.schema)
    before, after = state["language_id"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {10**6, 10**6 + 1}
    before, after = state["near_duplicates"]
    low = components([(r["doc_id"], r["text"]) for r in before])
    assert sorted(str(r["doc_id"]) for r in after) == sorted({str(c) for _, n, c in low if n} | {str(i) for i, n, _ in low if not n})
    before, after = state["decontaminate"]
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in items]

    def leaked(text):
        w = words(text)
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        return any(len(g & own) >= 0.8 * len(g) for g in grams if g)

    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not leaked(r["text"])}
    before, after = state["redact_secrets"]
    assert sorted((str(r["doc_id"]), masked(r["text"])) for r in before) == sorted((str(r["doc_id"]), r["text"]) for r in after)
    before, after = state["pack"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
