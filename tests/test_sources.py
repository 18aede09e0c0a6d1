import gzip

import pytest
from pyspark.sql import functions as F

from pickwise.operators import align as al
from pickwise.operators import jobs as jb
from pickwise.sources import documents as doc
from pickwise.sources import stores as st
from pickwise.sources import tables as src


def write_gz(path, text):
    with gzip.open(path, "wt") as f:
        f.write(text)
    return str(path)


def test_library_and_tolerant_scores(spark, tmp_path):
    lib = write_gz(tmp_path / "lib.csv.gz", 'smiles,x\nC,1\n"C,C",2\nN,3\nC,4\n')
    assert [r.smiles for r in src.read_library(spark, lib).orderBy("ord").collect()] == ["C", "C,C", "N", "C"]
    scores = write_gz(tmp_path / "s.csv.gz", "smiles,score\nC,1.5\nC,2.5\nN,bad\nO\nC,oops\nN,3\n")
    got = {r.smiles: r.score for r in src.tolerant_scores(src.read_scores(spark, scores)).collect()}
    assert got == {"C": 2.5, "N": 3.0}


def test_strict_labels(spark, tmp_path):
    good = write_gz(tmp_path / "m.csv.gz", "smiles,dock,qed,sa\nC,-7.5,0.5,2\nN,-8,0.25,3\n")
    rows = src.derive_labels(src.read_labels(spark, good), ["smiles"]).collect()
    assert [tuple(r) for r in rows] == [("C", 7.5, 0.5, -2.0), ("N", 8.0, 0.25, -3.0)]
    bad = write_gz(tmp_path / "b.csv.gz", "smiles,dock,qed,sa\nC,x,0.5,2\n")
    with pytest.raises(Exception):
        src.read_labels(spark, bad).collect()


def test_alignment_keeps_label_order_and_last_library_row(spark):
    lib = spark.createDataFrame([("C", 0), ("N", 1), ("C", 2), ("O", 3)], "smiles STRING, lib_ord INT")
    labels = spark.createDataFrame([("N", 0), ("C", 1), ("X", 2), ("C", 3)], "smiles STRING, ord INT")
    rows = al.align(labels, lib, "lib_ord").orderBy("ord").collect()
    assert [(r.smiles, r.lib_ord) for r in rows] == [("N", 1), ("C", 2), ("C", 2)]
    with pytest.raises(ValueError, match="no ids in common"):
        al.require_overlap(al.align(labels, lib.filter("smiles = 'O'"), "lib_ord"))
    with pytest.raises(ValueError, match="differ"):
        al.require_aligned(lib.withColumnRenamed("lib_ord", "pool_idx"), labels.withColumnRenamed("ord", "pool_idx").limit(2))


def test_observation_codec_round_trip(spark):
    docs = spark.createDataFrame([('{"state":"COMPLETED","values":[1.5],"timestamp":12.25,"raw":{"a":1}}',), ('{"state":"FAILED","item_id":"x"}',)], "doc STRING")
    obs = doc.observations_from_json(docs)
    first, second = obs.collect()
    assert (first.pool_idx, first.kind, first.item_id, first.raw, list(first.values)) == (-1, "experimental", "", '{"a":1}', [1.5])
    assert second.values is None and second.qc_passed is False
    again = doc.observations_from_json(doc.observations_to_json(obs).select("doc"))
    assert again.drop("raw").collect() == obs.drop("raw").collect()


def items(spark):
    rows = [("c", 1, "j", f"j:{w}", "experimental", "", "C", i, w, None) for i, w in enumerate(["A02", "A01"])]
    rows.append(("c", 1, "j", "j:x", "blank", "", "", None, "", None))
    return spark.createDataFrame(rows, "campaign_id STRING, round INT, job_id STRING, item_id STRING, kind STRING, compound_id STRING, smiles STRING, pool_idx BIGINT, well_id STRING, replicate_of STRING")


def test_plate_document(spark):
    import json

    row = doc.plate_documents(items(spark)).first()
    p = json.loads(row.payload)
    assert p["protocol_version"] == "v1" and p["round"] == 1 and [w["well"] for w in p["plate"]] == ["A01", "A02", "j:x"]
    assert p["plate"][2]["pool_idx"] == -1 and p["plate"][2]["smiles"] is None and p["plate"][0]["compound_id"] is None
    good, bad = doc.split_valid(doc.plate_documents(items(spark)))
    assert good.count() == 1 and bad.count() == 0


def test_oversize_job_takes_several_documents(spark):
    many = spark.range(500).select(
        F.lit("c").alias("campaign_id"), F.lit(1).alias("round"), F.lit("j").alias("job_id"), F.concat(F.lit("j:"), "id").alias("item_id"),
        F.lit("experimental").alias("kind"), F.lit("").alias("compound_id"), F.lit("").alias("smiles"), F.col("id").alias("pool_idx"),
        F.lit("").alias("well_id"), F.lit(None).cast("string").alias("replicate_of"),
    )
    assert [(r.n_items, r.payload, r.reason) for r in doc.plate_documents(many, capacity=100).collect()] == [(500, None, "more items than wells")]
    whole = doc.plate_documents(many).first()
    assert whole.n_items == 500 and whole.payload.count('"well"') == 500 and whole.reason is None


def test_validation_reasons(spark):
    cases = {
        '{"protocol_version":"v2"}': "unsupported protocol_version: v2",
        '{"protocol_version":"v1","round":1,"plate":[1]}': "missing field: campaign_id",
        '{"protocol_version":"v1","campaign_id":"c","plate":[1]}': "missing field: round",
        '{"protocol_version":"v1","campaign_id":"c","round":1}': "missing field: plate",
        '{"protocol_version":"v1","campaign_id":"c","round":1,"plate":[]}': "plate is not a list with items",
        '{"protocol_version":"v1","campaign_id":"c","round":1,"plate":{"a":1}}': "plate is not a list with items",
        '{"protocol_version":"v1","campaign_id":"c","round":1,"plate":[1]}': None,
        '{"protocol_version":"v1","campaign_id":"c","round":1,"plate":"[1]"}': "plate is not a list with items",
        '{"protocol_version":"v1","campaign_id":null,"round":null,"plate":[null]}': None,
        '{"protocol_version":"v1","campaign_id":"c","round":1,"plate":null}': "plate is not a list with items",
        "not json": "unsupported protocol_version: none",
    }
    df = spark.createDataFrame([(k,) for k in cases], "payload STRING")
    assert {r.payload: r.reason for r in doc.validate_plates(df).collect()} == cases


@pytest.mark.parametrize("text,score", [
    ("mode\n----\n   1      -8.5   0 0\n  2 -7 0 0\n", -8.5), ("1 n/a\n1 -3\n", -3.0), ("1\n10 -5\n", None), ("", None), ("\t1\t-2.25 0\r\n", -2.25),
])
def test_docking_output(spark, text, score):
    assert doc.parse_logs(spark.createDataFrame([(text,)], "text STRING")).first().score == score


def test_affinity_sign_and_missing_truth(spark):
    scored = spark.createDataFrame([(0, "experimental", -8.5, "ok")], "pool_idx BIGINT, kind STRING, score DOUBLE, message STRING")
    assert jb.classify(scored).first().activity == 8.5
    its = spark.createDataFrame([(0, "experimental"), (999, "experimental"), (-1, "blank")], "pool_idx BIGINT, kind STRING")
    truth = spark.createDataFrame([(0, 1.0)], "pool_idx BIGINT, a DOUBLE")
    got = {r.pool_idx: (r.state, r.qc_passed) for r in jb.reveal(its, truth, F.array("a")).collect()}
    assert got == {0: ("COMPLETED", True), 999: ("FAILED", False), -1: ("COMPLETED", False)}


def test_snapshots_and_campaign_header(spark, tmp_path):
    path = str(tmp_path / "state")
    assert st.load_version(spark, path) is None
    st.save_version(spark.range(3), path, 0)
    st.save_version(spark.range(5), path, 1)
    assert st.versions(spark, path) == [0, 1] and st.load_version(spark, path).count() == 5 and st.load_version(spark, path, 0).count() == 3
    (tmp_path / "state" / "version=2").mkdir()  # a write that never finished
    assert st.versions(spark, path) == [0, 1]
    head = str(tmp_path / "head")
    st.save_campaign(spark, {"campaign_id": "c", "seed": 3, "positive_idx": [1, 2]}, head, 0)
    got = st.load_campaign(spark, head)
    assert got["next_batch_seq"] == 0 and got["positive_idx"] == [1, 2] and got["seed"] == 3


def test_history_sink(spark, tmp_path):
    st.write_history(spark.range(2), str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).count() == 2


def test_unreadable_documents_are_kept_apart(spark):
    docs = spark.createDataFrame([
        ('{"item_id":"a","pool_idx":1,"state":"COMPLETED"}',), ("{broken",), (None,), ('{"state":"MELTED"}',), ('{"state":"FAILED","kind":"cat"}',), ("[1]",),
    ], "doc STRING")
    good, bad = doc.split_observations(docs)
    assert [r.item_id for r in good.collect()] == ["a"]
    assert sorted(r.reason for r in bad.collect()) == ["unknown kind", "unknown state"] + ["unreadable JSON"] * 3
    results = spark.createDataFrame([('{"job_id":"j","results":[{"well":"A1","state":"COMPLETED"}]}',), ("nothing",), ('{"job_id":"k"}',), ('{"results":"[1]"}',)], "doc STRING")
    good, bad = doc.split_results(results)
    assert [r.item_id for r in good.collect()] == ["A1"]
    assert sorted(r.reason for r in bad.collect()) == ["no list of results", "no list of results", "unreadable JSON"]
