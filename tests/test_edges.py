"""Sources, sinks, contracts, registry, streaming and the driver entry."""

import os

import pytest
from pyspark.sql import functions as F

from tokenfold.operators import events as E
from tokenfold.operators import hotspots as H
from tokenfold.plans import registry as R
from tokenfold.plans import training as T
from tokenfold.sources import tables as A

SF = "/root/testdata/sf0.001"


def test_wide_csv_scan_and_contracts(spark, tmp_path):
    path = str(tmp_path / "train.csv")
    with open(path, "w") as f:
        f.write("ID,SUBCLASS,TP53,KRAS\ns1,A,WT,G12D\ns2,B,R175H,\n")
    wide = A.read_wide(spark, path, "ID", "SUBCLASS")
    assert wide.columns == ["sample_id", "label", "TP53", "KRAS"]
    assert {r["cell"] for r in E.to_cells(wide.drop("label")).collect()} == {"G12D", "R175H"}
    assert A.read_ids(spark, path, "ID").columns == ["sample_id"]
    with pytest.raises(ValueError, match="missing columns"):
        A.require_columns(wide, ["BRAF"])
    with pytest.raises(ValueError, match="order"):
        A.require_columns(wide, ["label", "sample_id", "TP53", "KRAS"], exact=True)
    assert A.schema_parity(wide, wide.select("*")) and not A.schema_parity(wide, wide.select("KRAS", "TP53"))


def test_sinks_round_trip(spark, frame, tmp_path):
    scores = frame("seed int, sample_id int, class_id int, p double", (1, 1, 0, 0.4), (2, 1, 0, 0.6))
    A.write_scores(scores, str(tmp_path / "scores"))
    assert sorted(os.listdir(tmp_path / "scores"))[-2:] == ["seed=1", "seed=2"]
    A.write_predictions(frame("sample_id int, label string", (2, "B"), (1, "A")), str(tmp_path / "pred"))
    back = spark.read.option("header", True).csv(str(tmp_path / "pred")).collect()
    assert [r["sample_id"] for r in back] == ["1", "2"]
    A.write_metrics(frame("name string, v double", ("f1", 0.5)), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).first()["v"] == 0.5


def test_fold_contracts(frame):
    samples = frame("sample_id int", (1,), (2,), (3,))
    A.validate_folds(frame("sample_id int, seed int, fold int", (1, 7, 0), (2, 7, 1), (3, 7, 0)), samples, 2)
    with pytest.raises(ValueError, match="missing_id"):
        A.validate_folds(frame("sample_id int, seed int, fold int", (1, 7, 0), (2, 7, 1)), samples, 2)
    with pytest.raises(ValueError, match="duplicate"):
        A.require_unique(frame("k int", (1,), (1,)), ["k"])


def test_fingerprint_ignores_row_order(frame):
    a = frame("id int, v string", (1, "x"), (2, "y"))
    b = frame("id int, v string", (2, "y"), (1, "x"))
    assert A.table_fingerprint(a, ["id", "v"]).first() == A.table_fingerprint(b, ["id", "v"]).first()


CELLS = [(i, g, c) for i in range(40) for g, c in (
    ("TP53", "R175H R248Q" if i % 2 else "R213X"), ("KRAS", "G12D" if i % 3 == 0 else "WT"), ("APC", None if i % 5 == 0 else "K16fs"),
    ("VHL", "A1A" if i % 4 == 0 else "E7_A9del"), ("PTEN", "R130Q" if i % 2 == 0 else "WT"))]


@pytest.fixture(scope="module")
def inputs(spark):
    cells = spark.createDataFrame(CELLS, "sample_id int, gene string, cell string").filter("cell is null or cell <> 'WT'")
    folds = spark.createDataFrame([(i, "ABCD"[i % 4], (i // 4) % 5) for i in range(40)], "sample_id int, label string, fold int")
    return R.Inputs(cells, folds, 5, (("A", "B"),), {"x": ["A", "B"], "y": ["C", "D"]})


@pytest.mark.parametrize("name", ["baseline", "em_v16", "jh_v02", "jsj_v3", "jyp_f2", "em_H06"])
def test_registered_pipelines_build(inputs, name):
    f = R.build(name, inputs)
    assert f.columns == ["sample_id", "feature", "value"]
    blocks = {r[0] for r in f.select(F.substring_index("feature", "__", 1)).distinct().collect()}
    assert blocks and blocks <= set(R.PIPELINES[name])


def test_registry_links_to_known_blocks():
    assert len(R.PIPELINES) >= 130
    assert {b for blocks in R.PIPELINES.values() for b in blocks} <= set(R.BLOCKS)


def test_oof_run_covers_every_sample(spark, inputs):
    rows = T.label_ids(inputs.samples).withColumn("x", (F.col("sample_id") % 4).cast("double"))
    valid, _ = T.oof_run(T.dense_rows(rows, ["x"]), T.logistic(iterations=5), 4, 5)
    out = valid.collect()
    assert len(out) == 40 and all(abs(sum(r["p"]) - 1) < 1e-6 for r in out)


def test_stream_hotspots_equal_batch(spark, inputs, tmp_path):
    cells = inputs.cells
    src = str(tmp_path / "cells")
    cells.repartition(3).write.parquet(src)
    hot = H.learn_hotspots(E.build_events(cells), 5, 10)
    from tokenfold.streaming import scoring

    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (scoring.stream_hotspots(stream, hot).writeStream.format("memory").queryName("hits").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("hits").collect())
    assert got == sorted(tuple(r) for r in H.apply_hotspots(E.build_events(cells), hot).collect()) and got


def test_stream_scores_are_whole_when_cells_come_late(spark, inputs, tmp_path):
    from tokenfold.operators import genes as G
    from tokenfold.operators import signatures as Z
    from tokenfold.streaming import scoring

    cells = inputs.cells
    src = str(tmp_path / "cells")
    cells.repartition(4, "gene").write.parquet(src)  # a sample's cells are spread over the batches
    cells.limit(20).write.mode("append").parquet(src)  # and some come twice
    weights = Z.class_weights(G.gene_presence(E.build_events(cells)), inputs.samples)
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(src)
    scoring.write_scores(stream, weights, str(tmp_path / "scores"), str(tmp_path / "cp")).awaitTermination()
    got = {(r["sample_id"], r["label"]): (round(r["weighted"], 9), r["matches"]) for r in scoring.latest_scores(spark, str(tmp_path / "scores")).collect()}
    want = Z.signature_score(G.gene_presence(E.build_events(cells)), weights).collect()
    assert got == {(r["sample_id"], r["label"]): (round(r["weighted"], 9), r["matches"]) for r in want} and got


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_entry_runs(spark):
    import __spark_entry__ as D

    assert D.entry(spark).count() == 5
    assert set(D.oracle_sql()) <= set(D.queries())
