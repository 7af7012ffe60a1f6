"""Folds of a training run: side by side, few partitions for fits of many rounds, events parsed once."""

from threading import Barrier

import pytest
from pyspark.sql import functions as F

from tokenfold.operators import events as E
from tokenfold.plans import registry as R
from tokenfold.plans import training as T


class Model:
    def transform(self, rows):
        return rows.withColumn("prediction", F.lit(0.0))


class Recorder:
    """Notes the partitions of its training rows; ``met`` is passed when two fits run at the same time."""

    def __init__(self, seen, met=None):
        self.seen, self.met = seen, met

    def fit(self, rows):
        if self.met is not None:
            self.met.wait()
        self.seen.append(rows.rdd.getNumPartitions())
        return Model()


@pytest.fixture
def rows(spark):
    d = spark.range(400, numPartitions=8).select(F.col("id").alias("sample_id"), (F.col("id") % 4).cast("int").alias("y"), (F.col("id") % 3).cast("int").alias("fold"), F.col("id").alias("v"))
    return T.dense_rows(d, ["v"])


def test_folds_fit_side_by_side(rows):
    met, seen = Barrier(3, timeout=120), []
    valid, _ = T.oof_run(rows, lambda n: Recorder(seen, met), 4, 3)
    assert len(seen) == 3 and valid.count() == 400


def test_rounds_read_few_partitions(rows, monkeypatch):
    few, many = [], []
    T.oof_run(rows, T.by_rounds(lambda n: Recorder(few)), 4, 3)
    T.oof_run(rows, lambda n: Recorder(many), 4, 3)
    assert few == [1] * 3 and many == [8] * 3
    monkeypatch.setattr(T, "ROUND_NUMBERS", 100)
    wide = []
    T.fitted(T.by_rounds(lambda n: Recorder(wide)), rows)
    assert wide == [4]
    assert all(getattr(f, "rounds", False) for f in (T.logistic(), T.linear_svc())) and not hasattr(T.forest(), "rounds")


def test_parts_parse_events_once(spark, monkeypatch):
    cells = spark.createDataFrame([(i, f"g{(i + j) % 5}", None if i % 7 == j else f"R{10 + j}H K{i % 4}*") for i in range(24) for j in range(3)], "sample_id long, gene string, cell string")
    samples = spark.createDataFrame([(i, i % 2, f"l{i % 2}", i // 2 % 3) for i in range(24)], "sample_id long, y int, label string, fold int")
    alone = []
    for f in range(3):  # each fold from its own cells only
        train, held = samples.filter(F.col("fold") != f), samples.filter(F.col("fold") == f)
        own = R.Inputs(cells.join(train.select("sample_id"), "sample_id", "left_semi"), train, 3)
        new = R.Inputs.unseen(cells.join(held.select("sample_id"), "sample_id", "left_semi"), held, own)
        fit = R.fit("jh_v02", own)
        alone.append([{(r["sample_id"], r["feature"], round(r["value"], 9)) for r in fit.transform(x).collect()} for x in (own, new)])
    parsed, parse = [], E.build_events
    monkeypatch.setattr(E, "build_events", lambda c, dialect="em5": parsed.append(dialect) or parse(c, dialect))
    vectors = T.pipeline_parts("jh_v02", R.Inputs(cells, samples, 3), 3)
    assert sorted(parsed) == ["em5", "jh"]
    for (f, train, held), (own, new) in zip(vectors, alone):
        names = sorted({x[1] for x in own})
        for got, want in ((train, own), (held, new)):
            total = {r["sample_id"]: round(float(r["features"].toArray().sum()), 6) for r in got.collect()}
            assert total == {i: pytest.approx(sum(v for s, n, v in want if s == i and n in names), abs=1e-5) for i in total}
        assert {r["fold"] for r in held.collect()} == {f} and train.count() + held.count() == 24


def test_folds_of_a_large_table_run_in_turn(rows, monkeypatch):
    import threading

    monkeypatch.setattr(T, "SIDE_NUMBERS", 100)
    threads = set()

    class Noted(Recorder):
        def fit(self, rows):
            threads.add(threading.get_ident())
            return super().fit(rows)

    T.oof_run(rows, lambda n: Noted([]), 4, 3)
    assert len(threads) == 1


def test_boosted_trees_query_is_whole(spark, monkeypatch):
    from tokenfold.workload import QUERIES
    from tokenfold.workload import q_training as Q

    got = []
    monkeypatch.setattr(Q, "parts", lambda s, d: None)
    monkeypatch.setattr(Q, "scored", lambda valid, *by: spark.range(1).selectExpr("0 fold", "'x' part", "0e0 macro_f1"))
    monkeypatch.setattr(T, "pipeline_oof", lambda parts, estimator, n: got.append(estimator(10).getClassifier()))
    QUERIES["m5_boosted_trees"](spark, "")
    assert got[0].getMaxIter() == 100 and got[0].getMaxDepth() == 6 and got[0].getStepSize() == 0.1
