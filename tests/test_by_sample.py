"""Cells of a sample lie together: what pipelines derive by sample is not shuffled, small learnt tables go to the rows."""

import pytest
from pyspark.sql import functions as F

from tokenfold import session
from tokenfold.operators import genes as G
from tokenfold.plans import registry as R
from tokenfold.session import sent


def own_plan(df):
    """The executed plan without the plans of cached tables."""
    df.collect()
    lines, plan = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan")[0].split("\n"), []
    for line in lines:
        if "InMemoryRelation" in line:
            break
        plan.append(line)
    return "\n".join(plan)


@pytest.fixture
def inputs(spark):
    cells = spark.createDataFrame([(i, f"g{(i + j) % 5}", None if i % 7 == j else f"R{10 + j}H K{i % 4}*") for i in range(24) for j in range(3)], "sample_id long, gene string, cell string")
    samples = spark.createDataFrame([(i, f"l{i % 2}", i // 2 % 3) for i in range(24)], "sample_id long, label string, fold int")
    return R.Inputs(cells, samples, 3)


def test_rows_of_a_sample_are_not_shuffled(inputs):
    part = inputs.shared()[0].part(inputs.samples.filter("fold <> 1"))
    for x in (inputs, part):
        for rows in (x.presence, G.gene_event_count(x.events()), x.events("jyp").select("sample_id").distinct()):
            assert "Exchange" not in own_plan(rows)


def test_small_learnt_tables_go_to_the_rows(spark, inputs, monkeypatch):
    names = spark.createDataFrame([("g1",), ("g2",)], "gene string")
    join = lambda: own_plan(inputs.presence.join(sent(names), "gene", "left_semi"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in join() and "hashpartitioning" not in join()
        monkeypatch.setattr(session, "SENT_ROWS", 1)
        assert "BroadcastHashJoin" not in join()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("block", ["char_tfidf", "jh_tfidf"])
def test_terms_stay_with_their_document(spark, inputs, block):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = {n: session.settle(df) for n, df in R.BLOCKS[block].learn(inputs).items()}
        out = R.BLOCKS[block].apply(state, inputs)
        norms = out.groupBy("sample_id").agg(F.sum(F.col("value") ** 2).alias("n")).collect()
        plan = own_plan(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(term" not in plan and "SortMergeJoin [term" not in plan
    assert len(norms) == 24 and {round(r["n"], 9) for r in norms} == {0.25 if block == "char_tfidf" else 1.0}


def test_features_that_occur_twice_raise(spark):
    rows = lambda *x: spark.createDataFrame(x, "sample_id int, feature string, value double")
    named = lambda *x: rows(*x).withColumn("feature", F.concat_ws("", "feature"))
    good = G.assemble({"a": named((1, "x", 1.0), (2, "x", 2.0)), "b": named((1, "x", 3.0)), "c": rows((1, None, 4.0))})
    assert sorted((r[0], r[1] or "", r[2]) for r in good.collect()) == [(1, "", 4.0), (1, "a__x", 1.0), (1, "b__x", 3.0), (2, "a__x", 2.0)]
    for bad in ({"a": named((1, "x", 1.0), (1, "x", 1.0)), "b": named((1, "x", 3.0))},
                {"a": named((1, "b__x", 1.0)), "a__b": named((1, "x", 1.0))},
                {"a": rows((1, None, 1.0)), "b": rows((1, None, 1.0))}):
        with pytest.raises(Exception, match="duplicate feature|raise_error|RAISED|NULL|null"):
            G.assemble(bad).collect()
