"""Metric queries whose joins and reads must not grow with the number of samples on the driver."""

from tokenfold.operators import metrics as M


def test_predictions_are_not_broadcast(spark, tmp_path):
    from tokenfold.workload import q_metrics as Q

    rows = [(i, "ABCDE"[i % 5]) for i in range(60)]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    p = Q.pred(spark, str(tmp_path))
    plan = p._jdf.queryExecution().sparkPlan().toString().split("InMemoryTableScan")[0]
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted(map(tuple, p.groupBy("model").count().collect())) == [(m, 60) for m in range(3)]


def _counted(spark, df):
    """``df`` with an accumulator that counts how often its rows are computed."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_leaderboard_reads_predictions_for_counts_once(spark):
    rows = [(m, i, i % 2, i % 3, (i + (m if i % 4 == 0 else 0)) % 3) for m in range(3) for i in range(24)]
    pred, seen = _counted(spark, spark.createDataFrame(rows, "model int, sample_id long, fold int, y int, yhat int"))
    got = M.leaderboard(pred, 3).orderBy("model").collect()
    assert [(r["model"], r["rank"], round(r["macro_f1"], 6), r["unique_rescue"]) for r in got] == [(0, 1, 1.0, 0), (1, 2, 0.75, 0), (2, 3, 0.75, 0)]
    assert seen.value <= 3 * len(rows)  # the counts, and both sides of the rescues


def test_select_roles_reads_candidates_once(spark):
    rows = [("a", 0.8, 0.1, 0.2, 3, 0.5, 1, 0, 0), ("b", 0.79, 0.1, 0.1, 2, 0.4, 1, 1, 5), ("c", 0.6, 0.1, 0.3, 1, 0.7, 1, 1, 9), ("d", 0.5, 0.1, 0.3, 1, 0.2, 1, 1, 2)]
    schema = "name string, mean double, se double, gap double, complexity int, worst_floor double, noninferior int, collision int, net_rescue int"
    stats, seen = _counted(spark, spark.createDataFrame(rows, schema))
    got = {r["role"]: (r["name"], r["qualified"]) for r in M.select_roles(stats).collect()}
    assert got == {"primary": ("b", 1), "robustness": ("c", 1), "specialization": ("d", 1)}
    assert seen.value <= len(rows)
