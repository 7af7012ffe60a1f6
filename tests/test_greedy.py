"""The greedy pass over edges against a plain loop."""

import random

from tokenfold.operators import selection as V


def plain(edges):
    gone = set()
    for i, j in sorted(set(edges)):
        if i not in gone:
            gone.add(j)
    return gone


def dropped(spark, edges, **more):
    got = [r["v"] for r in V.greedy_drop(spark.createDataFrame(edges, "i int, j int"), **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_graphs_with_small_and_large_components(spark):
    rng = random.Random(3)
    edges = [tuple(sorted(rng.sample(range(60), 2))) for _ in range(50)] + [tuple(sorted(rng.sample(range(100, 130), 2))) for _ in range(80)]
    edges += [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 340)] + edges[:9]
    assert dropped(spark, edges) == plain(edges)
    assert dropped(spark, edges, per_task=60) == plain(edges)
    assert dropped(spark, []) == set()


def jobs(spark, run):
    spark.sparkContext.setJobGroup("greedy", "greedy")
    run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup("greedy"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return n


def test_long_chain_and_star_take_few_jobs(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(10_000)], "i int, j int")
    star = spark.createDataFrame([(0, i) for i in range(1, 10_000)], "i int, j int")
    out = {}
    n = jobs(spark, lambda: out.update(chain=V.greedy_drop(chain).count(), star=V.greedy_drop(star).count()))
    assert out == {"chain": 5_000, "star": 9_999} and n < 20
