"""Tables that an operator needs several times are derived once."""

import pytest
from pyspark.sql import functions as F

from tokenfold.operators import patterns as P
from tokenfold.operators import quality as Q
from tokenfold.operators import selection as X
from tokenfold.operators import summaries as Y
from tokenfold.operators import text as T
from tokenfold.workload import QUERIES, load, q_search

load()
SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


class Seen(Exception):
    pass


@pytest.mark.parametrize("name, operator", [
    ("i10_corr_greedy", "anova_stability"), ("i11_phi_jaccard", "phi_jaccard"), ("i12_stable_edges", "stable_edges"), ("i13_components", "stable_edges")])
def test_operators_on_pairs_read_a_cached_table(spark, monkeypatch, name, operator):
    def stop(table, *_):
        assert table.is_cached
        raise Seen

    monkeypatch.setattr(X, operator, stop)
    with pytest.raises(Seen):
        QUERIES[name](spark, SF)


def test_gene_features_come_from_cached_counts(spark, monkeypatch):
    def stop(features, *_):
        assert "InMemoryTableScan" in plan(features)
        raise Seen

    monkeypatch.setattr(X, "gene_corr_drop", stop)
    with pytest.raises(Seen):
        QUERIES["i14_gene_corr_drop"](spark, SF)


def test_pair_shares_read_the_counts_once_and_skip_samples_without_id(spark):
    rows = [(1, "A>C"), (1, "A>C"), (1, "A>D"), (2, "A>C"), (None, "A>C"), (2, "C>D")]
    out = Y.aa_pairs_state(spark.createDataFrame(rows, "sample_id int, transition string"), 2, 1, True)
    assert "InMemoryTableScan" in plan(out)
    assert {(r["sample_id"], r["transition"], r["value"]) for r in out.collect()} == {(1, "A>C", 1.0), (2, "A>C", 1.0)}


def test_novelty_joins_rare_tokens_only(spark):
    rows = [(s, "g", t) for s, ts in {1: "abc", 2: "ab", 3: "ad", 4: "a", 5: "ae"}.items() for t in ts] + [(1, None, "z"), (1, "g", None)]
    fold = {1: 0, 2: 1, 3: 2, 4: 0, 5: 1}
    folds = spark.createDataFrame([*fold.items(), (6, 2)], "sample_id int, fold int")
    got = {r["sample_id"]: r for r in P.novelty(spark.createDataFrame(rows, "sample_id int, gene string, token string"), folds, 3).collect()}
    for s in fold:
        own = [r for r in rows if r[0] == s and None not in r]
        count = lambda t, i: sum(r[2] == t and fold[r[0]] != i for r in rows if None not in r)
        assert got[s]["valid"] == pytest.approx(sum(count(r[2], fold[s]) == 0 for r in own) / len(own))
        for i in range(3):
            share = sum(count(r[2], i) <= 1 for r in own) / len(own)
            assert got[s][f"train_{i}"] == (None if i == fold[s] else pytest.approx(share))
    assert got[6]["valid"] == got[6]["train_0"] == 0.0 and got[6]["train_2"] is None


def test_terms_are_counted_where_a_samples_cells_meet(spark):
    cells = spark.createDataFrame([(1, "g", "A1C A1C"), (1, "h", None), (2, "g", "WT"), (None, "g", "A1C"), (4, "g", " ")], "sample_id int, gene string, cell string")
    samples = spark.createDataFrame([(1,), (2,), (3,), (3,)], "sample_id int")
    out = T.document_terms(cells, samples)
    assert "hashpartitioning(sample_id" in plan(out) and ", term#" not in "".join(x for x in plan(out).splitlines() if "Exchange" in x)
    terms = [(r["sample_id"], r["term"]) for r in T.cell_terms(cells).select("sample_id", F.explode("terms").alias("term")).collect()]
    want = {(k, terms.count(k)) for k in terms} | {((2, T.EMPTY), 1), ((3, T.EMPTY), 2)}
    assert {((r["sample_id"], r["term"]), r["tf"]) for r in out.collect()} == want


def test_codes_by_text_are_those_of_the_cells(spark):
    cells = spark.createDataFrame([(1, "g", "b"), (2, "g", "a"), (3, "g", None), (4, "g", "z"), (5, "h", "WT"), (None, "h", "c"), (6, None, "a")],
                                  "sample_id int, gene string, cell string")
    exact = Q.exact_cells(cells)
    by_cell = exact.join(Q.ordinal_wt_zero(cells), ["sample_id", "gene"]).select("gene", "value", "code").distinct()
    assert set(Q.wt_zero_codes(exact).collect()) == set(by_cell.collect()) and len(by_cell.collect()) == 5


def test_probabilities_meet_folds_without_a_broadcast(spark):
    assert "BroadcastHashJoin" not in plan(q_search.seeded(spark, SF)).split("InMemoryTableScan")[0]
    assert "BroadcastHashJoin" not in plan(q_search.folded(q_search.models(spark, SF), spark, SF)).split("InMemoryTableScan")[0]
