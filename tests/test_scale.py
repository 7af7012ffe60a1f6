"""Registered searches and bootstraps run over their whole grid and all repeats."""

import inspect

import pytest

from tokenfold import workload
from tokenfold.operators import search as X
from tokenfold.workload import q_metrics, q_search


class Asked(Exception):
    pass


@pytest.mark.parametrize("query,module,owner,name,argument,want", [
    ("l14_paired_bootstrap", q_metrics, q_metrics.M, "paired_bootstrap", "repeats", 3000),
    ("l15_bootstrap_se", q_metrics, q_metrics.M, "bootstrap_se", "repeats", 3000),
    ("k34_select_bidirectional_rule", q_search, q_search.X, "select_bidirectional_rule", "values", X.RULE_GRID),
])
def test_queries_ask_for_the_whole_job(spark, monkeypatch, query, module, owner, name, argument, want):
    workload.load()
    signature = inspect.signature(getattr(owner, name))

    def ask(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        raise Asked(bound.arguments[argument])

    monkeypatch.setattr(owner, name, ask)
    for step in ("two3", "model", "folded", "groups"):
        monkeypatch.setattr(module, step, lambda *a: None, raising=False)
    with pytest.raises(Asked) as asked:
        workload.QUERIES[query](spark, "")
    assert asked.value.args[0] == want
