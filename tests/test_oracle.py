"""Registered queries against their SQL on the smallest driver tables.

TOKENFOLD_ORACLE=all runs every query, otherwise one of each family is run.
"""

import os

import pytest

from tokenfold import workload

SF = "/root/testdata/sf0.001"
workload.load()
QUICK = ["a10_split_fingerprint", "b10_psi", "c10_parse_event_jh", "d14_profile_support", "e5_stable_hotspots", "f6_f1_summary", "g5_oof_signature",
         "g13_f5_stable", "h5_pattern_uncertainty_oof", "i4_anova_f", "i16_word_tfidf", "j2_group_folds", "k11_crossfit_select",
         "k18_pair_redistribute", "l2_class_report"]
NAMES = sorted(workload.ORACLE) if os.environ.get("TOKENFOLD_ORACLE") == "all" else QUICK
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.fixture(scope="module")
def duck():
    pytest.importorskip("duckdb")
    from oracle_check import connect

    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, name):
    from oracle_check import check

    _, _, _, diff = check(name, workload.QUERIES[name], workload.ORACLE[name], spark, duck, SF)
    assert [d for d in diff if d != "no rows"] == []
