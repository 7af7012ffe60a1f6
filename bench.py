"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tokenfold import workload
from tokenfold.session import local_session

HEADLINE = [
    "c9_consequence5", "d3_gene_support", "d14_profile_support", "e1_learn_hotspots", "e5_stable_hotspots", "f4_token_summary",
    "f6_f1_summary", "f8_jh_f1", "g1_class_weights", "g5_oof_signature", "g15_f5_oof", "g17_pair_select", "g21_comutation",
    "h2_profile_group", "h8_novelty", "i4_anova_f", "i9_corr_groups", "i16_word_tfidf", "j2_group_folds", "k11_crossfit_select",
    "k15_trial_search", "k26_apply_vote_rules", "k33_select_pair_rule", "l1_macro_f1", "l14_paired_bootstrap", "flagship_oof_signature_f1",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    workload.load()
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    names = sys.argv[1:] or HEADLINE
    workload.QUERIES["d3_gene_support"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    times = {}
    for name in names:
        spark.catalog.clearCache()
        start = time.time()
        workload.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1], "cpus": cpus}))


if __name__ == "__main__":
    main()
