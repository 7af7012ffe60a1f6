"""Character TF-IDF that counts only wanted terms, against the count of all terms."""

import random

from tokenfold.functions import stats as S
from tokenfold.operators import text as T


def test_only_named_terms_are_counted(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i // 2, " ".join(rng.choice(["ab", "abc", "Abcd", "x", "bcde"]) for _ in range(12))) for i in range(40)]
    # often, but in too few documents: the first choice by totals does not suffice
    rows += [(100, "zzzzzzzz " * 200), (101, None), (102, ""), (None, "abc qqq")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    t = T.char_terms(docs, "doc_id")
    idf = T.learn_idf(t, S.total(docs, S.F.count("*")), 3, 15)
    want = {(r["sample_id"], r["feature"]): r["value"] for r in T.tfidf(t, idf, weight=0.5).collect()}
    asked, all_terms = [], T.char_terms
    monkeypatch.setattr(T, "char_terms", lambda *a, **k: asked.append(k.get("among")) or all_terms(*a, **k))
    got = {(r["sample_id"], r["feature"]): r["value"] for r in T.char_tfidf(docs, "doc_id", 3, 15).collect()}
    assert got.keys() == want.keys() and len(idf.collect()) == 15
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert asked and all(asked) and len(asked[0]) == 15
