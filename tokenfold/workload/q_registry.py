"""Registered pipelines, block by block, next to the SQL of their blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenfold.plans import registry as R
from tokenfold.workload import RAW, SPEC, query
from tokenfold.workload import q_genes as QG
from tokenfold.workload import q_selection as QX
from tokenfold.workload import q_signatures as QS
from tokenfold.workload import views as W

_FREQUENT = "select gene from {} group by 1 having count(*)>=5"
W.SQL.update({
    "pres5": f"select * from pres where gene in ({_FREQUENT.format('pres')})",
    "fun": "select distinct sample_id, gene from ev where conseq>=2",
    "fun5": f"select * from fun where gene in ({_FREQUENT.format('fun')})",
    "sevc": f"select * from ({RAW['c7_cell_severity']}) where severity>0",
    "pattern": RAW["h1_pattern_key"],
})


def inputs(s, d):
    return R.Inputs(W.cells(s, d), W.labelled(s, d), W.K, (QS.PAIR,), QS.FAMILIES)


def _values(cols: list[str], raw: str, label: str | None = None) -> str:
    names = ", ".join(f"{label}||':{c}'" if label else f"'{c}'" for c in cols)
    return f"select sample_id, unnest([{names}]) feature, unnest([{', '.join(f'{c}*1e0' for c in cols)}]) v from ({raw})"


def wide(name: str, raw: str | None = None, cols: list[str] | None = None) -> str:
    """Non-zero cells of a per-sample summary query."""
    cols = cols or [c for c, _ in SPEC[name] if c != "sample_id"]
    return f"select * from ({_values(cols, raw or RAW[name])}) where v<>0"


def by_label(raw: str, *cols: str) -> str:
    return _values(list(cols), raw, "label")


def flags(feature: str, rows: str) -> str:
    return f"select distinct sample_id, {feature} feature, 1e0 v from ({rows})"


def top_tokens(where: str = "") -> str:
    return f"""select sample_id, gene, token from ev join (select gene, token from ev {where} group by 1,2 having count(*)>=5
 order by count(*) desc, gene, token limit 384) using (gene, token)"""


_SEVERITY = "select sample_id, gene feature, max(conseq)*1e0 v from ev where gene in ({}) group by 1,2"
_WEIGHTS = QS.weights(QS.counts("pres5", ks=QS._FIVE))
_SIGNATURE = QS.oof(w=_WEIGHTS)
_FUNCTIONAL = QS.oof("fun", QS.weights(QS.counts("fun5", ks=QS._FIVE)))
_DISTINCT = """select gene from (select gene, row_number() over (partition by md5(s) order by gene) r
 from (select gene, string_agg(cast(sample_id as varchar), ',' order by sample_id) s from pres group by 1)) where r=1"""
_STABLE = RAW["e5_stable_hotspots"].replace("m>=22", "m>=5").replace("sum(n)>=22", "sum(n)>=5").replace("limit 200", "limit 384")
_PAIRS = QS._COMUT.replace(">=1.05", ">=1.5")
_UNCERTAIN = f"""with k as (select sample_id, key, label, fold from pattern join folds using (sample_id, label)),
 c as (select t.f, key, label, count(*) n from k cross join (select unnest(range(5)) f) t where k.fold<>t.f group by 1,2,3),
 u as (select f, key, ln(1+sum(n)) s, -sum(p*ln(p))/ln((select count(distinct label) from k)) e, max(p) m, cast(count(*)>1 as int) conflict from
  (select *, n/sum(n) over (partition by f, key) p from c) group by 1,2)
 select sample_id, coalesce(s,0) support_log1p, coalesce(e,0) entropy, coalesce(m,0) max_probability, coalesce(conflict,0) conflict
 from k left join u on u.f=k.fold and u.key=k.key"""
_TERMS = f"""select sample_id, 'gene='||gene term from (select distinct sample_id, gene from jh)
 union all select distinct sample_id, 'f3='||part from ({QG._F3}) where part is not null
 union all select sample_id, 'event='||gene||':'||token from jh"""
_TFIDF = f"""with t as ({_TERMS}), v as (select term, ln((1+(select count(*) from samples))/(1e0+count(*)))+1 idf from t group by 1
  having count(*)>=5 or not starts_with(term,'event=')), x as (select sample_id, term, idf from t join v using (term))
 select sample_id, term feature, idf/sqrt(sum(idf*idf) over (partition by sample_id)) v from x"""
_NOT_KEPT = RAW["i13_components"].replace(f">={QX.PHI}", ">=0.98").replace(f">={QX.JAC}", ">=0.95")
_ACTIVE = "(select gene from pres5)"
_CONTRAST = f"""select sample_id, 'AUTOMOBILE_MACHINERY' as label, sum(case when label='AUTOMOBILE' then weighted else -weighted end) weighted_diff,
  sum(case when label='AUTOMOBILE' then matches else -matches end) count_diff from ({_SIGNATURE}) where label in ('AUTOMOBILE','MACHINERY') group by 1"""

BLOCK_SQL = {
    "genes": flags("gene", "select * from pres"),
    "active_genes": flags("gene", "select * from pres5"),
    "severity_active": _SEVERITY.format("select gene from pres5"),
    "severity_capped_distinct": _SEVERITY.format(_DISTINCT),
    "consequence_mix": wide("f2_consequence_mix", RAW["f2_consequence_mix"].replace("from sev group", "from sevc group")),
    "token_summary": wide("f4_token_summary"),
    "complexity": wide("f11_token_complexity"),
    "log_burden": wide("f10_f_counts", cols=["mutation_burden_log1p"]),
    "signature": by_label(_SIGNATURE, "weighted", "matches"),
    "dual_signature": f"""select sample_id, 'all:'||feature feature, v from ({by_label(_SIGNATURE, 'weighted', 'matches')})
 union all select sample_id, 'functional:'||feature, v from ({by_label(_FUNCTIONAL, 'weighted', 'matches')})""",
    "hotspots": flags("gene||':'||token", top_tokens()),
    "functional_hotspots": flags("gene||':'||token", top_tokens("where conseq>=2")),
    "stable_hotspots": flags("gene||':'||token", f"select ev.* from ev join ({_STABLE}) using (gene, token)"),
    "pattern_support": wide("", "select sample_id, ln(1+n) support_log1p, cast(n>=2 as int) seen_multiple from pattern join (select key, count(*) n from pattern group by 1) using (key)",
                            ["support_log1p", "seen_multiple"]),
    "pattern_uncertainty": wide("", _UNCERTAIN, ["support_log1p", "entropy", "max_probability", "conflict"]),
    "comutation": f"""select a.sample_id, cast(rank as varchar) feature, 1e0 v from pres a join pres b on a.sample_id=b.sample_id
 join {_PAIRS} c on c.gene_a=a.gene and c.gene_b=b.gene""",
    "pair_contrast": by_label(_CONTRAST, "weighted_diff", "count_diff"),
    "jh_f1": wide("f8_jh_f1"),
    "global_f3": f"select sample_id, feature, 1e0 v from ({RAW['d18_global_f3']})",
    "jh_tokens": flags("gene||':'||token", "select jh.* from jh join (select gene, token from jh group by 1,2 having count(*)>=10) using (gene, token)"),
    "jh_tfidf": _TFIDF,
    "cell_code": "select sample_id, gene feature, code*1e0 v from codes",
    "aa_profile": f"select sample_id, feature, n*1e0 v from ({RAW['f15_aa_profile']})",
    "jsj3": wide("f14_jsj3_summary"),
    "f1": wide("f6_f1_summary"),
    "gene_consequence": flags("gene||':'||consequence", RAW["d13_gene_consequence"]),
    "f5": by_label(RAW["g15_f5_oof"].replace("t>=100", "t>=5"), "score_sum", "score_mean", "score_max", "bernoulli"),
}


_POSITION = RAW["d15_gene_position_bin"].replace("count(*)>=50", "count(*)>={}")
_TRANSITION = RAW["d16_gene_aa"].replace("count(*)>=20", "count(*)>={}")
_EXACT = "select jy.* from jy join (select gene, token from jy group by 1,2 having count(*)>={}) using (gene, token)"
_F5 = RAW["g15_f5_oof"].replace("t>=100", "t>=5")
BLOCK_SQL |= {
    "raw": f"select sample_id, gene feature, code*1e0 v from ({RAW['b9_ordinal_wt_zero']}) where code<>0",
    "missing_mask": flags("gene", "select * from missing"),
    **{f"gene_position{n}": flags("gene||':'||position_bin", _POSITION.format(m)) for n, m in (("", 3), ("_2", 2))},
    **{f"gene_aa{n}": flags("gene||':'||transition", _TRANSITION.format(m)) for n, m in (("", 3), ("_2", 2))},
    **{f"exact_tokens{n}": flags("gene||':'||token", _EXACT.format(m)) for n, m in (("", 5), ("_10", 10))},
    "f5_selective": by_label(f"select * from ({_F5}) where label in (select label from samples group by 1 order by count(*), label limit 10)",
                             "score_sum", "score_mean", "score_max", "bernoulli"),
    "severity_capped": _SEVERITY.format("select gene from pres"),
    "compact_summary": wide("f5_compact_summary"),
    "functional_signature": by_label(_FUNCTIONAL, "weighted", "matches"),
    "frequent": "select sample_id, gene feature, count(*)*1e0 v from ev where gene in (select gene from pres5) group by 1,2",
}

# The blocks that a pipeline must have, written down beside the registry and not read from it.
_F4 = ["active_genes", "f1", "gene_consequence", "gene_position", "gene_aa", "exact_tokens"]
EXPECTED = {
    "em_v16": ["severity_active", "consequence_mix", "signature", "hotspots"],
    "em_v18": ["severity_active", "token_summary", "functional_signature", "functional_hotspots"],
    "em_v21": ["severity_capped", "compact_summary", "functional_signature", "stable_hotspots"],
    "em_v28": ["severity_capped", "compact_summary", "functional_signature", "stable_hotspots"],
    "em_v24": ["severity_active", "token_summary", "dual_signature", "functional_hotspots"],
    "em_E2": ["severity_active", "consequence_mix", "signature", "hotspots", "pattern_support"],
    "em_E4": ["severity_active", "consequence_mix", "signature", "hotspots", "comutation"],
    "em_E10": ["severity_capped_distinct", "consequence_mix", "signature", "stable_hotspots", "pattern_support", "complexity", "comutation", "pair_contrast"],
    "em_F03": ["severity_active", "token_summary", "dual_signature", "functional_hotspots", "pattern_uncertainty", "complexity", "pair_contrast", "log_burden"],
    "em_H01": ["frequent"], "em_v47": ["active_genes"],
    "jh_v07": ["genes", "jh_f1", "global_f3", "jh_tokens"], "jh_v09": ["jh_tfidf", "jh_f1"],
    "jyp_raw": ["raw"], "jyp_f0": ["raw", "active_genes"], "jyp_f3_no_raw": ["active_genes", "f1", "gene_consequence", "gene_position_2", "gene_aa_2"],
    "jyp_f4_no_raw": _F4, "jyp_f5": ["raw", "active_genes", "f1", "gene_consequence", "gene_position_2", "gene_aa_2", "exact_tokens_10", "f5"],
    "jyp_f5_no_raw_missmask": [*_F4, "f5", "missing_mask"], "jyp_f5_selective_no_raw": [*_F4, "f5_selective", "missing_mask"],
}


def _sql(name: str) -> str | None:
    """Rows, features and total of every expected block; None for thinned tables and pipelines with blocks that have no SQL."""
    blocks = EXPECTED.get(name, ())
    thin = "where f.feature not in (select gene from (" + _NOT_KEPT + ") where gene<>keep)" if name == "em_v47" else ""
    if not blocks or (name in R.THINNED and not thin):
        return None
    return " union all ".join(f"select '{b}' block, count(*) n_rows, count(distinct feature) n_features, sum(round(v, 6)) total from ({BLOCK_SQL[b]}) f {thin} having count(*)>0" for b in blocks)


def _pipeline(name: str) -> None:
    @query(f"registry_{name}", "block:s n_rows n_features total:d", _sql(name))
    def _(s, d):
        x = inputs(s, d)
        f = R.build(name, x)
        return f.groupBy(F.substring_index("feature", "__", 1).alias("block")).agg(
            F.count("*").alias("n_rows"), F.countDistinct("feature").alias("n_features"), F.sum(F.round("value", 6)).alias("total"))


for _name in ("em_v16", "em_v24", "em_E2", "em_E4", "em_E10", "em_F03", "em_G01", "em_v47", "jh_v07", "jh_v09", "jsj_v3", "jyp_f5",
              "em_v18", "em_H01", "jyp_raw", "jyp_f0", "jyp_f3_no_raw", "jyp_f4_no_raw", "jyp_f5_no_raw_missmask", "jyp_f5_selective_no_raw", "jh_v10", "em_v21", "em_v28", "em_v19", "em_v23",
              "jyp_f8", "jyp_f9", "jyp_f11", "pipeComb_v4", "em_H04"):
    _pipeline(_name)
