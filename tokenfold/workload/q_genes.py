"""Gene aggregates, hotspots and sample summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenfold.functions import stats as S
from tokenfold.functions import vocabulary as V
from tokenfold.operators import events as E
from tokenfold.operators import genes as G
from tokenfold.operators import hotspots as H
from tokenfold.operators import summaries as Y
from tokenfold.workload import query
from tokenfold.workload import views as W

MARKERS = ["Brand#1.1", "Brand#2.2", "Brand#3.3", "Brand#12.4"]


@query("d1_gene_presence", "sample_id gene:s", "select * from pres")
def _(s, d):
    return G.gene_presence(W.events(s, d))


@query("d2_marker_flags", "sample_id m1 m2 m3 m4", """
 select s.sample_id, coalesce(max(cast(gene='Brand#1.1' as int)),0) m1, coalesce(max(cast(gene='Brand#2.2' as int)),0) m2,
  coalesce(max(cast(gene='Brand#3.3' as int)),0) m3, coalesce(max(cast(gene='Brand#12.4' as int)),0) m4
 from samples s left join pres p using (sample_id) group by 1""")
def _(s, d):
    f = G.marker_flags(W.events(s, d), W.samples(s, d), MARKERS)
    return f.select("sample_id", *[F.col(f"`{g}_mutated`").alias(f"m{i}") for i, g in enumerate(MARKERS, 1)])


@query("d3_gene_support", "gene:s support", "select gene, count(*) support from pres group by 1")
def _(s, d):
    return G.gene_support(W.events(s, d))


@query("d3_event_type_support", "gene:s support",
       "select event_type gene, count(distinct user_id) support from events group by 1")
def _(s, d):
    e = W.table(s, d, "events").select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("gene"))
    return G.gene_support(e)


@query("d4_filter_genes", "gene:s support", "select gene, count(*) support from pres group by 1 having count(*)>=30")
def _(s, d):
    return G.filter_genes(W.events(s, d), 30)


@query("d5_filter_genes_class", "gene:s support class_support", """
 select gene, sum(n) support, max(n) class_support from (select gene, label, count(*) n from pres join samples using (sample_id) group by 1,2)
 group by 1 having sum(n)>=400 or max(n)>=80""")
def _(s, d):
    return G.filter_genes_class(W.events(s, d), W.samples(s, d), 400, 80)


@query("d6_top_genes", "gene:s support rank", """
 select gene, support, row_number() over (order by support desc, gene) rank from (select gene, count(*) support from pres group by 1)
 order by 3 limit 40""")
def _(s, d):
    return G.top_genes(W.events(s, d), 40)


@query("d7_gene_severity", "sample_id gene:s severity", "select sample_id, gene, max(conseq) severity from ev group by 1,2")
def _(s, d):
    return G.gene_severity(W.events(s, d))


@query("d8_gene_functional", "sample_id gene:s", "select distinct sample_id, gene from ev where conseq>=2")
def _(s, d):
    return G.gene_functional(W.events(s, d))


@query("d9_gene_event_count", "sample_id gene:s n_events", "select sample_id, gene, n n_events from gn")
def _(s, d):
    return G.gene_event_count(W.events(s, d))


@query("d10_gene_multi_hit", "sample_id gene:s", "select sample_id, gene from gn where n>=2")
def _(s, d):
    return G.gene_multi_hit(W.events(s, d))


@query("d11_gene_flags", "sample_id gene:s truncating missense splice", """
 select sample_id, gene, max(truncating) truncating, max(missense) missense, max(splice) splice from evf group by 1,2
 having max(truncating)+max(missense)+max(splice)>0""")
def _(s, d):
    return G.gene_flag(W.events(s, d, "f"))


@query("d12_support_filter", "sample_id gene:s", """
 select sample_id, gene from gn where n>=2 and gene in (select gene from gn where n>=2 group by 1 having count(*)>=30)""")
def _(s, d):
    return G.support_filter(G.gene_multi_hit(W.events(s, d)), 30, "gene")


@query("d13_gene_consequence", "sample_id gene:s consequence:s", "select distinct sample_id, gene, consequence from jy")
def _(s, d):
    return G.gene_consequence(W.events(s, d, "jyp"))


@query("d14_profile_support", "gene:s consequence:s support", """
 select gene, consequence, count(distinct p) support from (select distinct sample_id, gene, consequence from jy)
 join (select sample_id, string_agg(concat(gene,':',token),'|' order by concat(gene,':',token)) p from jy group by 1) using (sample_id)
 group by 1,2""")
def _(s, d):
    from tokenfold.operators import patterns as P

    e = W.events(s, d, "jyp")
    return G.profile_support(G.gene_consequence(e), P.profile_group(e, W.samples(s, d)))


_JB = """case when position<=50 then 'pos_1_50' when position<=100 then 'pos_51_100' when position<=250 then 'pos_101_250'
  when position<=500 then 'pos_251_500' when position<=1000 then 'pos_501_1000' else 'pos_gt_1000' end"""


@query("d15_gene_position_bin", "sample_id gene:s position_bin:s", f"""
 with b as (select distinct sample_id, gene, {_JB} position_bin from jy where position>=1)
 select b.* from b join (select gene, position_bin from b group by 1,2 having count(*)>=50) using (gene, position_bin)""")
def _(s, d):
    return G.gene_position_bin(W.events(s, d, "jyp"), 50)


@query("d16_gene_aa", "sample_id gene:s transition:s", """
 with b as (select distinct sample_id, gene, transition from jy where transition is not null)
 select b.* from b join (select gene, transition from b group by 1,2 having count(*)>=20) using (gene, transition)""")
def _(s, d):
    return G.gene_aa(W.events(s, d, "jyp"), 20)


_F3 = f"""select sample_id, gene, unnest([
  case when aa_from in ({",".join(repr(a) for a in V.AMINO_ACIDS + "*X")}) then concat('AA_FROM=',aa_from) end,
  case when aa_to in ({",".join(repr(a) for a in V.AMINO_ACIDS + "*X")}) then concat('AA_TO=',aa_to) end,
  case when aa_from is not null and aa_to is not null then concat('AA_CHANGE=',aa_from,'>',aa_to) end,
  case when position is not null then concat('POSITION_BIN=',case when position<=50 then '1-50' when position<=100 then '51-100'
   when position<=200 then '101-200' when position<=400 then '201-400' when position<=800 then '401-800' else '801+' end) end]) part from jh"""


@query("d17_gene_f3_tokens", "sample_id feature:s",
       f"select distinct sample_id, concat(gene,'__',part) feature from ({_F3}) where part is not null")
def _(s, d):
    return G.gene_f3_tokens(W.events(s, d, "jh"))


@query("d18_global_f3", "sample_id feature:s", f"select distinct sample_id, part feature from ({_F3}) where part is not null")
def _(s, d):
    return G.global_f3(W.events(s, d, "jh"))


@query("d19_vocab_apply", "sample_id feature:s", f"""
 with f as (select distinct sample_id, concat(gene,'__',part) feature from ({_F3}) where part is not null)
 select f.* from f join folds using (sample_id) where fold=0 and feature in (
  select feature from f join folds using (sample_id) where fold<>0 group by 1 having count(*)>=100)""")
def _(s, d):
    f = G.gene_f3_tokens(W.events(s, d, "jh")).join(W.labelled(s, d).select("sample_id", "fold"), "sample_id")
    return G.vocab_apply(f.filter("fold = 0"), G.learn_vocab(f.filter("fold <> 0"), 100))


@query("d20_stable_gene_onehot", "sample_id gene:s conseq", """
 select distinct sample_id, gene, conseq from ev where gene in (select gene from pres group by 1 having count(*)>=350)""")
def _(s, d):
    e = W.events(s, d)
    return G.stable_gene_onehot(e, G.filter_genes(e, 350))


_PATH = "select p_type pathway, concat(p_brand,'.',cast(cast(floor(p_size/10e0) as int) as varchar)) gene from part group by 1,2 having count(*)>=3"


@query("d21_pathway_scores", "sample_id pathway:s n any rate:d", f"""
 select sample_id, pathway, count(*) n, 1 "any", count(*)/max(size) rate from pres
 join (select *, count(*) over (partition by pathway) size from ({_PATH})) using (gene) group by 1,2""")
def _(s, d):
    p = W.table(s, d, "part")
    gene = F.concat("p_brand", F.lit("."), F.floor(F.col("p_size") / 10).cast("string"))
    path = p.groupBy(F.col("p_type").alias("pathway"), gene.alias("gene")).count().filter("count >= 3")
    return G.pathway_scores(W.events(s, d), path)


@query("d22_code_flags", "sample_id gene:s kind:s", """
 select sample_id, gene, k kind from (select sample_id, gene, code, unnest(['MUT','FS','STOP','MISSENSE','SILENT']) k from codes)
 where (k='MUT' and code>0) or (k='FS' and code>=1000) or (k='STOP' and floor(code/100)%10>0)
  or (k='MISSENSE' and floor(code/10)%10>0) or (k='SILENT' and code%10>0)""")
def _(s, d):
    return G.code_flags(E.cell_code(W.events(s, d, "jsj3")))


@query("d23_assemble", "sample_id feature:s value:d", """
 select sample_id, concat('gene__',gene) feature, 1 as value from pres
 union all select sample_id, concat('count__',gene), n from gn
 union all select sample_id, 'summary__burden', count(*) from pres group by 1""")
def _(s, d):
    e = W.events(s, d)
    one = F.lit(1.0).alias("value")
    return G.assemble({
        "gene": G.gene_presence(e).select("sample_id", F.col("gene").alias("feature"), one),
        "count": G.gene_event_count(e).select("sample_id", F.col("gene").alias("feature"), F.col("n_events").alias("value")),
        "summary": G.gene_presence(e).groupBy("sample_id").agg(F.count("*").alias("value"))
                    .select("sample_id", F.lit("burden").alias("feature"), "value")})


# --- hotspots -------------------------------------------------------------
_HOT = """select *, row_number() over (order by support desc, gene, token) rank from (
 select gene, token, count(*) support from ev {where} group by 1,2 having count(*)>=20) order by rank limit 200"""


@query("e1_learn_hotspots", "gene:s token:s support rank", _HOT.format(where=""))
def _(s, d):
    return H.learn_hotspots(W.events(s, d), 20, 200)


@query("e2_apply_hotspots", "sample_id rank gene:s token:s",
       f"select sample_id, rank, gene, token from ev join ({_HOT.format(where='')}) using (gene, token)")
def _(s, d):
    e = W.events(s, d)
    return H.apply_hotspots(e, H.learn_hotspots(e, 20, 200))


@query("e3_functional_hotspots", "gene:s token:s support rank", _HOT.format(where="where conseq>=2"))
def _(s, d):
    return H.functional_hotspots(W.events(s, d), 20, 200)


@query("e4_synonymous_hotspots", "gene:s token:s support rank", _HOT.format(where="where conseq=1"))
def _(s, d):
    return H.synonymous_hotspots(W.events(s, d), 20, 200)


@query("e5_stable_hotspots", "gene:s token:s support stable_folds rank", """
 with t as (select gene, token, fold, count(*) n from ev join folds using (sample_id) group by 1,2,3),
 o as (select gene, token, k, sum(case when fold<>k then n else 0 end) m from t cross join (select unnest(range(5)) k) group by 1,2,3)
 select *, row_number() over (order by stable_folds desc, support desc, gene, token) rank from (
  select gene, token, sum(n) support, max(f) stable_folds from t join (select gene, token, count(*) filter (m>=22) f from o group by 1,2) using (gene, token)
  group by 1,2 having sum(n)>=22 and max(f)>=4) order by rank limit 200""")
def _(s, d):
    return H.stable_hotspots(W.events(s, d), W.labelled(s, d), 22, 4, 200)


@query("e6_exact_vocab", "gene:s token:s support", "select gene, token, count(*) support from jy group by 1,2 having count(*)>=10")
def _(s, d):
    return H.exact_vocab(W.events(s, d, "jyp"), 10)


@query("e7_hotspot_count", "sample_id hotspot_mutation_count", f"""
 select s.sample_id, count(h.rank) hotspot_mutation_count from samples s left join
 (select sample_id, rank from ev join ({_HOT.format(where='')}) using (gene, token)) h using (sample_id) group by 1""")
def _(s, d):
    e = W.events(s, d)
    return H.hotspot_count(e, H.learn_hotspots(e, 20, 200), W.samples(s, d))


@query("e8_gene_hotspot", "sample_id gene:s",
       f"select distinct sample_id, gene from ev join ({_HOT.format(where='')}) using (gene, token)")
def _(s, d):
    e = W.events(s, d)
    return H.gene_hotspot(e, H.learn_hotspots(e, 20, 200))


# --- sample summaries -------------------------------------------------------
def _zero(cols: str, table: str) -> str:
    """Left join an aggregate to all samples with zeros."""
    picks = ", ".join(f"coalesce({c},0) {c}" for c in cols.split())
    return f"select sample_id, {picks} from samples left join ({table}) using (sample_id)"


@query("f1_burden", "sample_id burden burden_log1p:d burden_rate:d", f"""
 select sample_id, burden, ln(1+burden) burden_log1p, burden/(select count(distinct gene) from ev) burden_rate
 from ({_zero('burden', 'select sample_id, count(*) burden from pres group by 1')})""")
def _(s, d):
    return Y.burden(W.events(s, d), W.samples(s, d))


_LV = [(1, "synonymous"), (2, "missense"), (3, "inframe_complex"), (4, "truncating")]


@query("f2_consequence_mix", "sample_id burden " + " ".join(f"count_{x}" for _, x in _LV) + " " + " ".join(f"ratio_{x}:d" for _, x in _LV), f"""
 select *, {", ".join(f"count_{x}/greatest(burden,1) ratio_{x}" for _, x in _LV)} from
 ({_zero("burden " + " ".join(f"count_{x}" for _, x in _LV), "select sample_id, count(*) burden, " + ", ".join(f"count(*) filter (severity={i}) count_{x}" for i, x in _LV) + " from sev group by 1")})""")
def _(s, d):
    return Y.consequence_mix(G.gene_severity(W.events(s, d, "em4")), W.samples(s, d))


_LI = [(1, "synonymous"), (2, "missense"), (3, "indel"), (4, "truncating")]


@query("f3_severity_summary", "sample_id burden severity_sum severity_max burden_log1p:d " + " ".join(f"{x}_count" for _, x in _LI) + " " + " ".join(f"{x}_ratio:d" for _, x in _LI), f"""
 select *, ln(1+burden) burden_log1p, {", ".join(f"{x}_count/greatest(burden,1) {x}_ratio" for _, x in _LI)} from
 ({_zero("burden severity_sum severity_max " + " ".join(f"{x}_count" for _, x in _LI), "select sample_id, count(*) burden, sum(severity) severity_sum, max(severity) severity_max, " + ", ".join(f"count(*) filter (severity={i}) {x}_count" for i, x in _LI) + " from sev group by 1")})""")
def _(s, d):
    return Y.severity_summary(G.gene_severity(W.events(s, d, "em4")), W.samples(s, d))


_G5 = "select sample_id, gene, count(*) n, " + ", ".join(f"count(*) filter (conseq={i}) c{i}" for i in range(1, 6)) + " from ev group by 1,2"
_T5 = ("select sample_id, count(*) genes, sum(n) tokens, sum(n-c1) functional, count(*) filter (n>c1) functional_genes, "
       "count(*) filter (n>=2) multi_genes, " + ", ".join(f"sum(c{i}) c{i}" for i in range(1, 6)) + f" from ({_G5}) group by 1")
_Z5 = _zero("genes tokens functional functional_genes multi_genes c1 c2 c3 c4 c5", _T5)
_N5 = list(enumerate(V.EM5_NAMES, 1))


@query("f4_token_summary", "sample_id mutated_gene_count_log1p:d mutation_token_count_log1p:d functional_mutation_count_log1p:d functional_gene_count_log1p:d multi_variant_gene_count_log1p:d functional_mutation_ratio:d "
       + " ".join(f"consequence_{x}_count_log1p:d consequence_{x}_ratio:d" for _, x in _N5), f"""
 select sample_id, ln(1+genes) mutated_gene_count_log1p, ln(1+tokens) mutation_token_count_log1p, ln(1+functional) functional_mutation_count_log1p,
  ln(1+functional_genes) functional_gene_count_log1p, ln(1+multi_genes) multi_variant_gene_count_log1p, functional/greatest(tokens,1) functional_mutation_ratio,
  {", ".join(f"ln(1+c{i}) consequence_{x}_count_log1p, c{i}/greatest(tokens,1) consequence_{x}_ratio" for i, x in _N5)} from ({_Z5})""")
def _(s, d):
    return Y.token_summary(W.events(s, d), W.samples(s, d))


@query("f5_compact_summary", "sample_id mutation_burden_log1p:d functional_gene_count_log1p:d multi_variant_gene_count_log1p:d "
       + " ".join(f"consequence_{x}_ratio:d" for _, x in _N5), f"""
 select sample_id, ln(1+tokens) mutation_burden_log1p, ln(1+functional_genes) functional_gene_count_log1p,
  ln(1+multi_genes) multi_variant_gene_count_log1p, {", ".join(f"c{i}/greatest(tokens,1) consequence_{x}_ratio" for i, x in _N5)} from ({_Z5})""")
def _(s, d):
    return Y.compact_summary(W.events(s, d), W.samples(s, d))


_JN = [x.lower() for x in V.JH_CLASSES]
_F6 = ("select sample_id, count(*) genes, sum(n) events_, count(*) filter (n>=2) multi, " + ", ".join(f"sum({x}) {x}" for x in _JN)
       + " from (select sample_id, gene, count(*) n, " + ", ".join(f"count(*) filter (consequence='{x.upper()}') {x}" for x in _JN)
       + " from jy group by 1,2) group by 1")
_CLIP = f"(select greatest(1, quantile_cont(genes,0.99)) from ({_zero('genes', 'select sample_id, count(distinct gene) genes from jy group by 1')}))"
_F6COLS = ("sample_id mutated_gene_count mutated_gene_count_log1p:d mutated_gene_count_clipped:d unique_event_count multi_hit_gene_count "
           "missing_gene_count is_all_wt " + " ".join(f"{x}_event_count {x}_event_ratio:d" for x in _JN) +
           " synonymous_nonsynonymous_ratio:d stop_frameshift_event_count stop_frameshift_event_ratio:d consequence_entropy:d dominant_consequence_fraction:d")
_R = [f"({x}/greatest(events_,1))" for x in _JN]


@query("f6_f1_summary", _F6COLS, f"""
 select sample_id, genes mutated_gene_count, ln(1+genes) mutated_gene_count_log1p, least(genes, {_CLIP}) mutated_gene_count_clipped,
  events_ unique_event_count, multi multi_hit_gene_count, missing_n missing_gene_count, cast(genes=0 and missing_n=0 as int) is_all_wt,
  {", ".join(f"{x} {x}_event_count, {r} {x}_event_ratio" for x, r in zip(_JN, _R))},
  (synonymous+1)/(missense+stop+frameshift+complex+1) synonymous_nonsynonymous_ratio, stop+frameshift stop_frameshift_event_count,
  (stop+frameshift)/greatest(events_,1) stop_frameshift_event_ratio,
  -({"+".join(f"case when {x}>0 then {r}*ln({r}) else 0e0 end" for x, r in zip(_JN, _R))}) consequence_entropy,
  greatest({",".join(_R)}) dominant_consequence_fraction
 from ({_zero("genes events_ multi missing_n " + " ".join(_JN), f"select * from ({_F6}) full join (select sample_id, count(*) missing_n from missing group by 1) using (sample_id)")})""")
def _(s, d):
    c, smp = W.kept_cells(s, d), W.samples(s, d)
    e = E.build_events(c, "jyp")
    return Y.f1_summary(e, W.missing(s, d, c), smp, Y.burden_clip(G.gene_presence(e), smp))


@query("f7_burden_clip", "clip:d", f"select {_CLIP} clip")
def _(s, d):
    e, smp = W.events(s, d, "jyp"), W.samples(s, d)
    return s.range(1).select(Y.burden_clip(G.gene_presence(e), smp).alias("clip"))


_F8LOG = ["mutation_event_count", "mutated_gene_count", "multi_hit_gene_count", *[f"{x}_count" for x in _JN],
          "position_mean", "position_median", "position_max", "events_per_mutated_gene"]
_F8 = ("select sample_id, count(*) mutation_event_count, count(distinct gene) mutated_gene_count, avg(position) position_mean, "
       "quantile_cont(position,0.5) position_median, max(position) position_max, "
       + ", ".join(f"count(*) filter (consequence='{x.upper()}') {x}_count" for x in _JN) + " from jh group by 1")
_F8M = "select sample_id, count(*) multi_hit_gene_count from (select sample_id, gene from jh group by 1,2 having count(*)>1) group by 1"


@query("f8_jh_f1", "sample_id " + " ".join(f"log1p_{x}:d" for x in _F8LOG) + " " + " ".join(f"{x}_ratio:d" for x in _JN) + " is_all_wt", f"""
 select sample_id, {", ".join(f"ln(1+{x}) log1p_{x}" for x in _F8LOG)}, {", ".join(f"{x}_count/greatest(mutation_event_count,1) {x}_ratio" for x in _JN)},
  cast(mutation_event_count=0 as int) is_all_wt
 from (select *, mutation_event_count/greatest(mutated_gene_count,1) events_per_mutated_gene from
  ({_zero(" ".join(_F8LOG[:-1]), f"select * from ({_F8}) left join ({_F8M}) using (sample_id)")}))""")
def _(s, d):
    return Y.jh_f1(E.build_events(W.kept_cells(s, d), "jh"), W.samples(s, d))


@query("f9_gene_diversity", "sample_id concentration:d gene_entropy:d diversity_ratio:d", f"""
 select sample_id, c concentration, h/ln(greatest(a,2)) gene_entropy, a/(select count(distinct gene) from ev) diversity_ratio from
 ({_zero("c h a", "select sample_id, max(p) c, sum(-p*ln(p+1e-12)) h, count(*) a from (select sample_id, n/sum(n) over (partition by sample_id) p from gn) group by 1")})""")
def _(s, d):
    e = W.events(s, d)
    return Y.gene_diversity(e, W.samples(s, d), S.total(e, F.countDistinct("gene")))


@query("f9_event_type_diversity", "sample_id concentration:d gene_entropy:d diversity_ratio:d", """
 select user_id sample_id, max(p) concentration, sum(-p*ln(p+1e-12))/ln(greatest(count(*),2)) gene_entropy, count(*)/5 diversity_ratio from
 (select user_id, n/sum(n) over (partition by user_id) p from (select user_id, event_type, count(*) n from events group by 1,2)) group by 1""")
def _(s, d):
    e = W.table(s, d, "events").select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("gene"))
    return Y.gene_diversity(e, e.select("sample_id").distinct(), 5)


_FK = V.F_KINDS


@query("f10_f_counts", "sample_id mutated_gene_count mutation_event_count multi_hit_gene_count mutation_burden_log1p:d no_mutation_sample " + " ".join(f"{k}_event_count" for k in _FK), f"""
 select *, ln(1+mutation_event_count) mutation_burden_log1p, cast(mutation_event_count=0 as int) no_mutation_sample from
 ({_zero("mutated_gene_count mutation_event_count multi_hit_gene_count " + " ".join(f"{k}_event_count" for k in _FK),
         "select sample_id, count(*) mutated_gene_count, sum(n) mutation_event_count, count(*) filter (n>1) multi_hit_gene_count, "
         + ", ".join(f"sum({k}) {k}_event_count" for k in _FK) + " from (select sample_id, gene, count(*) n, "
         + ", ".join(f"count(*) filter (kind='{k}') {k}" for k in _FK) + " from evf group by 1,2) group by 1")})""")
def _(s, d):
    return Y.f_counts(W.events(s, d, "f"), W.samples(s, d))


@query("f11_token_complexity", "sample_id token_event_count multi_hit_gene_count token_excess_count max_gene_token_count multi_hit_ratio:d", f"""
 select *, multi_hit_gene_count/greatest(b,1) multi_hit_ratio from ({_zero("token_event_count multi_hit_gene_count token_excess_count max_gene_token_count b",
 "select sample_id, sum(n) token_event_count, count(*) filter (n>1) multi_hit_gene_count, sum(n-1) token_excess_count, max(n) max_gene_token_count, count(*) b from gn group by 1")})""")
def _(s, d):
    return Y.token_complexity(W.events(s, d), W.samples(s, d))


_J1 = [f"type_{x}" for x in V.JSJ1_TYPES]


def _jsj(view: str, types: list[str], extra: str = "") -> str:
    inner = (f"select sample_id, gene, count(*) n, " + ", ".join(f"count(*) filter (event_type='{x[5:]}') {x}" for x in types)
             + extra + f" from {view} group by 1,2")
    return inner


@query("f12_jsj1_structural", "sample_id mutated_gene_count event_count multi_event_gene_count missing_gene_count " + " ".join(_J1),
       _zero("mutated_gene_count event_count multi_event_gene_count missing_gene_count " + " ".join(_J1),
             "select * from (select sample_id, count(*) mutated_gene_count, sum(n) event_count, count(*) filter (n>1) multi_event_gene_count, "
             + ", ".join(f"sum({x}) {x}" for x in _J1) + f" from ({_jsj('js1', _J1)}) group by 1) "
             "full join (select sample_id, count(*) missing_gene_count from missing group by 1) using (sample_id)"))
def _(s, d):
    c = W.kept_cells(s, d)
    return Y.jsj1_structural(E.build_events(c, "jsj1"), W.missing(s, d, c), W.samples(s, d))


_J2 = [f"type_{x}" for x in V.JSJ2_TYPES]
_B2 = [f"position_{b}" for b in V.POSITION_BINS["jsj"][1]]


@query("f13_jsj2_summary", "sample_id mutated_gene_count total_event_count multi_event_gene_count missing_gene_count log1p_mutated_gene_count:d "
       "log1p_total_event_count:d all_wt events_per_mutated_gene:d " + " ".join(f"{x}_count {x}_ratio:d" for x in _J2 + _B2), f"""
 select sample_id, g mutated_gene_count, t total_event_count, m multi_event_gene_count, missing_n missing_gene_count, ln(1+g) log1p_mutated_gene_count,
  ln(1+t) log1p_total_event_count, cast(g=0 as int) all_wt, t/greatest(g,1) events_per_mutated_gene,
  {", ".join(f"{x} {x}_count, {x}/greatest(t,1) {x}_ratio" for x in _J2 + _B2)} from
 ({_zero("g t m missing_n " + " ".join(_J2 + _B2), "select * from (select sample_id, count(*) g, sum(n) t, count(*) filter (n>1) m, "
         + ", ".join(f"sum({x}) {x}" for x in _J2 + _B2) + " from (" + _jsj("js2", _J2, ", " + ", ".join(f"count(*) filter (position_bin='{b[9:]}') {b}" for b in _B2))
         + ") group by 1) full join (select sample_id, count(*) missing_n from missing group by 1) using (sample_id)")})""")
def _(s, d):
    c = W.kept_cells(s, d)
    return Y.jsj2_summary(E.build_events(c, "jsj2"), W.missing(s, d, c), W.samples(s, d))


_CB = [("fs", 1000, 10000), ("stop", 100, 1000), ("missense", 10, 100), ("silent", 1, 10)]
_J3 = ["mutated_gene_count", "mutation_code_sum", "mutation_code_max", *[f"{k}_gene_count" for k, _, _ in _CB], "multi_event_gene_count",
       *[f"code_{a}_{b}" for a, b in Y.CODE_RANGES]]


@query("f14_jsj3_summary", "sample_id " + " ".join(_J3), _zero(" ".join(_J3), "select sample_id, count(*) filter (code<>0) mutated_gene_count, sum(code) mutation_code_sum, max(code) mutation_code_max, "
       + ", ".join(f"count(*) filter (code>={a} and code<{b}) {k}_gene_count" for k, a, b in _CB)
       + ", count(*) filter (floor(code/1000)+floor(code/100)%10+floor(code/10)%10+code%10>1) multi_event_gene_count, "
       + ", ".join(f"count(*) filter (code>={a} and code<{b}) code_{a}_{b}" for a, b in Y.CODE_RANGES) + " from codes group by 1"))
def _(s, d):
    return Y.jsj3_summary(E.cell_code(W.events(s, d, "jsj3")), W.samples(s, d))


@query("f15_aa_profile", "sample_id feature:s n", f"""
 select sample_id, feature, count(*) n from (
  select sample_id, unnest([case when regexp_matches(runs[1],'^[{W.AA}]') then concat(kind,'_',substr(runs[1],1,1)) end,
   case when kind='MISSENSE' and len(runs)>=2 and regexp_matches(runs[-1],'^[{W.AA}]') then concat('TO_',substr(runs[-1],1,1)) end]) feature from js3)
 where feature is not null group by 1,2""")
def _(s, d):
    return Y.aa_profile(W.events(s, d, "jsj3"))


_E1 = ["total_event_count", "log1p_total_event_count", "log1p_mutated_gene_count", "mutated_gene_ratio", "events_per_mutated_gene",
       "fs_event_ratio", "stop_event_ratio", "missense_event_ratio", "silent_event_ratio", "mutation_type_entropy", "dominant_type_ratio"]
_K4 = ["fs", "stop", "mis", "sil"]


@query("f16_e1_summary", "sample_id " + " ".join(f"{x}:d" for x in _E1) + " active_mutation_type_count multi_type_gene_count", f"""
 select sample_id, t total_event_count, ln(1+t) log1p_total_event_count, ln(1+g) log1p_mutated_gene_count, g/150 mutated_gene_ratio,
  t/greatest(g,1) events_per_mutated_gene, {", ".join(f"{k}/greatest(t,1) {n}_event_ratio" for k, n in zip(_K4, ["fs", "stop", "missense", "silent"]))},
  -({"+".join(f"{k}/greatest(t,1)*ln({k}/greatest(t,1)+1e-12)" for k in _K4)}) mutation_type_entropy,
  greatest({",".join(f"{k}/greatest(t,1)" for k in _K4)}) dominant_type_ratio,
  {"+".join(f"cast({k}>0 as int)" for k in _K4)} active_mutation_type_count, m multi_type_gene_count
 from ({_zero("g fs stop mis sil m t", "select *, fs+stop+mis+sil t from (select sample_id, count(*) g, sum(f) fs, sum(st) stop, sum(mi) mis, sum(si) sil, "
              "count(*) filter (cast(f>0 as int)+cast(st>0 as int)+cast(mi>0 as int)+cast(si>0 as int)>1) m from "
              "(select sample_id, floor(code/1000) f, floor(code/100)%10 st, floor(code/10)%10 mi, code%10 si from codes where code>0) group by 1)")})""")
def _(s, d):
    return Y.e1_summary(E.cell_code(W.events(s, d, "jsj3")), W.samples(s, d), 150)


_SUB = "select sample_id, transition, count(*) n from jy where transition is not null and transition not like '%*' and substr(transition,1,1)<>substr(transition,3,1) group by 1,2"


@query("f17_aa_pairs_log", "sample_id transition:s value:d", f"select sample_id, transition, ln(1+n) as value from ({_SUB})")
def _(s, d):
    return Y.aa_pairs_log(W.events(s, d, "jyp"))


@query("f18_aa_pairs_state", "sample_id transition:s value:d", f"""
 with r as (select sample_id, transition, ln(1+n) as value from ({_SUB})),
 top as (select transition from r group by 1 having count(*)>=10 order by count(*) desc, transition limit 40)
 select sample_id, transition, value/sum(value) over (partition by sample_id) as value from r join top using (transition)""")
def _(s, d):
    return Y.aa_pairs_state(W.events(s, d, "jyp"), 10, 40, True)


@query("f19_aa_composition", "sample_id pair_entropy:d dominant_pair_share:d " + " ".join(f"from_{a}:d to_{a}:d" for a in W.AA), f"""
 with p as (select *, n/sum(n) over (partition by sample_id) f from ({_SUB}))
 {_zero("pair_entropy dominant_pair_share " + " ".join(f"from_{a} to_{a}" for a in W.AA), "select sample_id, -sum(f*ln(f))/ln(380) pair_entropy, max(f) dominant_pair_share, "
        + ", ".join(f"sum(case when substr(transition,1,1)='{a}' then f else 0 end) from_{a}, sum(case when substr(transition,3,1)='{a}' then f else 0 end) to_{a}" for a in W.AA)
        + " from p group by 1")}""")
def _(s, d):
    return Y.aa_composition(W.events(s, d, "jyp"), W.samples(s, d))


_BUR = _zero("burden", "select sample_id, count(*) burden from pres group by 1")


@query("f20_burden_bin", "sample_id burden burden_bin:s", f"""
 select *, case when burden<=5 then '0-5' when burden<=9 then '6-9' when burden<=16 then '10-16' when burden<=33 then '17-33' else '34+' end burden_bin from ({_BUR})""")
def _(s, d):
    return Y.burden_bins(Y.burden(W.events(s, d), W.samples(s, d), 150))


@query("f21_burden_quantile", "sample_id burden stratum", f"""
 with b as ({_BUR}), q as (select quantile_cont(burden,[0.2,0.4,0.6,0.8]) q from b)
 select sample_id, burden, len(list_filter(q, lambda x: x<burden)) stratum from b cross join q""")
def _(s, d):
    return Y.burden_quantile(Y.burden(W.events(s, d), W.samples(s, d), 150), 5)


@query("f22_functional_ratio", "sample_id n functional_ratio:d", f"""
 select sample_id, n, f/greatest(n,1) functional_ratio from ({_zero("n f", "select sample_id, count(*) n, count(*) filter (not regexp_matches(lower(token),'synonymous|silent|intron')) f from ev group by 1")})""")
def _(s, d):
    return Y.functional_ratio(W.events(s, d), W.samples(s, d))


@query("f23_standardize", "sample_id burden:d burden_log1p:d", f"""
 with b as (select sample_id, burden, ln(1+burden) l, fold from ({_BUR}) join folds using (sample_id)),
 t as (select avg(burden) m1, stddev_pop(burden) s1, avg(l) m2, stddev_pop(l) s2 from b where fold<>0)
 select sample_id, (burden-m1)/s1 burden, (l-m2)/s2 burden_log1p from b cross join t""")
def _(s, d):
    b = Y.burden(W.events(s, d), W.samples(s, d), 150).join(W.labelled(s, d), "sample_id")
    cols = ["burden", "burden_log1p"]
    return Y.standardize(b, Y.standardize_state(b.filter("fold <> 0"), cols), cols)
