"""Class signatures, log-odds statistics, pair contrasts and co-mutation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenfold.operators import events as E
from tokenfold.operators import genes as G
from tokenfold.operators import metrics as M
from tokenfold.operators import signatures as Z
from tokenfold.session import keep
from tokenfold.workload import query
from tokenfold.workload import views as W

# Families of the fixture's labels.
FAMILIES = {"heavy": ["AUTOMOBILE", "MACHINERY"], "home": ["FURNITURE", "HOUSEHOLD"], "single": ["BUILDING"]}
PAIR = ("AUTOMOBILE", "MACHINERY")
_ALL = "select -1 k"
_FIVE = "select unnest(range(5)) k"


def counts(rows: str = "pres", labels: str = "folds", ks: str = _ALL, weight: str = "1") -> str:
    """Counts per (k, gene, label) without fold k: a, t, n, m (brute force over all combinations)."""
    return f"""(select g.k, g.gene, c.label, coalesce(x.a,0) a, sum(coalesce(x.a,0)) over (partition by g.k, g.gene) t, c.n, c.m from
  (select k, gene from (select distinct gene from {rows}) cross join ({ks})) g
  join (select k, label, n, sum(n) over (partition by k) m from (select k, label, sum({weight})*1e0 n from ({labels}) s cross join ({ks}) where s.fold<>k group by 1,2)) c on c.k=g.k
  left join (select k, gene, label, sum({weight})*1e0 a from {rows} join ({labels}) s using (sample_id) cross join ({ks}) where s.fold<>k group by 1,2,3) x
   on x.k=g.k and x.gene=g.gene and x.label=c.label)"""


ODDS = "least(greatest(log2(((a+0.5e0)/(n-a+0.5e0))/((t-a+0.5e0)/(m-n-t+a+0.5e0))),0),8)*sqrt(t/(t+10e0))"
_RI, _RO = "((a+0.5e0)/(n+1e0))", "((t-a+0.5e0)/(m-n+1e0))"
RATE = f"least(greatest(log2(({_RI}/(1-{_RI}))/({_RO}/(1-{_RO}))),-8),8)*(a/(a+10e0))"


def weights(source: str, score: str = ODDS, top: int = 20, positive: bool = True) -> str:
    keep = "where w>0" if positive else ""
    return f"""(select * from (select *, row_number() over (partition by k, label order by round(w,9) desc, gene) rank from
  (select k, label, gene, {score} w from {source}) {keep}) where rank<={top})"""


W_ODDS = weights(counts())
W_OOF = weights(counts(ks=_FIVE))


def oof(rows: str = "pres", w: str | None = None) -> str:
    return f"""select p.sample_id, w.label, sum(w) weighted, count(*) matches from {rows} p join folds f using (sample_id)
 join {w or W_OOF} w on w.k=f.fold and w.gene=p.gene group by 1,2"""


def pres(s, d):
    """Cached presence: weights are learnt from it and then applied to it."""
    return keep(G.gene_presence(W.events(s, d)))


def state3(s, d):
    """(presence, missing) from one cached cell table."""
    c = W.kept_cells(s, d)
    return G.gene_presence(E.build_events(c)), W.missing(s, d, c)


@query("g1_class_weights", "label:s gene:s w:d rank", f"select label, gene, w, rank from {W_ODDS}")
def _(s, d):
    return Z.class_weights(pres(s, d), W.samples(s, d))


@query("g2_class_weights_rate", "label:s gene:s w:d rank", f"select label, gene, w, rank from {weights(counts(), RATE, positive=False)}")
def _(s, d):
    return Z.class_weights(pres(s, d), W.samples(s, d), variant="rate")


_SC = f"select sample_id, label, sum(w) weighted, count(*) matches from pres join {W_ODDS} using (gene) group by 1,2"


@query("g3_signature_score", "sample_id label:s weighted:d matches", _SC)
def _(s, d):
    p = pres(s, d)
    return Z.signature_score(p, Z.class_weights(p, W.samples(s, d)))


@query("g4_signature_rate", "sample_id label:s weighted:d matches match_rate:d",
       f"select *, matches/greatest(b,1) match_rate from ({_SC}) join (select sample_id, count(*) b from pres group by 1) using (sample_id)")
def _(s, d):
    p = pres(s, d)
    return Z.signature_rate(Z.signature_score(p, Z.class_weights(p, W.samples(s, d))), p)


@query("g5_oof_signature", "sample_id label:s weighted:d matches", oof())
def _(s, d):
    return Z.oof_signature(pres(s, d), W.labelled(s, d), W.K)


_FUN = "(select distinct sample_id, gene from ev where conseq>=2)"


@query("g6_dual_signature", "channel:s sample_id label:s weighted:d matches", f"""
 select 'all' channel, * from ({oof()}) union all select 'functional', * from ({oof(_FUN, weights(counts(_FUN, ks=_FIVE)))})""")
def _(s, d):
    e = keep(W.events(s, d))
    return Z.dual_signature(G.gene_presence(e), G.gene_functional(e), W.labelled(s, d), W.K)


# Groups: customers of one nation form a profile.
_WL = "select c_custkey sample_id, c_mktsegment label, 0 fold, pow(count(*) over (partition by c_nationkey),-0.5e0) w from customer"


@query("g7_group_weighted", "label:s gene:s w:d rank", f"select label, gene, w, rank from {weights(counts(labels=_WL, weight='w'))}")
def _(s, d):
    groups = W.table(s, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_nationkey").alias("profile"))
    return Z.class_weights(pres(s, d), Z.group_weighted(W.samples(s, d), groups, 0.5))


_FAM = """select sample_id, case when label in ('AUTOMOBILE','MACHINERY') then 'heavy' when label in ('FURNITURE','HOUSEHOLD') then 'home' else 'single' end label, 0 fold from samples"""


@query("g8_family_signature", "sample_id label:s weighted:d matches match_rate:d", f"""
 select sample_id, label, sum(w) weighted, count(*) matches, count(*)/max(b) match_rate from pres join {weights(counts(labels=_FAM))} using (gene)
 join (select sample_id, count(*) b from pres group by 1) using (sample_id) where label<>'single' group by 1,2""")
def _(s, d):
    return Z.family_signature(pres(s, d), W.samples(s, d), FAMILIES)


def _sib(labels: str) -> str:
    return weights(counts(labels=f"select sample_id, label, 0 fold from samples where label in ({labels})"))


@query("g9_sibling_signature", "sample_id label:s weighted:d matches match_rate:d", f"""
 select sample_id, label, sum(w) weighted, count(*) matches, count(*)/max(b) match_rate from pres join
 (select * from {_sib("'AUTOMOBILE','MACHINERY'")} union all select * from {_sib("'FURNITURE','HOUSEHOLD'")}) using (gene)
 join (select sample_id, count(*) b from pres group by 1) using (sample_id) group by 1,2""")
def _(s, d):
    return Z.sibling_signature(pres(s, d), W.samples(s, d), FAMILIES)


@query("g10_pair_contrast", "sample_id left:s right:s weighted_diff:d count_diff", f"""
 select sample_id, 'AUTOMOBILE' as "left", 'MACHINERY' as "right", sum(case when label='AUTOMOBILE' then weighted else -weighted end) weighted_diff,
  sum(case when label='AUTOMOBILE' then matches else -matches end) count_diff from ({_SC}) where label in ('AUTOMOBILE','MACHINERY') group by 1""")
def _(s, d):
    p = pres(s, d)
    return Z.pair_contrast(Z.signature_score(p, Z.class_weights(p, W.samples(s, d))), [PAIR])


def _sim(ks: str, join: str) -> str:
    c = counts(ks=ks)
    return f"""with c as (select *, {_RI} r, {RATE} w from {c}),
 st as (select c.k, c.label, c.gene, c.r, q.w, sqrt(sum(c.r*c.r) over (partition by c.k, c.label)) nrm from c
  left join (select * from {weights(c, RATE, positive=False)} where w>0) q using (k, label, gene)),
 s as (select p.sample_id, st.label, coalesce(sum(st.w),0) weighted, sum(r)/greatest(sqrt(count(*))*max(nrm),1e-12) sim from pres p join folds f using (sample_id)
  join st on st.gene=p.gene and {join} group by 1,2),
 z as (select *, row_number() over (partition by sample_id order by sim desc) rk, exp((sim-max(sim) over (partition by sample_id))/0.2e0) e from s),
 g as (select sample_id, max(case when rk=1 then sim end)-max(case when rk=2 then sim end) margin, sum(e) t, count(*) n from z group by 1)
 select sample_id, label, weighted, sim similarity, margin, sum(-(e/t)*ln(e/t+1e-12)) over (partition by sample_id)/ln(n) entropy from z join g using (sample_id)"""


_SIMC = "sample_id label:s weighted:d similarity:d margin:d entropy:d"


@query("g11_signature_similarity", _SIMC, _sim(_ALL, "true"))
def _(s, d):
    return Z.signature_similarity(pres(s, d), W.samples(s, d))


@query("g11_signature_similarity_oof", _SIMC, _sim(_FIVE, "st.k=f.fold"))
def _(s, d):
    return Z.signature_similarity(pres(s, d), W.labelled(s, d), k=W.K)


# --- F5: log odds with missing cells ------------------------------------------------
_PARTS = "select o, i from (select unnest(range(-1,5)) o) cross join (select unnest(range(-1,5)) i)"


def f5(parts: str) -> str:
    """Effects per (o, i, label, gene) with folds o and i held out."""
    return f"""(select *, ln(p1)-ln(1-p1)-ln(p0)+ln(1-p0) effect from (select o, i, gene, label, a, t, (a+1e0)/(n-xa+2e0) p1, (t-a+1e0)/(m-xt-(n-xa)+2e0) p0 from (
  select g.o, g.i, g.gene, c.label, coalesce(x.a,0) a, coalesce(x.xa,0) xa, c.n, c.m,
   sum(coalesce(x.a,0)) over (partition by g.o,g.i,g.gene) t, sum(coalesce(x.xa,0)) over (partition by g.o,g.i,g.gene) xt from
  (select o, i, gene from (select gene from pres union select gene from missing) cross join ({parts})) g
  join (select o, i, label, n, sum(n) over (partition by o,i) m from (select o, i, label, count(*) n from folds cross join ({parts}) where fold<>o and fold<>i group by 1,2,3)) c on c.o=g.o and c.i=g.i
  left join (select o, i, gene, label, count(*) filter (x=0) a, count(*) filter (x=1) xa from (select *, 0 x from pres union all select *, 1 from missing) join folds using (sample_id)
   cross join ({parts}) where fold<>o and fold<>i group by 1,2,3,4) x on x.o=g.o and x.i=g.i and x.gene=g.gene and x.label=c.label)))"""


@query("g12_f5_stats", "label:s gene:s a t p1:d effect:d", f"select * from {f5('select -1 o, -1 i')}")
def _(s, d):
    return Z.f5_stats(*state3(s, d), W.samples(s, d))


def f5_state(outer: str, dirn: str, freq: str) -> str:
    parts = f"select o, i from ({outer}) cross join (select unnest(range(-1,5)) i) where i=-1 or i<>o"
    return f"""(with e as (select * from {f5(parts)}),
  top as (select * from (select *, row_number() over (partition by o,i,label order by round(abs(effect),9) desc, gene) r from e where i>=0 and t>=100) where r<=25),
  fr as (select o, label, gene, count(*) frequency from top group by 1,2,3),
  di as (select e.o, e.label, e.gene, count(*) direction from e join e f on f.o=e.o and f.i=-1 and f.label=e.label and f.gene=e.gene
   where e.i>=0 and sign(e.effect)=sign(f.effect) and f.effect<>0 group by 1,2,3)
  select * from (select e.o, e.label, e.gene, effect, ln(p1) log_mut, ln(1-p1) log_wt, direction, frequency,
   row_number() over (partition by e.o, e.label order by round(abs(effect),9) desc, e.gene) rank from e join fr using (o,label,gene) join di using (o,label,gene)
   where i=-1 and t>=100 and direction>={dirn} and frequency>={freq}) where rank<=25)"""


_ONE, _O5 = "select -1 o", "select unnest(range(5)) o"


@query("g13_f5_stable", "label:s gene:s rank effect:d log_mut:d log_wt:d direction frequency", f"select * from {f5_state(_ONE, '4', '3')}")
def _(s, d):
    return Z.f5_stable(*state3(s, d), W.labelled(s, d), W.K, minimum=100)


def f5_scores(state: str, on: str) -> str:
    return f"""with st as (select * from {state}),
 b as (select o, label, sum(log_wt) base from st group by 1,2),
 c as (select *, 1 mut from pres union all select *, 0 from missing),
 j as (select c.sample_id, st.label, sum(case when mut=1 then effect end) s, count(*) filter (mut=1) c, max(case when mut=1 then effect end) mx,
  sum(case when mut=1 then log_mut-log_wt else -log_wt end) d from c join folds f using (sample_id) join st on st.gene=c.gene and {on} group by 1,2)
 select f.sample_id, st.label, coalesce(s,0) score_sum, coalesce(s,0)/greatest(coalesce(c,0),1) score_mean, coalesce(mx,0) score_max, base+coalesce(d,0) bernoulli
 from folds f join b st on {on} left join j on j.sample_id=f.sample_id and j.label=st.label"""


_F5C = "sample_id label:s score_sum:d score_mean:d score_max:d bernoulli:d"


@query("g14_f5_score", _F5C, f5_scores(f5_state(_ONE, "4", "3"), "st.o=-1"))
def _(s, d):
    (p, x), f = state3(s, d), W.labelled(s, d)
    return Z.f5_score(p, x, f, Z.f5_stable(p, x, f, W.K, minimum=100))


@query("g15_f5_oof", _F5C, f5_scores(f5_state(_O5, "4", "3"), "st.o=f.fold"))
def _(s, d):
    return Z.f5_oof(*state3(s, d), W.labelled(s, d), W.K, minimum=100)


@query("g15_rare_classes", "label:s n", "select label, count(*) n from samples group by 1 order by 2, 1 limit 2")
def _(s, d):
    return Z.rare_classes(W.samples(s, d), 2)


# --- F7: burden-stratified pair contrasts -----------------------------------------------
def f7(parts: str) -> str:
    return f"""(with s as (select f.sample_id, fold, case label when 'AUTOMOBILE' then 0 else 1 end side, count(p.gene) burden from folds f left join pres p using (sample_id)
   where label in ('AUTOMOBILE','MACHINERY') group by 1,2,3),
  pt as ({parts}), sp as (select s.*, o, i from s cross join pt where fold<>o and fold<>i),
  q as (select o, i, quantile_cont(burden,[0.2,0.4,0.6,0.8]) q from sp group by 1,2),
  st as (select sp.*, len(list_filter(q, lambda x: x<burden)) stratum from sp join q using (o,i)),
  sz as (select o,i,stratum, count(*) filter (side=0) n0, count(*) filter (side=1) n1 from st group by 1,2,3),
  c as (select o,i,gene,stratum, count(*) filter (side=0 and x=0) m0, count(*) filter (side=1 and x=0) m1, count(*) filter (side=0 and x=1) x0, count(*) filter (side=1 and x=1) x1
   from (select *, 0 x from pres union all select *, 1 from missing) join st using (sample_id) group by 1,2,3,4),
  g as (select o,i,gene,sum(m0) a0,sum(m1) a1,sum(x0) y0,sum(x1) y1 from c group by 1,2,3),
  f as (select g.o,g.i,g.gene,sz.stratum,n0-coalesce(x0,0) o0,n1-coalesce(x1,0) o1,coalesce(m0,0) m0,coalesce(m1,0) m1,n0,n1 from g join sz using (o,i) left join c on c.o=g.o and c.i=g.i and c.gene=g.gene and c.stratum=sz.stratum),
  h as (select o,i,gene,(o0*o1)/(o0+o1) w, (m0+1e0)/(o0+2e0) p0, (m1+1e0)/(o1+2e0) p1 from f where n0>0 and n1>0 and o0>0 and o1>0),
  ef as (select o,i,gene,sum((ln(p0)-ln(1-p0)-ln(p1)+ln(1-p1))*w)/sum(w) effect from h group by 1,2,3),
  t as (select o,i,sum(n0) n0,sum(n1) n1 from sz group by 1,2)
  select g.o,g.i,g.gene,coalesce(effect,0) effect,a0+a1 support,(a0+1e0)/(n0-y0+2e0) p0,(a1+1e0)/(n1-y1+2e0) p1 from g join t using (o,i) left join ef using (o,i,gene))"""


@query("g16_pair_effect", "gene:s effect:d support log_odds:d log_mut_ratio:d log_wt_ratio:d",
       f"select gene, effect, support, ln(p0)-ln(1-p0)-ln(p1)+ln(1-p1) log_odds, ln(p0)-ln(p1) log_mut_ratio, ln(1-p0)-ln(1-p1) log_wt_ratio from {f7('select -1 o, -1 i')}")
def _(s, d):
    return Z.pair_effect(*state3(s, d), W.samples(s, d), PAIR)


def f7_state(outer: str) -> str:
    parts = f"select o, i from ({outer}) cross join (select unnest(range(-1,5)) i) where i=-1 or i<>o"
    return f"""(with e as (select *, sign(effect) dir from {f7(parts)}),
  tp as (select * from (select *, row_number() over (partition by o,i,dir order by round(abs(effect),9) desc, gene) r from e where i>=0 and support>=20 and effect<>0) where r<=20),
  fr as (select o, gene, count(*) frequency from tp group by 1,2),
  di as (select e.o, e.gene, count(*) direction from e join e f on f.o=e.o and f.i=-1 and f.gene=e.gene where e.i>=0 and e.dir=f.dir and f.effect<>0 group by 1,2)
  select * from (select e.*, direction, frequency, ln(p0)-ln(1-p0)-ln(p1)+ln(1-p1) log_odds, ln(p0)-ln(p1) mr, ln(1-p0)-ln(1-p1) wr,
   row_number() over (partition by o, dir order by round(abs(effect),9) desc, gene) rank from e join fr using (o,gene) join di using (o,gene)
   where i=-1 and support>=20 and effect<>0 and direction>=4 and frequency>=3) where rank<=20)"""


@query("g17_pair_select", "gene:s effect:d support log_odds:d dir rank direction frequency", f"select * from {f7_state(_ONE)}")
def _(s, d):
    return Z.pair_select(*state3(s, d), W.labelled(s, d), PAIR, W.K, minimum=20)


def f7_scores(state: str, on: str) -> str:
    return f"""with st as (select * from {state}), b as (select o, sum(wr) b, count(*) n from st group by 1),
 c as (select *, 1 mut from pres union all select *, 0 from missing),
 j as (select c.sample_id, sum(case when mut=1 then log_odds end) lo, count(*) filter (mut=1) c, count(*) filter (mut=0) x, sum(case when mut=1 then mr-wr else -wr end) d
  from c join folds f using (sample_id) join st on st.gene=c.gene and {on} group by 1)
 select f.sample_id, coalesce(lo,0)/greatest(coalesce(c,0),1) mutated_log_odds_mean, coalesce((b+coalesce(d,0))/greatest(n-coalesce(x,0),1),0) likelihood_ratio_mean
 from folds f left join b st on {on} left join j on j.sample_id=f.sample_id"""


_F7C = "sample_id mutated_log_odds_mean:d likelihood_ratio_mean:d"


@query("g18_pair_score", _F7C, f7_scores(f7_state(_ONE), "st.o=-1"))
def _(s, d):
    (p, x), f = state3(s, d), W.labelled(s, d)
    return Z.pair_score(p, x, f, Z.pair_select(p, x, f, PAIR, W.K, minimum=20))


@query("g19_pair_oof", _F7C, f7_scores(f7_state(_O5), "st.o=f.fold"))
def _(s, d):
    return Z.pair_oof(*state3(s, d), W.labelled(s, d), PAIR, W.K, minimum=20)


def signature_pred(s, d):
    """Arg-max of the out-of-fold signature (first label when nothing matches)."""
    f = W.labelled(s, d)
    sc = Z.oof_signature(pres(s, d), f, W.K)
    best = sc.groupBy("sample_id").agg(F.min_by("label", F.struct(-F.round("weighted", 9), F.col("label"))).alias("hat"))
    first = f.agg(F.min("label").alias("v")).scalar()
    j = f.join(best, "sample_id", "left").withColumn("first", first)
    return j.select("sample_id", "fold", F.col("label").alias("y"), F.coalesce("hat", "first").alias("yhat"))


PRED = f"""(select f.sample_id, f.fold, f.label y, coalesce(b.label,(select min(label) from samples)) yhat from folds f left join
 (select * from (select *, row_number() over (partition by sample_id order by round(weighted,9) desc, label) r from ({oof()})) where r=1) b using (sample_id))"""


@query("g20_discover_pairs", "left:s right:s errors rate:d rank", f"""
 select *, row_number() over (order by round(rate,9) desc, errors desc, "left", "right") rank from (
 select "left", "right", errors, errors/(a.n+b.n) rate from (select least(y,yhat) "left", greatest(y,yhat) "right", count(*) errors from {PRED} where y<>yhat group by 1,2)
 join (select label, count(*) n from samples group by 1) a on a.label="left" join (select label, count(*) n from samples group by 1) b on b.label="right") where not ("left"='AUTOMOBILE' and "right"='MACHINERY') order by rank limit 5""")
def _(s, d):
    return Z.discover_pairs(signature_pred(s, d), 5, [PAIR])


_POOL = "(select gene, n, row_number() over (order by n desc, gene) rk from (select gene, count(*) n from pres group by 1) order by rk)"
_COMUT = f"""(select * from (select *, row_number() over (order by round(lift,9) desc, joint desc, gene_a, gene_b) rank from (
 select a.gene gene_a, b.gene gene_b, count(*) joint, count(*)/greatest(max(x.n)*1e0*max(y.n)/(select count(*) from samples),1e-9) lift
 from pres a join pres b on a.sample_id=b.sample_id and a.gene<b.gene join {_POOL} x on x.gene=a.gene join {_POOL} y on y.gene=b.gene group by 1,2)
 where joint>=5 and round(lift,9)>=1.05) where rank<=96)"""


@query("g21_comutation", "gene_a:s gene_b:s joint lift:d rank", f"select * from {_COMUT}")
def _(s, d):
    return Z.comutation(pres(s, d), W.samples(s, d), min_lift=1.05)


@query("g22_comutation_flags", "sample_id rank", f"select a.sample_id, rank from pres a join pres b on a.sample_id=b.sample_id join {_COMUT} c on c.gene_a=a.gene and c.gene_b=b.gene")
def _(s, d):
    p = pres(s, d)
    return Z.comutation_flags(p, Z.comutation(p, W.samples(s, d), min_lift=1.05))


@query("g23_stable_genes", "gene:s n_folds", f"select gene, count(distinct k) n_folds from {W_OOF} group by 1 having count(distinct k)>=4")
def _(s, d):
    return Z.stable_genes(pres(s, d), W.labelled(s, d), W.K, 4)


@query("g24_gene_cap", "gene:s support rank", f"""
 select gene, support, rank from (select p.gene, support, row_number() over (order by lab nulls last, rk nulls last, support desc, p.gene) rank from (select gene, count(*) support from pres group by 1) p
 left join (select gene, label lab, rank rk from (select *, row_number() over (partition by gene order by label, rank) q from {weights(counts(), RATE, 15, False)}) where q=1) w using (gene)) where rank<=70""")
def _(s, d):
    return Z.gene_cap(pres(s, d), W.samples(s, d), 70, 5)


@query("g25_class_gene_union", "gene:s", f"select distinct gene from {weights(counts(), top=10)}")
def _(s, d):
    return Z.class_gene_union(pres(s, d), W.samples(s, d), 10)


def macro(pred: str, keys: str = "", classes: str = "count(*)") -> str:
    """Macro-F1 per key of (keys, y, yhat) rows by brute force."""
    k = f"{keys}, " if keys else ""
    return f"""select {k} sum(f1)/{classes} macro_f1 from (select {k} c, coalesce(2e0*sum(tp)/nullif(sum(nt)+sum(np),0),0) f1 from (
  select {k} y c, cast(y=yhat as int) tp, 1 nt, 0 np from ({pred}) union all select {k} yhat, 0, 0, 1 from ({pred})) group by {k} c) {'group by '+keys if keys else ''}"""


_TUNE = f"""select cand, f.sample_id, f.fold, f.label y, coalesce(b.label,(select min(label) from samples)) yhat from folds f cross join (select unnest([1,250,340]) cand) left join
 (select * from (select *, row_number() over (partition by cand, sample_id order by round(w,9) desc, label) r from (
  select cand, p.sample_id, w.label, sum(w.w) w from pres p join folds f using (sample_id) join
  (select * from (select *, row_number() over (partition by cand, k, label order by round(w,9) desc, gene) rk from (select cand, k, label, gene, {ODDS} w from {counts(ks=_FIVE)} cross join (select unnest([1,250,340]) cand) where t>=cand) where w>0) where rk<=20) w
   on w.k=f.fold and w.gene=p.gene group by 1,2,3)) where r=1) b using (cand, sample_id)"""


@query("g26_tune_support", "candidate mean_f1:d std_f1:d rank", f"""
 select cand candidate, avg(macro_f1) mean_f1, stddev_pop(macro_f1) std_f1, row_number() over (order by round(avg(macro_f1),9) desc, round(stddev_pop(macro_f1),9), cand desc) rank
 from ({macro(_TUNE, 'cand, fold')}) group by 1""")
def _(s, d):
    return Z.tune_support(pres(s, d), W.labelled(s, d), W.K, [1, 250, 340])


@query("flagship_oof_signature_f1", "fold macro_f1:d", macro(f"select fold, y, yhat from {PRED}", "fold", "5"))
def flagship(s, d):
    """Cells to tokens, out-of-fold signatures, arg-max, macro-F1 per fold."""
    return M.macro_f1(signature_pred(s, d), ["fold"], W.CLASSES)
