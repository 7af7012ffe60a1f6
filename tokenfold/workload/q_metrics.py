"""Metrics, evidence tables and selection rules on the probability fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenfold.functions import probs as PR
from tokenfold.operators import metrics as M
from tokenfold.operators import patterns as H
from tokenfold.operators import proba as P
from tokenfold.operators import summaries as Y
from tokenfold.session import keep
from tokenfold.workload import query
from tokenfold.workload import views as W
from tokenfold.workload.q_profile import _NOV
from tokenfold.workload.q_signatures import macro

C = W.CLASSES
VIEWS = {
    # arg-max per (sample, model); folds of seed 42
    "pred": """select p.sample_id, model, y, class_id yhat, fold from (select *, row_number() over (partition by sample_id, model order by p desc, class_id) r from proba) p
  join folds f using (sample_id) where r=1""",
    "two": "select a.sample_id, a.fold, a.y, a.yhat cand, b.yhat base from pred a join pred b using (sample_id) where a.model=1 and b.model=0",
    # three seeds: the model plays the role of the seed for candidate and base
    "two3": """select a.sample_id, a.model seed, a.y, a.yhat cand, b.yhat base from pred a join pred b on a.sample_id=b.sample_id and b.model=(a.model+1)%3""",
    "bur": "select s.sample_id, count(g.gene) burden from samples s left join pres g using (sample_id) group by 1",
    "grpv": f"""with nov as ({_NOV}), own as (select sample_id, fold, 'burden' dimension, burden*1e0 x from bur join folds using (sample_id) union all select sample_id, fold, 'novelty', valid from nov),
  tr as (select k, 'burden' dimension, burden*1e0 x from bur join folds using (sample_id) cross join (select unnest(range(5)) k) where fold<>k
   union all select k, 'novelty', case k when 0 then train_0 when 1 then train_1 when 2 then train_2 when 3 then train_3 else train_4 end from nov cross join (select unnest(range(5)) k) where fold<>k),
  q as (select k, dimension, quantile_cont(x,0.25) a, quantile_cont(x,0.75) b from tr group by 1,2)
  select sample_id, own.dimension, case when x<=a then 0 when x>=b then 2 else 1 end grp from own join q on q.k=own.fold and q.dimension=own.dimension""",
}
W.SQL.update(VIEWS)


def pred(s, d):
    """(sample_id, model, y, fold, yhat), merged by sample: the planner sizes ``proba`` by the file it is computed from, so it would broadcast it."""
    p = W.proba(s, d).select("sample_id", "model", "y", PR.argmax(F.col("p")).alias("yhat"))
    p = p.hint("merge").join(W.labelled(s, d).select("sample_id", "fold"), "sample_id")
    return p.select("sample_id", "model", "y", "fold", "yhat")


def two(s, d):
    p = pred(s, d)
    return M.two_models(p.filter("model = 1").drop("model"), p.filter("model = 0"))


def two3(s, d):
    """Each model against the next one, as three seeds; packed so no self join is needed."""
    p = W.proba(s, d).select("sample_id", "y", "model", PR.argmax(F.col("p")).alias("yhat"))
    m = p.groupBy("sample_id", "y").agg(F.map_from_entries(F.collect_list(F.struct("model", "yhat"))).alias("m"))
    opts = F.explode(F.array(*[F.struct(F.lit(i).alias("seed"), F.element_at("m", F.lit(i)).alias("cand"), F.element_at("m", F.lit((i + 1) % 3)).alias("base")) for i in range(3)]))
    return m.select("sample_id", "y", opts.alias("o")).select("sample_id", "y", "o.*")


def groups(s, d):
    f, e = W.labelled(s, d), keep(W.events(s, d))
    return M.fold_groups(Y.burden(e, f, 150), H.novelty(e, f, W.K), f, W.K)


def one_row(s, d):
    return s.range(1)


@query("l1_macro_f1", "model macro_f1:d", macro("select model, y, yhat from pred", "model", "5"))
def _(s, d):
    return M.macro_f1(pred(s, d), ["model"], C)


@query("l1_confusion", "model y yhat n", "select model, y, yhat, count(*) n from pred group by 1,2,3")
def _(s, d):
    return M.confusion(pred(s, d), ["model"])


_CL = """select {k} c, sum(tp) tp, sum(nt) nt, sum(np) np, coalesce(2e0*sum(tp)/nullif(sum(nt)+sum(np),0),0) f1 from (
  select {k} y c, cast(y=yhat as int) tp, 1 nt, 0 np from {t} union all select {k} yhat, 0, 0, 1 from {t}) group by {k} c"""


@query("l2_class_report", "model c precision:d recall:d f1:d support", f"""
 select model, c, coalesce(tp/nullif(np,0),0) "precision", coalesce(tp/nullif(nt,0),0) recall, f1, nt support from ({_CL.format(k='model,', t='pred')})""")
def _(s, d):
    return M.class_report(pred(s, d), ["model"])


@query("l3_calibration", "model logloss:d brier:d ece:d high_confidence_error:d", """
 with r as (select sample_id, model, max(p) conf, max(y) y, arg_max(class_id,(p,-class_id)) yhat, sum((p-cast(class_id=y as int))*(p-cast(class_id=y as int))) sq,
   -ln(greatest(max(case when class_id=y then p end),1e-15)) ll from proba group by 1,2),
 b as (select model, cast(conf>=0.4 as int)+cast(conf>=0.6 as int)+cast(conf>=0.8 as int) b, count(*) n, avg(cast(y=yhat as int)) acc, avg(conf) conf from r group by 1,2)
 select r.model, avg(ll) logloss, avg(sq) brier, max(e.ece) ece, coalesce(count(*) filter (conf>=0.8 and y<>yhat)/nullif(count(*) filter (conf>=0.8),0),0) high_confidence_error
 from r join (select model, sum(n*abs(acc-conf))/sum(n) ece from b group by 1) e on e.model=r.model group by 1""")
def _(s, d):
    return M.calibration(W.proba(s, d), ["model"])


@query("l4_pair_f1", "model pair_f1:d", f"""
 select model, sum(f1)/2 pair_f1 from ({_CL.format(k='model,', t='(select * from pred where y in (1,3))')}) where c in (1,3) group by 1""")
def _(s, d):
    return M.pair_f1(pred(s, d), (1, 3), ["model"])


@query("l5_directed_confusion", "source target confusion_support source_support confusion_rate:d rank", """
 select *, row_number() over (order by confusion_support desc, source, target) rank from (
 select y source, yhat target, n confusion_support, t source_support, n/t confusion_rate from
 (select y, yhat, count(*) n, sum(count(*)) over (partition by y) t from pred where model=0 group by 1,2) where y<>yhat and n>=3)""")
def _(s, d):
    return M.directed_confusion(pred(s, d).filter("model = 0"))


_FOLDF = macro("select model, fold, y, yhat from pred", "model, fold", "5")


@query("l6_fold_summary", "model mean:d std:d min:d", f"select model, avg(macro_f1) mean, stddev_pop(macro_f1) std, min(macro_f1) \"min\" from ({_FOLDF}) group by 1")
def _(s, d):
    return M.fold_summary(M.macro_f1(pred(s, d), ["model", "fold"], C), ["model"])


@query("l6_seed_summary", "mean:d std:d min:d", f"""
 select avg(macro_f1) mean, stddev_samp(macro_f1) std, min(macro_f1) "min" from ({macro("select model, y, yhat from pred", "model", "5")})""")
def _(s, d):
    return M.fold_summary(M.macro_f1(pred(s, d), ["model"], C), ddof=1)


_TV = f"""select v.model, v.fold, t.macro_f1 train, v.macro_f1 valid from ({_FOLDF}) v join
 ({macro("select model, k, y, yhat from pred cross join (select unnest(range(5)) k) where fold<>k", "model, k", "5")}) t on t.model=v.model and t.k=v.fold"""


@query("l7_overfit_summary", "model gap_min:d gap_max:d gap_mean:d n_over n", f"""
 select model, min(train-valid) gap_min, max(train-valid) gap_max, avg(train-valid) gap_mean, count(*) filter (train-valid>0.01) n_over, count(*) n from ({_TV}) group by 1""")
def _(s, d):
    conf = M.confusion(pred(s, d), ["model", "fold"])
    rest = conf.select("*", F.explode(F.array(*[F.lit(i) for i in range(W.K)])).alias("k")).filter("k <> fold")
    rest = rest.groupBy("model", F.col("k").alias("fold"), "y", "yhat").agg(F.sum("n").alias("n"))
    t = M.macro_f1(rest, ["model", "fold"], C, counted=True).withColumnRenamed("macro_f1", "train")
    v = M.macro_f1(conf, ["model", "fold"], C, counted=True).withColumnRenamed("macro_f1", "valid")
    return M.overfit_summary(t.join(v, ["model", "fold"]), 0.01, ["model"])


_BB = "case when burden<=5 then '0-5' when burden<=9 then '6-9' when burden<=16 then '10-16' when burden<=33 then '17-33' else '34+' end"


@query("l8_slice_f1", "burden_bin:s macro_f1:d support", f"""
 select burden_bin, macro_f1, support from ({macro(f"select {_BB} burden_bin, y, yhat from pred join bur using (sample_id) where model=0", "burden_bin", "5")})
 join (select {_BB} burden_bin, count(*) support from bur group by 1) using (burden_bin)""")
def _(s, d):
    smp = W.samples(s, d)
    b = Y.burden_bins(Y.burden(W.events(s, d), smp, 150)).select("sample_id", "burden_bin")
    return M.slice_f1(pred(s, d).filter("model = 0").join(b, "sample_id"), "burden_bin", C)


@query("l9_fold_groups", "sample_id dimension:s grp", "select * from grpv")
def _(s, d):
    return groups(s, d)


@query("l10_group_scores", "dimension:s grp macro_f1:d", macro("select dimension, grp, y, yhat from pred join grpv using (sample_id) where model=0", "dimension, grp", "5"))
def _(s, d):
    return M.group_scores(pred(s, d).filter("model = 0"), groups(s, d), C)


@query("l10_worst_group", "model floor:d", f"""
 select model, min(macro_f1) floor from ({macro("select model, dimension, grp, y, yhat from pred join grpv using (sample_id)", "model, dimension, grp", "5")}) group by 1""")
def _(s, d):
    return M.worst_group(pred(s, d), groups(s, d), C, ["model"])


_ST = "(select sample_id, fold, y, unnest(['base','cand']) which, unnest([base,cand]) yhat from two)"
_GF = macro(f"select which, fold, dimension, grp, y, yhat from {_ST} join grpv using (sample_id)", "which, fold, dimension, grp", "5")
_GO = macro(f"select which, dimension, grp, y, yhat from {_ST} join grpv using (sample_id)", "which, dimension, grp", "5")


@query("l11_robustness", "worst_fold_delta:d collapse_folds worst_group_floor:d", f"""
 with f as (select fold, min(case when which='cand' then macro_f1 end)-min(case when which='base' then macro_f1 end) d from ({_GF}) group by 1)
 select min(d) worst_fold_delta, count(*) filter (d<0) collapse_folds, (select min(macro_f1) from ({_GO}) where which='cand') worst_group_floor from f""")
def _(s, d):
    return M.robustness(two(s, d), groups(s, d), C)


@query("l12_safety", "c base:d cand:d delta:d declining_folds", f"""
 with f as ({_CL.format(k='which, fold,', t=_ST)}), o as ({_CL.format(k='which,', t=_ST)}),
 fc as (select fold, c, coalesce(max(case when which='base' then f1 end),0) b, coalesce(max(case when which='cand' then f1 end),0) x from f group by 1,2)
 select o.c, max(case when which='base' then f1 end) base, max(case when which='cand' then f1 end) cand, max(case when which='cand' then f1 end)-max(case when which='base' then f1 end) delta,
  max(n) declining_folds from o join (select c, count(*) filter (x<b-1e-12) n from fc group by 1) using (c) group by 1""")
def _(s, d):
    return M.safety(two(s, d))


@query("l13_group_safety", "dimension:s grp support observed_folds sufficient base:d cand:d se:d margin:d declining_folds", f"""
 with f as (select fold, dimension, grp, max(case when which='cand' then macro_f1 end)-max(case when which='base' then macro_f1 end) d from ({_GF}) group by 1,2,3),
 e as (select dimension, grp, count(*) nf, stddev_samp(d)/sqrt(count(*)) se from f group by 1,2),
 x as (select dimension, grp, count(*) filter (d<-se-1e-12) dec from f join e using (dimension, grp) group by 1,2),
 o as (select dimension, grp, max(case when which='base' then macro_f1 end) base, max(case when which='cand' then macro_f1 end) cand from ({_GO}) group by 1,2)
 select o.dimension, o.grp, support, nf observed_folds, 1 sufficient, base, cand, se, cand-base+se margin, dec declining_folds
 from o join e using (dimension, grp) join x using (dimension, grp) join (select dimension, grp, count(*) support from grpv group by 1,2) using (dimension, grp)""")
def _(s, d):
    return M.group_safety(two(s, d), groups(s, d), C)


# Multinomial draws are seeded per class and chunk; no SQL twin.
@query("l14_paired_bootstrap", "mean_delta:d ci_lower:d ci_upper:d probability_positive:d ci_lower_ge_0")
def _(s, d):
    return M.paired_bootstrap(two3(s, d), 3000, 42, C)


@query("l15_bootstrap_se", "se_boot:d ci_lower:d ci_upper:d")
def _(s, d):
    return M.bootstrap_se(two3(s, d), 3000, 42, C)


_SD = f"""select seed, max(case when which='cand' then macro_f1 end)-max(case when which='base' then macro_f1 end) delta from
 ({macro("select seed, which, y, yhat from (select seed, y, unnest(['base','cand']) which, unnest([base,cand]) yhat from two3)", "seed, which", "5")}) group by 1"""


@query("l16_noninferiority", "delta:d se_seed:d se_boot:d epsilon:d pass", f"""
 select *, greatest(se_seed,0.01) epsilon, cast(delta>=-greatest(se_seed,0.01) as int) pass from (select avg(delta) delta, stddev_samp(delta)/sqrt(3) se_seed, 0.01 se_boot from ({_SD}))""")
def _(s, d):
    return M.noninferiority(M.seed_deltas(two3(s, d), C), 0.01)


@query("l17_rescue_harm", "source target rescue harm net_rescue", """
 select y source, case when base<>y then base else cand end target, count(*) filter (base<>y) rescue, count(*) filter (base=y) harm,
  count(*) filter (base<>y)-count(*) filter (base=y) net_rescue from two where (base<>y and cand=y) or (base=y and cand<>y) group by 1,2""")
def _(s, d):
    return M.rescue_harm(two(s, d))


@query("l17_rescue_harm_by_fold", "fold source target rescue harm net_rescue", """
 select fold, y source, case when base<>y then base else cand end target, count(*) filter (base<>y) rescue, count(*) filter (base=y) harm,
  count(*) filter (base<>y)-count(*) filter (base=y) net_rescue from two where (base<>y and cand=y) or (base=y and cand<>y) group by 1,2,3""")
def _(s, d):
    return M.rescue_harm(two(s, d), ["fold"])


_PW = "select a.sample_id, a.model a, b.model b, a.y, a.yhat ya, b.yhat yb, case when a.yhat=a.y then a.yhat else b.yhat end yo from pred a join pred b on a.sample_id=b.sample_id and a.model<b.model"
_EB = """select a, b, y, arg_max(class_id,(round(p,12),-class_id)) yhat from (select x.sample_id, x.model a, z.model b, x.y, x.class_id, 0.5e0*x.p+0.5e0*z.p p
 from proba x join proba z on x.sample_id=z.sample_id and x.class_id=z.class_id and x.model<z.model) group by sample_id, a, b, y"""


@query("l18_diversity", "a b disagreement:d double_fault:d rescue_a rescue_b proba_corr:d oracle_macro_f1:d blend_macro_f1:d blend_gain:d", f"""
 with m as (select a, b, avg(cast(ya<>yb as int)) disagreement, avg(cast(ya<>y and yb<>y as int)) double_fault, count(*) filter (ya=y and yb<>y) rescue_a, count(*) filter (yb=y and ya<>y) rescue_b from ({_PW}) group by 1,2),
 r as (select x.model a, z.model b, corr(x.p,z.p) proba_corr from proba x join proba z on x.sample_id=z.sample_id and x.class_id=z.class_id and x.model<z.model group by 1,2),
 o as ({macro(f"select a, b, y, yo yhat from ({_PW})", "a, b", "5")}), e as ({macro(_EB, "a, b", "5")}), s as ({macro("select model, y, yhat from pred", "model", "5")})
 select m.*, proba_corr, o.macro_f1 oracle_macro_f1, e.macro_f1 blend_macro_f1, e.macro_f1-greatest(p.macro_f1,q.macro_f1) blend_gain
 from m join r using (a,b) join o using (a,b) join e using (a,b) join s p on p.model=m.a join s q on q.model=m.b""")
def _(s, d):
    return M.diversity(None, W.proba(s, d), C, range(W.MODELS))


@query("l19_leaderboard", "model macro_f1:d fold_mean:d fold_std:d rank class_delta:d unique_rescue is_global is_class_specialist is_rescuer", f"""
 with s as ({macro("select model, y, yhat from pred", "model", "5")}), f as (select model, avg(macro_f1) fold_mean, stddev_pop(macro_f1) fold_std from ({_FOLDF}) group by 1),
 r as (select *, row_number() over (order by round(macro_f1,9) desc, model) rank from s join f using (model)), c as ({_CL.format(k='model,', t='pred')}),
 l as (select model from r where rank=1), lf as (select c, f1 from c where model=(select model from l)),
 cd as (select model, max(c.f1-coalesce(lf.f1,0)) class_delta from c left join lf using (c) group by 1),
 u as (select p.model, count(*) filter (p.yhat=p.y and q.yhat<>p.y) unique_rescue from pred p join pred q on p.sample_id=q.sample_id and q.model=(select model from l) group by 1)
 select r.*, class_delta, unique_rescue, cast(macro_f1>=(select max(macro_f1) from r)-0.025 as int) is_global, cast(class_delta>=0.05 as int) is_class_specialist,
  cast(unique_rescue>=3 as int) is_rescuer from r join cd using (model) join u using (model)""")
def _(s, d):
    return M.leaderboard(pred(s, d), C)


_STATS = f"""select 'm'||model "name", avg(macro_f1) mean, stddev_samp(macro_f1)/sqrt(5) se, max(macro_f1)-min(macro_f1) gap, 3-model complexity, min(macro_f1) worst_floor,
 1 noninferior, cast(model<>0 as int) collision, model*10 net_rescue from ({_FOLDF}) group by model"""


def stats(s, d):
    f = M.macro_f1(pred(s, d), ["model", "fold"], C).groupBy("model").agg(
        F.avg("macro_f1").alias("mean"), (F.stddev_samp("macro_f1") / F.sqrt(F.lit(5.0))).alias("se"),
        (F.max("macro_f1") - F.min("macro_f1")).alias("gap"), F.min("macro_f1").alias("worst_floor"))
    m = F.col("model")
    return f.select(F.concat(F.lit("m"), m.cast("string")).alias("name"), "mean", "se", "gap", (3 - m).alias("complexity"), "worst_floor",
                    F.lit(1).alias("noninferior"), (m != 0).cast("int").alias("collision"), (m * 10).alias("net_rescue"))


@query("l20_one_se", "name:s mean:d se:d gap:d complexity rank", f"""
 with st as ({_STATS}), b as (select * from st order by mean desc limit 1)
 select st."name", st.mean, st.se, st.gap, st.complexity, row_number() over (order by st.gap, st.complexity, st.mean desc, st."name") rank from st, b where st.mean>=b.mean-b.se""")
def _(s, d):
    return M.one_se(stats(s, d))


@query("l21_select_roles", "role:s name:s qualified", f"""
 with st as ({_STATS}), b as (select * from st order by mean desc limit 1),
 p as (select st.* from st, b where st.mean>=b.mean-b.se order by st.gap, st.complexity, st.mean desc limit 1),
 r as (select st."name", cast(st.worst_floor>p.worst_floor as int) q from st, p where st."name"<>p."name" order by 2 desc, st.worst_floor desc limit 1),
 s as (select "name", cast(noninferior=1 and collision=1 as int) q from st where "name" not in (select "name" from p) and "name" not in (select "name" from r) order by 2 desc, net_rescue desc limit 1)
 select 'primary' role, "name", 1 qualified from p union all select 'robustness', "name", q from r union all select 'specialization', "name", q from s""")
def _(s, d):
    return M.select_roles(stats(s, d))


@query("l22_reference_delta", "fold candidate:d reference:d delta:d", f"""
 select fold, max(case when model=1 then macro_f1 end) candidate, max(case when model=0 then macro_f1 end) reference,
  max(case when model=1 then macro_f1 end)-max(case when model=0 then macro_f1 end) delta from ({_FOLDF}) group by 1""")
def _(s, d):
    f = M.macro_f1(pred(s, d), ["model", "fold"], C)
    return M.reference_delta(f.filter("model = 1"), f.filter("model = 0"), ["fold"])


@query("l23_adopt", "mean_delta:d ci_lower:d all_improved adopted", f"""
 select avg(delta) mean_delta, 0.001 ci_lower, cast(min(delta)>0 as int) all_improved, cast(avg(delta)>0 and min(delta)>0 as int) adopted from ({_SD})""")
def _(s, d):
    return M.adopt(M.seed_deltas(two3(s, d), C), 0.001)


@query("l24_changed", "n changed", "select count(*) n, count(*) filter (cand<>base) changed from two")
def _(s, d):
    return M.changed(two(s, d))


_DIR = "(values (0,1),(1,0),(2,3),(4,2)) o(source,target)"
_CE = "select source, target, seed, (y=source or y=target) inside, which, y, yhat from (select seed, y, unnest(['base','cand']) which, unnest([base,cand]) yhat from two3) cross join " + _DIR


@query("l25_collision_evidence", "source target seeds_net seeds_gain rescue net_rescue outside_delta:d qualifies", f"""
 with n as (select source, target, seed, count(*) filter (y=source and base=target and cand=y) rescue, count(*) filter (base=y and cand<>y) harm from two3 cross join {_DIR} group by 1,2,3),
 f as ({_CL.format(k='source, target, seed, inside, which,', t='('+_CE+')')}),
 g as (select source, target, seed, sum(case when inside and (c=source or c=target) then (case when which='cand' then f1 else -f1 end) end)/2 pd,
  sum(case when not inside then (case when which='cand' then f1 else -f1 end) end)/5 od from f group by 1,2,3)
 select source, target, count(*) filter (rescue>harm) seeds_net, count(*) filter (round(pd,9)>=0.05) seeds_gain, sum(rescue) rescue, sum(rescue-harm) net_rescue, avg(od) outside_delta,
  cast(count(*) filter (rescue>harm)>=2 and count(*) filter (round(pd,9)>=0.05)>=2 and sum(rescue)>=3 and round(avg(od),9)>=-0.02 as int) qualifies
 from n join g using (source, target, seed) group by 1,2""")
def _(s, d):
    return M.collision_evidence(two3(s, d), [(0, 1), (1, 0), (2, 3), (4, 2)], C, 0.02)
