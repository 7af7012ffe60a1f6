"""Probability-table operators on the three-model fixture."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tokenfold.functions import probs as PR
from tokenfold.operators import proba as P
from tokenfold.workload import query
from tokenfold.workload import views as W

C = W.CLASSES
PCOLS = "sample_id model class_id p:d"
ONE = "sample_id class_id p:d"

VIEWS = {
    "p0": "select sample_id, class_id, y, p from proba where model=0",
    "p1": "select sample_id, class_id, y, p from proba where model=1",
    "wide0": "select sample_id, max(y) y, list(p order by class_id) p from proba where model=0 group by 1",
    "wide1": "select sample_id, max(y) y, list(p order by class_id) p from proba where model=1 group by 1",
    # the two best classes of model 0
    "top0": """select sample_id, y, p, list_position(p,list_max(p))-1 top1, list_sort(p,'desc')[1] m1, list_sort(p,'desc')[2] m2,
  list_position(p,list_max(p)) i1 from wide0""",
    "best0": "select *, case when m1=m2 then list_position(list_transform(p, lambda x, i: case when i=i1 then -1 else x end), m2)-1 else list_position(p,m2)-1 end top2, m1-m2 gap from top0",
}
W.SQL.update(VIEWS)


def model(s, d, m):
    return W.proba(s, d).filter(F.col("model") == m).drop("model")


def models(s, d):
    return P.by_model(W.proba(s, d))


def norm(src: str, keys: str = "sample_id") -> str:
    """Renormalise column u over the classes of each key."""
    return f"select *, u/sum(u) over (partition by {keys}) p from ({src})"


def sel(src: str, cols: str = "sample_id, class_id, p") -> str:
    return f"select {cols} from ({src})"


def arr(expr: str, src: str, extra: str = "") -> str:
    """Unnest an array expression of packed rows to (sample_id, class_id, p)."""
    return f"select sample_id, {extra} unnest(range(5)) class_id, unnest({expr}) p from {src}"


@query("k1_softmax", PCOLS, sel(norm("select *, exp(ln(p)*10/0.7e0) u from (select sample_id, model, class_id, p from proba)", "sample_id, model"), "sample_id, model, class_id, p").replace("select *, u/sum", "select sample_id, model, class_id, u/sum"))
def _(s, d):
    scores = W.proba(s, d).withColumn("p", F.transform("p", lambda x: F.ln(x) * 10))
    return P.unpack(P.softmax(scores, 0.7))


@query("k2_calibrate", PCOLS, "select sample_id, model, class_id, u/sum(u) over (partition by sample_id, model) p from (select *, pow(greatest(p,1e-12),1/1.4e0) u from proba)")
def _(s, d):
    return P.unpack(P.calibrate(W.proba(s, d), 1.4))


@query("k3_blend", ONE, "select sample_id, class_id, 0.6e0*a.p+0.4e0*b.p p from p0 a join p1 b using (sample_id, class_id)")
def _(s, d):
    return P.unpack(P.blend(model(s, d, 0), model(s, d, 1), 0.4))


@query("k4_logit_combine", ONE, """select sample_id, class_id, exp(u)/sum(exp(u)) over (partition by sample_id) p from (
 select sample_id, class_id, 0.7e0*(a.p*10)/1.2e0+0.3e0*ln(greatest(b.p,1e-12))/0.9e0 u from p0 a join p1 b using (sample_id, class_id))""")
def _(s, d):
    scores = model(s, d, 0).withColumn("p", F.transform("p", lambda x: x * 10))
    return P.unpack(P.logit_combine(scores, model(s, d, 1), 1.2, 0.9, 0.3))


_W3 = "case model when 0 then 0.5e0 when 1 then 0.3e0 else 0.2e0 end"
W3 = {0: 0.5, 1: 0.3, 2: 0.2}


@query("k5_log_blend", ONE, f"select sample_id, class_id, exp(u)/sum(exp(u)) over (partition by sample_id) p from (select sample_id, class_id, sum({_W3}*ln(greatest(p,1e-12))) u from proba group by 1,2)")
def _(s, d):
    return P.unpack(P.log_blend(models(s, d), W3))


@query("k6_soft_vote", ONE, f"select sample_id, class_id, sum({_W3}*p) p from proba group by 1,2")
def _(s, d):
    return P.unpack(P.soft_vote(models(s, d), W3))


@query("k7_class_multiply", ONE, "select sample_id, class_id, u/sum(u) over (partition by sample_id) p from (select *, p*(1+class_id*0.137e0) u from p0)")
def _(s, d):
    return P.unpack(P.class_multiply(model(s, d, 0), [1 + 0.137 * c for c in range(C)]))


_PRIOR = "select y c, count(*)/(select count(*) from wide0) q from wide0 group by 1"


@query("k8_prior_adjust", ONE, f"""select sample_id, class_id, u/sum(u) over (partition by sample_id) p from (
 select sample_id, class_id, pow(p,1/1.3e0)/pow(q,0.5e0) u from p0 join ({_PRIOR}) on c=class_id)""")
def _(s, d):
    m = model(s, d, 0)
    return P.unpack(P.prior_adjust(m, P.class_prior(m, C), 0.5, 1.3))


# Pairs (0,1) and (2,3); model 1 is the expert.
def _share(l: int, r: int, t: float, off: float, p: str = "b.p") -> str:
    return f"(1/(1+exp(-((ln(greatest({p}[{r + 1}],1e-12))-ln(greatest({p}[{l + 1}],1e-12)))/{t}e0-{off}e0))))"


def _put(p: str, l: int, r: int, share: str) -> str:
    m = f"({p}[{l + 1}]+{p}[{r + 1}])"
    return f"list_transform({p}, lambda x, i: case when i={l + 1} then {m}*(1-{share}) when i={r + 1} then {m}*{share} else x end)"


def _br(p: str, l: int, r: int) -> str:
    return f"({p}[{r + 1}]/greatest({p}[{l + 1}]+{p}[{r + 1}],1e-12))"


_AB = "(select a.sample_id, a.y, a.p ap, b.p bp, list_position(a.p,list_max(a.p))-1 top from wide0 a join wide1 b using (sample_id))"


def ab(s, d):
    b = model(s, d, 1).select("sample_id", F.col("p").alias("bp"))
    return model(s, d, 0).join(b, "sample_id")


@query("k19_pair_right", "sample_id right:d", f"select sample_id, {_share(0, 1, 1.5, 0.2, 'p')} as \"right\" from wide1")
def _(s, d):
    return P.pair_right(model(s, d, 1), 0, 1, 1.5, 0.2)


_SH1 = f"(0.4e0*{_br('ap', 0, 1)}+0.6e0*{_share(0, 1, 1.5, 0.2, 'bp')})"
_SH2 = f"(0.7e0*{_br('ap', 2, 3)}+0.3e0*{_share(2, 3, 1.0, 0.0, 'bp')})"
_RED = f"""(select sample_id, y, top, case when top in (0,1) then {_put('ap', 0, 1, _SH1)} when top in (2,3) then {_put('ap', 2, 3, _SH2)} else ap end p,
 case when top in (0,1) then cast({_SH1}>=0.5 as int) when top in (2,3) then 2+cast({_SH2}>=0.5 as int) else top end strict from {_AB})"""


def _shares():
    e = F.col("bp")
    return {(0, 1): (PR.pair_right(e, 0, 1, 1.5, 0.2), 0.6), (2, 3): (PR.pair_right(e, 2, 3, 1.0, 0.0), 0.3)}


@query("k18_pair_redistribute", "sample_id class_id p:d yhat", f"select sample_id, unnest(range(5)) class_id, unnest(p) p, list_position(p,list_max(p))-1 yhat from {_RED}")
def _(s, d):
    return P.unpack(P.pair_redistribute(ab(s, d), _shares()).drop("bp"))


@query("k18_pair_redistribute_strict", "sample_id yhat", f"select sample_id, strict yhat from {_RED}")
def _(s, d):
    return P.pair_redistribute(ab(s, d), _shares(), strict=True)


_MX1 = f"(0.5e0*{_br('ap', 0, 1)}+0.2e0*{_br('bp', 0, 1)}+0.3e0*{_share(0, 1, 1.5, 0.2, 'bp')})"
_MX2 = f"(0.75e0*{_br('bp', 2, 3)}+0.25e0*{_share(2, 3, 1.0, 0.0, 'bp')})"


@query("k20_pair_mixture", "sample_id yhat", f"""select sample_id, list_position(p,list_max(p))-1 yhat from (
 select sample_id, case when top in (0,1) then {_put('ap', 0, 1, _MX1)} when top in (2,3) then {_put('ap', 2, 3, _MX2)} else ap end p from {_AB})""")
def _(s, d):
    e = F.col("bp")
    return P.pair_mixture(ab(s, d), {
        (0, 1): (0.5, [(PR.base_right(e, 0, 1), 0.2), (PR.pair_right(e, 0, 1, 1.5, 0.2), 0.3)]),
        (2, 3): (0.0, [(PR.base_right(e, 2, 3), 0.75), (PR.pair_right(e, 2, 3, 1.0, 0.0), 0.25)])})


@query("k21_collision_expert", ONE, arr(f"case when top in (0,1) then {_put('ap', 0, 1, _br('bp', 0, 1))} else ap end", _AB))
def _(s, d):
    return P.unpack(P.collision_expert(ab(s, d), 0, 1, PR.base_right(F.col("bp"), 0, 1)).drop("bp"))


_LN = "(select sample_id, top1, top2, list_transform(p, lambda x: ln(x)) s, b.p bp from best0 join wide1 b using (sample_id))"
_MAR = "(0.6e0*(s[2]-s[1])+0.4e0*(ln(bp[2])-ln(bp[1])))"
_SMX = "((exp(s[1]/0.8e0)+exp(s[2]/0.8e0))/list_sum(list_transform(s, lambda x: exp(x/0.8e0))))"


@query("k22_pair_margin", ONE, arr(f"""case when least(top1,top2)=0 and greatest(top1,top2)=1 and {_SMX}>=0.4e0 then
 list_transform(s, lambda x, i: case when i=1 then (s[1]+s[2])/2-{_MAR}/2 when i=2 then (s[1]+s[2])/2+{_MAR}/2 else x end) else s end""", _LN.replace("b.p bp", "wide1.p bp").replace("wide1 b", "wide1").replace("select sample_id, top1, top2, list_transform(p", "select sample_id, top1, top2, list_transform(best0.p")))
def _(s, d):
    sc = ab(s, d).withColumn("p", F.transform("p", F.ln))
    margin = F.ln(PR.at(F.col("bp"), 1)) - F.ln(PR.at(F.col("bp"), 0))
    return P.unpack(P.pair_margin(sc, 0, 1, margin, 0.4, 0.8, 0.4).drop("bp"))


_BIAS = "list_transform(p, lambda x, i: case when i=2 then p[2]*(1-0.2e0) when i=1 then p[1]+0.2e0*p[2] else x end)"


@query("k23_pair_bias", ONE, arr(f"case when top1=1 and top2=0 and gap<=0.1e0+1e-12 then {_BIAS} else p end", "best0"))
def _(s, d):
    return P.unpack(P.pair_bias(model(s, d, 0), (0, 1), 0.1, 0.2))


@query("k24_gate", ONE, """select sample_id, class_id, case when top1=1 and top2=0 and gap<=0.2e0 and cx>=0.3e0 then 0.75e0*p0.p+0.25e0*p1.p else p0.p end p
 from p0 join p1 using (sample_id, class_id) join (select sample_id, top1, top2, gap from best0) using (sample_id) join (select sample_id, max(p) cx from p1 group by 1) using (sample_id)""")
def _(s, d):
    return P.unpack(P.gate(model(s, d, 0), model(s, d, 1), (0, 1), 0.2, 0.3, 0.25))


_TSX = "greatest(0,0)"


@query("k39_pair_sigmoid", ONE, arr(f"""case when least(top1,top2)=0 and greatest(top1,top2)=1 and ap[1]+ap[2]>=0.4e0 then
 {_put('ap', 0, 1, f"(0.5e0*{_br('ap', 0, 1)}+0.5e0/(1+exp(-(ln(bp[2])-ln(bp[1]))/1.5e0)))")} else ap end""",
 "(select sample_id, top1, top2, best0.p ap, wide1.p bp from best0 join wide1 using (sample_id))"))
def _(s, d):
    margin = F.ln(PR.at(F.col("bp"), 1)) - F.ln(PR.at(F.col("bp"), 0))
    return P.unpack(P.pair_sigmoid(ab(s, d), 0, 1, margin, 1.5, 0.5, 0.4).drop("bp"))


# --- votes: the arg-max of each model is a vote -------------------------------------------------
_V = "(select sample_id, y, fold, max(case when model=0 then yhat end) v0, max(case when model=1 then yhat end) v1, max(case when model=2 then yhat end) v2 from pred group by 1,2,3)"


def votes(s, d):
    m = W.proba(s, d).groupBy("sample_id", "y").agg(
        *[F.max(F.when(F.col("model") == i, PR.argmax(F.col("p")))).alias(f"v{i}") for i in range(3)])
    return m.join(W.labelled(s, d).select("sample_id", "fold"), "sample_id")


def _rules(k: str) -> str:
    """Rules per held part by brute force (k lists the held folds, -1 for none)."""
    return f"""(with t as (select h, v.* from {_V} v cross join ({k}) where fold<>h),
  w as (select h, y, sum(count(*)) over (partition by h)/(5e0*count(*)) w from t group by 1,2),
  u as (select h, v0, v1, v2, y, count(*) n, count(*)*max(w) u from t join w using (h,y) group by 1,2,3,4,5),
  b as (select h, v0, v1, v2, sum(n) cnt, arg_max(y,(round(u,9),-y)) filter (y in (v0,v1,v2)) yhat, max(u) filter (y in (v0,v1,v2)) g, coalesce(max(u) filter (y=v0),0) base from u group by 1,2,3,4)
  select h, v0, v1, v2, cnt "count", yhat from b where cnt>=3 and yhat<>v0 and g>base+0.5e0)"""


@query("k25_learn_vote_rules", "v0 v1 v2 count yhat", f"select * from {_rules('select -1 h')}")
def _(s, d):
    return P.learn_vote_rules(votes(s, d), ["v0", "v1", "v2"], C, 3, 0.5)


@query("k25_learn_vote_rules_oof", "held v0 v1 v2 count yhat", f"select h held, * exclude (h) from {_rules('select unnest(range(5)) h')}")
def _(s, d):
    return P.learn_vote_rules_oof(votes(s, d), ["v0", "v1", "v2"], C, 3, 0.5, W.K)


@query("k26_apply_vote_rules", "sample_id fold yhat", f"select v.sample_id, v.fold, coalesce(r.yhat,v.v0) yhat from {_V} v left join {_rules('select unnest(range(5)) h')} r on r.h=v.fold and r.v0=v.v0 and r.v1=v.v1 and r.v2=v.v2")
def _(s, d):
    v = votes(s, d)
    cols = ["v0", "v1", "v2"]
    return P.apply_vote_rules(v, P.learn_vote_rules_oof(v, cols, C, 3, 0.5, W.K), cols, by_fold=True)


@query("k27_align_classes", ONE, """select sample_id, class_id, u/sum(u) over (partition by sample_id) p from (
 select sample_id, class_id, case when p>=0.15e0 or m=p then p else 1e-7 end u from (select *, max(p) over (partition by sample_id) m from p0))""")
def _(s, d):
    long = P.unpack(model(s, d, 0).withColumn("m", F.array_max("p")))
    return P.unpack(P.align_classes(long.filter((F.col("p") >= 0.15) | (F.col("p") == F.col("m"))), C, 1e-7))


@query("k28_proba_violations", "n_rows incomplete not_finite negative bad_sum", """
 select count(*) n_rows, 0 incomplete, 0 not_finite, count(*) filter (lo<0) negative, count(*) filter (abs(s-1)>1e-6) bad_sum
 from (select sample_id, model, min(u) lo, sum(u) s from (select *, p-case when class_id=0 then 0.1e0 else 0 end u from proba) group by 1,2)""")
def _(s, d):
    first = F.transform("p", lambda x, i: x - F.when(i == 0, 0.1).otherwise(0.0))
    return P.proba_violations(W.proba(s, d).withColumn("p", first), C)


@query("k29_meta_features", "sample_id model class_id log_p:d entropy:d margin:d", """
 select sample_id, model, class_id, ln(p) log_p, sum(-p*ln(p)) over w entropy, max(p) over w - max(case when r=2 then p end) over w margin
 from (select *, row_number() over (partition by sample_id, model order by p desc, class_id) r from proba) window w as (partition by sample_id, model)""")
def _(s, d):
    m = P.meta_features(W.proba(s, d))
    return m.select("sample_id", "model", F.posexplode("log_p").alias("class_id", "log_p"), "entropy", "margin")


@query("k30_mean_argmax", "sample_id yhat", """select sample_id, arg_max(class_id,(round(p,12),-class_id)) yhat from (select sample_id, class_id, avg(p) p from proba group by 1,2) group by 1""")
def _(s, d):
    return P.mean_argmax(W.proba(s, d), C)


@query("k31_normalize_proba", ONE, "select sample_id, class_id, u/sum(u) over (partition by sample_id) p from (select *, greatest(p*3-0.2e0,1e-7) u from p0)")
def _(s, d):
    return P.unpack(P.normalize_proba(model(s, d, 0).withColumn("p", F.transform("p", lambda x: x * 3 - 0.2))))


@query("k32_class_weights", "y n balanced:d power:d effective:d", """
 with n as (select y, count(*) n from wide0 group by 1), t as (select *, sum(n) over ()/(5e0*n) b, 0.001e0/(1-pow(0.999e0,n)) r from n)
 select y, n, b balanced, least(greatest(pow(b,0.5e0),0.99),1.01) power, r/(sum(r*n) over ()/sum(n) over ()) effective from t""")
def _(s, d):
    m = model(s, d, 0)
    out = P.class_weights(m).withColumnRenamed("weight", "balanced")
    out = out.join(P.class_weights(m, "power", low=0.99, high=1.01).select("y", F.col("weight").alias("power")), "y")
    return out.join(P.class_weights(m, "effective").select("y", F.col("weight").alias("effective")), "y")
