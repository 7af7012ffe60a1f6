"""Grid, trial and rule searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenfold.functions import probs as PR
from tokenfold.operators import folds as J
from tokenfold.operators import metrics as M
from tokenfold.operators import proba as P
from tokenfold.operators import search as X
from tokenfold.workload import query
from tokenfold.workload import views as W
from tokenfold.workload.q_metrics import _CL, groups
from tokenfold.workload.q_proba import _PRIOR, model, models
from tokenfold.workload.q_signatures import macro

C = W.CLASSES
NAMES = [0, 1, 2]


def folded(df, s, d):
    """Rows with their fold, merged by sample: the planner sizes probabilities and folds by the file they are computed from."""
    return df.hint("merge").join(W.labelled(s, d).select("sample_id", "fold"), "sample_id")


def values(name: str, rows: list[tuple], cols: str) -> str:
    return f"(values {', '.join('(' + ', '.join(repr(v) for v in r) + ')' for r in rows)}) {name}({cols})"


def hat(src: str, keys: str) -> str:
    """Arg-max (y, yhat) per key of (keys, class_id, y, p) rows."""
    return f"(select {keys}, max(y) y, arg_max(class_id,(round(p,12),-class_id)) yhat from ({src}) group by {keys})"


GA, TE = [0.0, 0.25, 0.5], [0.8, 1.0, 1.5]
_G9 = [(i * 3 + j, g, t) for i, g in enumerate(GA) for j, t in enumerate(TE)]
_K9 = hat(f"select g, sample_id, class_id, y, pow(p,1/temperature)/pow(q,gamma) p from p0 join ({_PRIOR}) on c=class_id cross join {values('z', _G9, 'g, gamma, temperature')}", "g, sample_id")


@query("k9_select_prior", "gamma:d temperature:d macro_f1:d rank selected", f"""
 with f as ({macro(f"select g, y, yhat from {_K9}", "g")}), b as ({macro("select y, yhat from pred where model=0")}),
 r as (select gamma, temperature, f.macro_f1, row_number() over (order by round(f.macro_f1,9) desc, gamma, abs(temperature-1)) rank from f join {values('z', _G9, 'g, gamma, temperature')} using (g))
 select r.*, cast(rank=1 and r.macro_f1>=(select macro_f1 from b)+0.0005 as int) selected from r""")
def _(s, d):
    m = model(s, d, 0)
    return X.select_prior(m, P.class_prior(m, C), GA, TE, 0.0005)


_K10 = [0.8, 0.9, 1.0, 1.1, 1.25]


def _thresholds(rounds: int = 2, shrinkage: float = 0.01) -> str:
    """The coordinate search step by step, every candidate scored on every row."""
    cls = range(C)
    cand = values("z", list(enumerate(_K10)), "i, f")
    wide = ", ".join(f"max(case when class_id={c} then least(greatest(p,1e-12),1e0) end) p{c}" for c in cls)

    def scored(name: str, src: str, factors: list[str]) -> str:
        best = "list_max([" + ", ".join(f"p{c}/{f}" for c, f in zip(cls, factors)) + "])"
        choice = "case " + " ".join(f"when p{c}/{f}={best} then {c}" for c, f in zip(cls, factors)) + " end"
        pen = " + ".join(f"pow(ln({f}),2)" for f in factors)
        counts = f"select part, i, y, {choice} yhat, max({pen}) pen, count(*) n from {src} group by all"
        return f"""{name}n as materialized ({counts}), {name} as materialized (
 select part, i, sum(2e0*tp/(nt+np))/count(*)-{shrinkage}*max(pen)/{C} score from (select part, i, c, sum(tp) tp, sum(nt) nt, sum(np) np, max(pen) pen from (
  select part, i, y c, case when y=yhat then n else 0 end tp, n nt, 0 np, pen from {name}n union all select part, i, yhat, 0, 0, n, pen from {name}n) group by 1,2,3) group by 1,2)"""

    ctes = [f"w as materialized (select sample_id, f.fold, max(y) y, {wide} from p0 join folds f using (sample_id) group by 1,2)",
            "r as (select part, w.* from w cross join (select unnest([0,1,2,3,4,-1]) part) where part<>fold)",
            scored("b", "(select 0 i, r.* from r)", ["1e0"] * C),
            f"s0 as materialized (select part, {', '.join(f'1e0 f{c}' for c in cls)}, score best from b)"]
    t = 0
    for _ in range(rounds):
        for c in cls:
            fs = [f"f{x}" if x != c else "f" for x in cls]
            ctes.append(scored(f"t{t}", f"(select i, f, s{t}.* exclude (part, best), r.* from r join s{t} on s{t}.part=r.part cross join {cand})", fs))
            ctes.append(f"""m{t} as (select part, arg_max(struct_pack(f:=f, score:=score), (round(score,9), round(-abs(ln(f)),12), -i)) x from t{t} join {cand} using (i) group by 1)""")
            better = f"(round(x.score,9), round(-abs(ln(x.f)),12)) > (round(best,9), round(-abs(ln(f{c})),12))"
            kept = ", ".join(f"f{x}" if x != c else f"case when {better} then x.f else f{c} end f{c}" for x in cls)
            ctes.append(f"s{t + 1} as materialized (select part, {kept}, case when {better} then x.score else best end best from s{t} join m{t} using (part))")
            t += 1
    of = lambda x: "case " + " ".join(f"when p{c}{x(c)}=list_max([{', '.join(f'p{e}{x(e)}' for e in cls)}]) then {c}" for c in cls) + " end"
    ctes.append(f"h as (select y, {of(lambda c: '')} base, {of(lambda c: f'/f{c}')} cand from w join s{t} on s{t}.part=w.fold)")
    ctes.append(f"v as (select ({macro('select y, base yhat from h')}) base_f1, ({macro('select y, cand yhat from h')}) crossfit_f1)")
    each = " union all ".join(f"select part, {c} class_id, f{c} factor from s{t}" for c in cls)
    return f"with {', '.join(ctes)} select part, class_id, factor, base_f1, crossfit_f1, cast(crossfit_f1>=base_f1 as int) accepted from ({each}), v"


@query("k10_class_thresholds", "part class_id factor:d base_f1:d crossfit_f1:d accepted", _thresholds())
def _(s, d):
    return X.class_thresholds(folded(model(s, d, 0), s, d), C, _K10, W.K)


TS, WS = [0.8, 1.0, 1.25], [0.0, 0.2, 0.4]
_G11 = [(i * 3 + j, t, w) for i, t in enumerate(TS) for j, w in enumerate(WS)]
_SEEDED = """select f.seed, f.fold, a.sample_id, a.class_id, a.y, a.p p, b.p q from proba a join proba b on a.sample_id=b.sample_id and a.class_id=b.class_id and b.model=(a.model+1)%3
 join folds3 f on f.sample_id=a.sample_id and f.seed=42+a.model"""
_K11 = hat(f"""select g, seed, fold, sample_id, class_id, y, (1-weight)*p+weight*q p from (
 select g, weight, seed, fold, sample_id, class_id, y, p, u/sum(u) over (partition by g, seed, sample_id) q from (select *, pow(q,1/temperature) u from ({_SEEDED}) cross join {values('z', _G11, 'g, temperature, weight')}))""", "g, seed, fold, sample_id")
_SELC = f"""(with h as (select * from {_K11}), t as ({macro("select g, seed, k, y, yhat from h cross join (select unnest(range(5)) k) where fold<>k", "g, seed, k", "5")}),
 e as ({macro("select g, seed, fold, y, yhat from h", "g, seed, fold", "5")}),
 r as (select t.*, temperature, weight, row_number() over (partition by seed, k order by round(macro_f1,9) desc, round(abs(ln(temperature))+0.01*weight,9), g) rk from t join {values('z', _G11, 'g, temperature, weight')} using (g))
 select r.seed, r.k fold, temperature, weight, r.macro_f1 tuning_macro_f1, e.macro_f1 evaluation_macro_f1 from r join e on e.g=r.g and e.seed=r.seed and e.fold=r.k where rk=1)"""


def seeded(s, d):
    """Model m is the base of seed 42+m, the next model its auxiliary."""
    m = models(s, d)
    opts = F.explode(F.array(*[F.struct(F.lit(42 + i).alias("seed"), F.element_at("m", F.lit(i)).alias("p"), F.element_at("m", F.lit((i + 1) % 3)).alias("q")) for i in range(3)]))
    r = m.select("sample_id", "y", opts.alias("o")).select("sample_id", "y", "o.*")
    return r.hint("merge").join(W.folds(s, d, W.SEEDS).select("sample_id", "seed", "fold"), ["sample_id", "seed"])


@query("k11_crossfit_select", "seed fold temperature:d weight:d tuning_macro_f1:d evaluation_macro_f1:d", f"select * from {_SELC}")
def _(s, d):
    return X.crossfit_select(seeded(s, d), TS, WS, W.K, C)


@query("k12_apply_selected", "seed sample_id class_id p:d", f"""
 select seed, sample_id, class_id, (1-weight)*p+weight*u/sum(u) over (partition by seed, sample_id) p from (
 select x.*, weight, pow(q,1/temperature) u from ({_SEEDED}) x join {_SELC} using (seed, fold))""")
def _(s, d):
    b = seeded(s, d)
    return P.unpack(X.apply_selected(b, X.crossfit_select(b, TS, WS, W.K, C)))


_T13 = [(i, t) for i, t in enumerate([0.5, 0.8, 1.0, 1.4, 2.0])]


@query("k13_fit_temperature", "temperature:d logloss:d rank", f"""
 select temperature, avg(ll) logloss, row_number() over (order by round(avg(ll),9), max(g)) rank from (select g, temperature, sample_id, -ln(greatest(max(case when class_id=y then u end)/sum(u),1e-12)) ll
 from (select *, pow(p,1/temperature) u from p0 cross join {values('z', _T13, 'g, temperature')}) group by 1,2,3) group by 1""")
def _(s, d):
    return X.fit_temperature(model(s, d, 0), [t for _, t in _T13])


_BND = {0: (0.3, 0.7), 1: (0.1, 0.4), 2: (0.1, 0.4)}
_G14 = [(i, *w) for i, w in enumerate(X.simplex_grid(NAMES, 10, _BND))]


@query("k14_fit_blend", "g w0:d w1:d w2:d logloss:d objective:d rank", f"""
 with l as (select g, w0, w1, w2, sample_id, -ln(greatest(max(case when class_id=y then u end)/sum(u),1e-12)) ll from (
  select g, w0, w1, w2, sample_id, class_id, max(y) y, exp(sum((case model when 0 then w0 when 1 then w1 else w2 end)*ln(greatest(p,1e-12)))) u from proba cross join {values('z', _G14, 'g, w0, w1, w2')} group by 1,2,3,4,5,6) group by 1,2,3,4,5),
 o as (select g, w0, w1, w2, avg(ll) logloss, avg(ll)+0.01e0*(pow(w0-0.5e0,2)+pow(w1-0.25e0,2)+pow(w2-0.25e0,2)) objective from l group by 1,2,3,4)
 select *, row_number() over (order by round(objective,9), g) rank from o""")
def _(s, d):
    return X.fit_blend(models(s, d), _BND, {0: 0.5, 1: 0.25, 2: 0.25}, 0.01, 10)


def _zoomed(levels: int = 20, cells: int = 12) -> str:
    """Weights by grids that zoom in: each level spans half of the last one around its best point."""
    ctes = ["l as materialized (select sample_id, class_id, max(y) y, " + ", ".join(
        f"max(case when model={n} then ln(greatest(p,1e-12)) end) l{n}" for n in NAMES) + " from proba group by 1,2)",
        "z0 as (select 0.5e0 c0, 0.25e0 c1)"]
    low, high = zip(*(_BND[n] for n in NAMES))
    for t in range(levels):
        step = 0.4 / cells / 2**t
        ctes.append(f"""g{t} as materialized (select distinct w0, w1, 1e0-w0-w1 w2 from (select least(greatest(c0+i*{step!r},{low[0]}),{high[0]}) w0, least(greatest(c1+j*{step!r},{low[1]}),{high[1]}) w1
 from z{t} cross join (select unnest(range({-cells // 2}, {cells // 2 + 1})) i) cross join (select unnest(range({-cells // 2}, {cells // 2 + 1})) j)) where 1e0-w0-w1 between {low[2]} and {high[2]})""")
        ctes.append(f"""o{t} as materialized (select w0, w1, w2, avg(ll) logloss, avg(ll)+0.01e0*(pow(w0-0.5e0,2)+pow(w1-0.25e0,2)+pow(w2-0.25e0,2)) objective from (
 select w0, w1, w2, sample_id, -ln(greatest(max(case when class_id=y then u end)/sum(u),1e-12)) ll from (
  select w0, w1, w2, sample_id, class_id, y, exp(w0*l0+w1*l1+w2*l2) u from l cross join g{t}) group by 1,2,3,4) group by 1,2,3)""")
        ctes.append(f"z{t + 1} as materialized (select arg_min(w0, objective) c0, arg_min(w1, objective) c1 from o{t})")
    last = f"(select * from o{levels - 1} order by objective limit 1)"
    return f"with {', '.join(ctes)} select unnest(['0','1','2']) model, unnest([round(w0,4),round(w1,4),round(w2,4)]) weight, logloss, objective from {last}"


@query("k14_newton_blend", "model:s weight:d logloss:d objective:d", _zoomed())
def _(s, d):
    return X.newton_blend(models(s, d), _BND, {0: 0.5, 1: 0.25, 2: 0.25}, 0.01).withColumn("weight", F.round("weight", 4))


TRIALS = X.dirichlet_trials(NAMES, 12, 730)
_TV = values("z", [tuple(t.values()) for t in TRIALS], "g, w0, w1, w2")


def _trial(tv: str, extra: str = "") -> str:
    return hat(f"select g, {extra} sample_id, class_id, max(y) y, sum((case model when 0 then w0 when 1 then w1 else w2 end)*p) p from proba cross join {tv} group by all", "g, sample_id")


@query("k15_trial_search", "g w0:d w1:d w2:d macro_f1:d rank", f"""
 select z.*, macro_f1, row_number() over (order by round(macro_f1,9) desc, g) rank from ({macro(f"select g, y, yhat from {_trial(_TV)}", "g", "5")}) join {_TV} using (g)""")
def _(s, d):
    return X.trial_search(models(s, d), NAMES, TRIALS, C)


_SUBS = [(0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)]
_SV = values("z", [("+".join(map(str, x)), len(x), *[(1 / len(x) if m in x else 0.0) for m in NAMES]) for x in _SUBS], "g, size, w0, w1, w2")
_EQ = f"""(select z.g models, size, macro_f1 from ({macro(f"select g, y, yhat from {_trial(_SV)}", "g", "5")}) join {_SV} using (g))"""


@query("k16_equal_blends", "models:s size macro_f1:d", f"select * from {_EQ}")
def _(s, d):
    return X.equal_blends(models(s, d), NAMES, [1, 2, 3], C)


@query("k17_select_subset", "models:s size macro_f1:d rank", f"""
 select *, row_number() over (order by size, round(macro_f1,9) desc, models) rank from {_EQ} where round(macro_f1,9)>=(select round(max(macro_f1)-0.05,9) from {_EQ})""")
def _(s, d):
    return X.select_subset(X.equal_blends(models(s, d), NAMES, [1, 2, 3], C), 0.05)


ROLES = {"0": "global", "1": "anchor", "2": "expert"}


@query("k41_role_subsets", "models:s size macro_f1:d", f"select * from {_EQ} where models in ('0','0+1','0+2','0+1+2')")
def _(s, d):
    subs = [tuple(int(m) for m in t) for n in (1, 2, 3) for t in X.role_subsets(ROLES, n)]
    return X.equal_blends(models(s, d), NAMES, [], C, subs)


_TF = hat(f"select g, sample_id, class_id, max(y) y, sum((case model when 0 then w0 when 1 then w1 else w2 end)*p) p from proba cross join {_TV} group by all", "g, sample_id")


@query("k40_select_trial", "unit trial selection:d macro_f1:d", f"""
 with f as ({macro(f"select g, fold, y, yhat from {_TF} join folds using (sample_id)", "g, fold", "5")}),
 u as (select h unit, g trial, avg(macro_f1) filter (fold<>h) selection, max(macro_f1) filter (fold=h) macro_f1 from f cross join (select unnest(range(5)) h) group by 1,2)
 select unit, trial, selection, macro_f1 from (select *, row_number() over (partition by unit order by round(selection,9) desc, trial) r from u) where r=1""")
def _(s, d):
    conf = X.trial_confusion(folded(models(s, d), s, d), NAMES, TRIALS, ["fold"])
    f = M.macro_f1(conf, ["g", "fold"], C, counted=True)
    return X.select_trial(f.select(F.col("g").alias("trial"), F.col("fold").alias("unit"), "macro_f1"))


_NT = X.subset_trials(NAMES, _SUBS)
_NV = values("z", [(*t.values(), len(x)) for t, x in zip(_NT, _SUBS)], "g, w0, w1, w2, size")
_NC = f"""h as materialized ({_trial(_NV)}), i as (select sample_id, o outer_fold, (row_number() over (partition by o, label order by md5(concat(sample_id,'|',42*1009+o*9173)))-1)%4 inner_fold
  from folds cross join (select unnest(range(5)) o) where fold<>o union all select sample_id, fold, -1 from folds),
 c as materialized (select outer_fold, inner_fold, g, y, yhat from h join i using (sample_id))"""


@query("k15_nested_cube", "outer inner g y yhat n", f"""
 with {_NC} select outer_fold "outer", inner_fold "inner", g, y, yhat, count(*) n from c group by 1,2,3,4,5""")
def _(s, d):
    return X.nested_cube(folded(models(s, d), s, d), NAMES, _NT, J.nested_folds(W.labelled(s, d), 5, 4, 42))


@query("k17_nested_select", "outer rule:s g inner_mean:d inner_se:d held:d", f"""
 with {_NC}, f as materialized ({macro("select outer_fold, inner_fold, g, y, yhat from c", "outer_fold, inner_fold, g", "5")}),
 m as (select outer_fold, g, avg(macro_f1) filter (inner_fold>=0) inner_mean, stddev_samp(macro_f1) filter (inner_fold>=0)/2 inner_se, max(macro_f1) filter (inner_fold=-1) held from f group by 1,2),
 b as (select * from (select m.*, row_number() over (partition by outer_fold order by round(inner_mean,9) desc, g) r from m) where r=1),
 n as (select m.*, row_number() over (partition by m.outer_fold order by size, round(m.inner_mean,9) desc, m.g) r from m join {_NV} using (g) join b using (outer_fold)
  where round(m.inner_mean,9)>=round(b.inner_mean-b.inner_se,9))
 select outer_fold "outer", 'best' rule, g, inner_mean, inner_se, held from b union all select outer_fold, 'one_se', g, inner_mean, inner_se, held from n where r=1""")
def _(s, d):
    cube = X.nested_cube(folded(models(s, d), s, d), NAMES, _NT, J.nested_folds(W.labelled(s, d), 5, 4, 42))
    return X.nested_select(cube, _NT, C)


# --- pair rules --------------------------------------------------------------------------------
RG = list(X.RULE_GRID)
_RV = values("z", [(a, b) for a in RG for b in RG], "margin, alpha")
_RB = "(select b.sample_id, b.y, f.fold, top1, top2, gap, m1, m2 from best0 b join folds f using (sample_id))"


def rule_sql() -> str:
    """Every rule applied to all rows, scored by brute force."""
    ps = f"(select y source, top1 target, count(*) support from {_RB} where y<>top1 group by 1,2 having count(*)>=3)"
    new = "case when top1=target and top2=source and gap<=margin+1e-12 and (m2+alpha*m1>m1-alpha*m1 or (source<target and m2+alpha*m1=m1-alpha*m1)) then source else top1 end"
    app = f"select source, target, support, margin, alpha, fold, y, top1, {new} yhat from {_RB} cross join {ps} cross join {_RV}"
    key = "source, target, margin, alpha"
    return f"""(with a as ({app}), o as (select {key}, c, f1 from ({_CL.format(k=key + ',', t='a')})), b as (select c, f1 from ({_CL.format(k='', t='(select y, top1 yhat from ' + _RB + ')')})),
  fo as (select {key}, fold, sum(f1)/5 m from ({_CL.format(k=key + ', fold,', t='a')}) group by all), fb as (select fold, sum(f1)/5 m0 from ({_CL.format(k='fold,', t='(select fold, y, top1 yhat from ' + _RB + ')')}) group by 1),
  e as (select {key}, max(support) support, count(*) filter (top1<>y and yhat=y) rescue, count(*) filter (top1=y and yhat<>y) harm from a group by {key}),
  pf as (select {key}, count(*) filter (net>0) positive_folds from (select {key}, fold, count(*) filter (top1<>y and yhat=y)-count(*) filter (top1=y and yhat<>y) net from a group by {key}, fold) group by {key}),
  df as (select {key}, count(*) filter (m-m0<-1e-12) declining_folds from fo join fb using (fold) group by {key}),
  cd as (select {key}, min(o.f1-b.f1) worst_class_delta, sum(o.f1)/5 macro_f1, sum(o.f1-b.f1)/5 gain from o join b using (c) group by {key})
  select e.*, rescue-harm net_rescue, positive_folds, declining_folds, least(worst_class_delta,1) worst_class_delta, macro_f1, gain from e join pf using ({key}) join df using ({key}) join cd using ({key}))"""


@query("k33_rule_evidence", "source target margin:d alpha:d support rescue harm net_rescue positive_folds declining_folds gain:d macro_f1:d",
       f"select * from {rule_sql()} where rescue+harm>0 or exists (select 1 from {_RB} b where b.top1=target and b.top2=source and b.gap<=margin+1e-12 and (b.m2+alpha*b.m1>b.m1-alpha*b.m1 or (source<target and b.m2+alpha*b.m1=b.m1-alpha*b.m1)))")
def _(s, d):
    return X.rule_evidence(folded(model(s, d, 0), s, d), C, RG)


@query("k33_select_pair_rule", "source target margin:d alpha:d rescue harm net_rescue macro_f1:d rank", f"""
 select source, target, margin, alpha, rescue, harm, net_rescue, macro_f1, row_number() over (order by round(macro_f1,9) desc, net_rescue desc, rescue desc, harm, alpha, margin, source, target) rank
 from {rule_sql()} where rescue>=3 and net_rescue>0 and positive_folds>=2 and gain>=-1e-12 and declining_folds<=1 and worst_class_delta>=-1e-12""")
def _(s, d):
    return X.select_pair_rule(folded(model(s, d, 0), s, d), C, RG)


# Four-way grid with class and group safety: compared with brute force in the tests.
@query("k34_select_bidirectional_rule", "pm:d pa:d rm:d ra:d macro_f1:d pair_f1:d rescue harm net_rescue positive_folds class_margin:d group_margin:d rank")
def _(s, d):
    return X.select_bidirectional_rule(folded(model(s, d, 0), s, d), groups(s, d), C, (0, 1), W.K)


MW = [0.0, 0.1, 0.2, 0.3]
_MV = values("z", [(i, w) for i, w in enumerate(MW)], "g, weight")
_K35 = hat(f"select g, fold, sample_id, class_id, a.y, (1-weight)*a.p+weight*b.p p from p0 a join p1 b using (sample_id, class_id) join folds using (sample_id) cross join {_MV}", "g, fold, sample_id")


@query("k35_select_mix_weight", "weight:d mean_f1:d std_f1:d min_f1:d class_declines one_se eligible rank", f"""
 with h as (select * from {_K35}), f as ({_CL.format(k='g, fold,', t='h')}), m as (select g, fold, sum(f1)/5 m from f group by 1,2),
 s as (select g, avg(m) mean_f1, stddev_samp(m) std_f1, min(m) min_f1 from m group by 1),
 dc as (select g, max(n) class_declines from (select a.g, a.c, count(*) filter (a.f1<b.f1-1e-12) n from f a join f b on b.g=0 and b.fold=a.fold and b.c=a.c group by 1,2) group by 1),
 bs as (select mean_f1-std_f1/sqrt(5) lim from s join {_MV} using (g) order by round(mean_f1,9) desc, round(std_f1,9), weight limit 1),
 r as (select weight, mean_f1, std_f1, min_f1, class_declines, cast(mean_f1>=(select lim from bs)-1e-12 as int) one_se from s join dc using (g) join {_MV} using (g)),
 q as (select *, cast(weight>0 and one_se=1 and class_declines<2 as int) eligible from r)
 select *, row_number() over (order by eligible desc, round(min_f1,9) desc, round(mean_f1,9) desc, round(std_f1,9), weight) rank from q""")
def _(s, d):
    b = folded(model(s, d, 0), s, d).join(model(s, d, 1).select("sample_id", F.col("p").alias("q")), "sample_id")
    return X.select_mix_weight(b, C, W.K, MW)


@query("k35_select_mix_weight_groups", "weight:d mean_f1:d floor:d eligible rank")
def _(s, d):
    b = folded(model(s, d, 0), s, d).hint("merge").join(model(s, d, 1).select("sample_id", F.col("p").alias("q")), "sample_id")
    return X.select_mix_weight(b, C, W.K, MW, groups(s, d))


GP = [(0, 1), (1, 0), (2, 3)]
_GG = X.grid(expert=[1, 2], temperature=[1.0, 1.5], pair=GP, margin=[0.1, 0.3], confidence=[0.25], weight=[0.15, 0.3])
_GV = values("z", [(r["g"], r["expert"], r["temperature"], *r["pair"], r["margin"], r["confidence"], r["weight"]) for r in _GG], "g, expert, temperature, source, target, margin, confidence, weight")
_K36 = f"""(select g, source, target, b.sample_id, b.y, b.top1, coalesce(n.yhat,b.top1) yhat from best0 b cross join {_GV} left join
 {hat(f'''select g, sample_id, class_id, y, case when ok then (1-weight)*p+weight*q else p end p from (
  select g, sample_id, class_id, y, weight, p, q, max(q) over (partition by g, sample_id)>=confidence ok from (
   select g, a.sample_id, a.class_id, a.y, weight, confidence, a.p, pow(e.p,1/temperature)/sum(pow(e.p,1/temperature)) over (partition by g, a.sample_id) q
   from p0 a join (select sample_id, top1, top2, gap from best0) t using (sample_id) join {_GV} on t.top1=target and t.top2=source and gap<=margin
   join proba e on e.sample_id=a.sample_id and e.class_id=a.class_id and e.model=expert))''', "g, sample_id")} n on n.g=z.g and n.sample_id=b.sample_id)""".replace("select g, source", "select z.g, source")


@query("k36_select_gate", "g expert temperature:d source target margin:d confidence:d weight:d rescue harm net_rescue macro_f1:d rank", f"""
 with h as (select * from {_K36}), f as ({macro("select g, y, yhat from h", "g", "5")}),
 e as (select g, count(*) filter (y=source and top1=target and yhat=y) rescue, count(*) filter (top1=y and yhat<>y) harm, count(*) filter (y=source and top1=target) errors from h group by 1)
 select z.*, rescue, harm, rescue-harm net_rescue, macro_f1, row_number() over (order by round(macro_f1,9) desc, g) rank from f join e using (g) join {_GV} using (g) where errors>=3 and rescue>=3 and rescue>harm""")
def _(s, d):
    ex = W.proba(s, d).filter("model > 0")
    return X.select_gate(model(s, d, 0), ex, C, GP, [1.0, 1.5], [0.1, 0.3], [0.25], [0.15, 0.3], [1, 2])


_TG = f"select g, fold, dimension, grp, y, yhat from {_TF} join folds using (sample_id) join grpv using (sample_id)"


@query("k37_select_lanes", "role:s trial macro_f1:d floor:d collapse_folds", f"""
 with s as ({macro(f"select g, y, yhat from {_TF}", "g", "5")}), t as ({_TG}), go as ({macro("select g, dimension, grp, y, yhat from t", "g, dimension, grp", "5")}),
 gf as (select g, fold, min(macro_f1) ff from ({macro("select g, fold, dimension, grp, y, yhat from t", "g, fold, dimension, grp", "5")}) group by 1,2),
 p as (select g from s order by round(macro_f1,9) desc, g limit 1), fl as (select g, min(macro_f1) floor from go group by 1),
 c as (select a.g, count(*) filter (a.ff-b.ff<-1e-12) collapse_folds from gf a join gf b on b.fold=a.fold and b.g=(select g from p) group by 1),
 r as (select s.g trial, macro_f1, floor, collapse_folds from s join fl using (g) join c using (g))
 select 'primary' as role, * from r where trial=(select g from p) union all (select 'robustness', * from r where trial<>(select g from p) and collapse_folds<=3 order by round(floor,9) desc, round(macro_f1,9) desc, trial limit 1)""")
def _(s, d):
    return X.select_lanes(folded(models(s, d), s, d), NAMES, TRIALS, groups(s, d), C, 2, max_collapse=3)


@query("k38_consensus_pair", "source target total_net_rescue n", """
 with r as (select fold, y source, case when base<>y then base else cand end target, count(*) filter (base<>y)-count(*) filter (base=y) net from two where (base<>y and cand=y) or (base=y and cand<>y) group by 1,2,3),
 u as (select least(source,target) a, greatest(source,target) b, sum(net) net, count(*) n from r group by 1,2),
 o as (select source, target, sum(net) onet, count(*) ocnt from r group by 1,2)
 select source, target, net total_net_rescue, n from o join u on a=least(source,target) and b=greatest(source,target) order by net desc, n desc, a, b, onet desc, ocnt desc, source, target limit 1""")
def _(s, d):
    from tokenfold.workload.q_metrics import two

    return X.consensus_pair(M.rescue_harm(two(s, d), ["fold"]))
