"""Sources, profiling, folds and patterns."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tokenfold.operators import folds as J
from tokenfold.operators import patterns as P
from tokenfold.operators import quality as Q
from tokenfold.operators import summaries as Y
from tokenfold.session import drop_folder, settle, shared_folder
from tokenfold.sources import tables as A
from tokenfold.workload import query
from tokenfold.workload import views as W

_DIGEST = "concat_ws(':',count(*),sum(('0x'||substr(h,1,15))::BIGINT::HUGEINT),sum(('0x'||substr(h,17,15))::BIGINT::HUGEINT))"


def digest(parts: str, source: str, by: str) -> str:
    """SQL twin of the order-free digest, grouped by ``by``."""
    marked = "||".join(f"coalesce(length(cast({p} as varchar))||':'||cast({p} as varchar),'n')" for p in parts.split(","))
    return f"select {by}, {_DIGEST} key, count(*) n from (select *, md5({marked}) h from {source}) group by {by}"


# --- A: sources and contracts ---------------------------------------------------
@query("a1_read_wide", "sample_id label:s c_name:s c_nationkey c_acctbal:d",
       "select c_custkey sample_id, c_mktsegment label, c_name, c_nationkey, c_acctbal from customer")
def _(s, d):
    return A.read_wide(s, f"{d}/customer.parquet", "c_custkey", "c_mktsegment")


@query("a2_read_ids", "sample_id", "select c_custkey sample_id from customer")
def _(s, d):
    return A.read_ids(s, f"{d}/customer.parquet", "c_custkey")


@query("a3_read_folds", "sample_id seed fold", "select sample_id, seed, fold from folds3")
def _(s, d):
    f = W.folds(s, d, W.SEEDS)
    wide = f.groupBy("sample_id").agg(*[F.max(F.when(F.col("seed") == x, F.col("fold"))).alias(f"fold_seed_{x}") for x in W.SEEDS])
    return A.read_folds(wide, W.samples(s, d), W.SEEDS, W.K)



@query("a4_fold_violations", "check:s seed n", """
 with f as (select o_custkey sample_id, l_linenumber seed, cast(l_quantity as int)%6 fold from lineitem join orders on l_orderkey=o_orderkey),
 s as (select c_custkey sample_id from customer where c_acctbal>=0),
 u as (select seed, fold, count(*) c from f where sample_id in (select sample_id from s) group by 1,2)
 select 'duplicate' "check", seed, count(*) n from (select seed, sample_id from f group by 1,2 having count(*)>1) group by 2
 union all select 'out_of_range', seed, count(*) from f where fold not between 0 and 4 group by 2
 union all select 'unknown_id', seed, count(*) from f where sample_id not in (select sample_id from s) group by 2
 union all select 'missing_id', seed, (select count(*) from s)-sum(c) from u group by 2 having (select count(*) from s)<>sum(c)
 union all select 'unused_fold', seed, 5-count(*) from u group by 2 having count(*)<>5""")
def _(s, d):
    line = W.table(s, d, "lineitem").join(W.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    f = line.select(F.col("o_custkey").alias("sample_id"), F.col("l_linenumber").alias("seed"), (F.col("l_quantity").cast("int") % 6).alias("fold"))
    known = W.table(s, d, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("sample_id"))
    return A.fold_violations(f, known, 5)


def _round_trip(spark, name, write, read):
    """Write to a folder of its own in the shared place, read back, settle and drop the folder."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    write(folder)
    rows = settle(read(folder))
    drop_folder(spark, folder)
    return rows


@query("a5_write_scores", "seed sample_id label:s fold", "select seed, sample_id, label, fold from folds3")
def _(s, d):
    f = W.folds(s, d, W.SEEDS)
    return _round_trip(s, "scores", lambda p: A.write_scores(f, p), s.read.parquet)


@query("a6_write_predictions", "sample_id label:s", "select sample_id, label from samples")
def _(s, d):
    return _round_trip(s, "predictions", lambda p: A.write_predictions(W.samples(s, d), p),
                       lambda p: s.read.option("header", True).schema("sample_id long, label string").csv(p))


@query("a7_write_metrics", "label:s n balance:d", "select c_mktsegment label, count(*) n, round(sum(cast(c_acctbal as decimal(18,2))),2) balance from customer group by 1")
def _(s, d):
    m = W.table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(
        F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))
    return _round_trip(s, "metrics", lambda p: A.write_metrics(m, p), lambda p: s.read.schema("label string, n long, balance double").json(p))


@query("a8_required_columns", "place column:s present missing", """
 select 0 place, 'doc_id' as "column", 1 present, count(*) filter (doc_id is null) missing from documents
 union all select 1, 'text', 1, count(*) filter (text is null) from documents union all select 2, 'summary', 0, count(*) from documents""")
def _(s, d):
    return A.column_report(W.table(s, d, "documents"), ["doc_id", "text", "summary"])


@query("b7_schema_parity", "place column:s other:s a_rows b_rows", """
 select 1 place, 'c_name' as "column", 's_name' other, (select count(*) from customer) a_rows, (select count(*) from supplier) b_rows
 union all select 0, 'c_custkey', 's_suppkey', (select count(*) from customer), (select count(*) from supplier)""")
def _(s, d):
    left = W.table(s, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("nation"))
    return A.parity_report(left, W.table(s, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("nation")))


@query("a9_table_fingerprint", "n fingerprint:s",
       f"select n, sha256(key) fingerprint from ({digest('l_orderkey,l_partkey,l_linenumber', 'lineitem', '1')})".replace("select 1,", "select 1 one,").replace("group by 1", "group by one"))
def _(s, d):
    return A.table_fingerprint(W.table(s, d, "lineitem"), ["l_orderkey", "l_partkey", "l_linenumber"])


@query("a10_split_fingerprint", "seed fold n fingerprint:s",
       f"select seed, fold, n, sha256(key) fingerprint from ({digest('sample_id', 'folds3', 'seed, fold')})")
def _(s, d):
    return A.split_fingerprint(W.folds(s, d, W.SEEDS))


@query("a11_duplicate_keys", "l_partkey l_suppkey n", "select l_partkey, l_suppkey, count(*) n from lineitem group by 1,2 having count(*)>1")
def _(s, d):
    return A.duplicate_keys(W.table(s, d, "lineitem"), ["l_partkey", "l_suppkey"])


# --- B: profiling ------------------------------------------------------------------
def joined(s, d):
    """A wide table with nulls: every document with its labels where it has some."""
    return W.table(s, d, "documents").select("doc_id", "lang", "source", "n_chars", F.lit("v1").alias("version")).join(
        W.table(s, d, "labels"), "doc_id", "left").withColumn(
        "code", F.when(F.col("n_chars") % 400 == 0, F.lit("big")).otherwise(F.col("n_chars").cast("string")))


_WIDE = """select d.doc_id, lang, source, n_chars, 'v1' as version, quality, toxic,
 case when n_chars%400=0 then 'big' else cast(n_chars as varchar) end code from documents d left join labels l on l.doc_id=d.doc_id"""
_COLS = ["doc_id", "lang", "source", "n_chars", "version", "quality", "toxic", "code"]


def _each(expr: str, where: str = "") -> str:
    return " union all ".join(f"select '{c}' as \"column\", {expr.replace('@', c)} from ({_WIDE})" for c in _COLS)


@query("b1_missing_profile", "column:s missing",
       f"select * from ({_each('count(*) filter (@ is null) missing')}) where missing>0 order by missing desc, \"column\" limit 20")
def _(s, d):
    return Q.missing_profile(joined(s, d))


@query("b2_constant_columns", "column:s", f"select \"column\" from ({_each('count(distinct @)+max(cast(@ is null as int)) n')}) where n<=1")
def _(s, d):
    return Q.constant_columns(joined(s, d))


_NUM = _each("count(try_cast(@ as double))/nullif(count(@),0) share")


@query("b3_infer_numeric", "column:s share:d", f"select * from ({_NUM}) where share>=0.99")
def _(s, d):
    return Q.infer_numeric(joined(s, d))


@query("b4_numeric_profile", "column:s mean:d std:d min:d max:d", " union all ".join(
    f"select '{c}' as \"column\", round(avg({c}),4) mean, round(stddev_samp({c}),4) std, round(min({c}),4) \"min\", round(max({c}),4) \"max\" from lineitem"
    for c in "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()))
def _(s, d):
    return Q.numeric_profile(W.table(s, d, "lineitem"))


@query("b5_profile_headline", "n_rows n_features n_numeric n_categorical n_with_missing n_constant", f"""
 select max(n) n_rows, count(*) n_features, count(*) filter (share>=0.99 and d>1) n_numeric, count(*) filter (not share>=0.99 and d>1) n_categorical,
  count(*) filter (m>0) n_with_missing, count(*) filter (d<=1) n_constant
 from ({_each('count(*) n, count(*)-count(@) m, count(distinct @)+max(cast(@ is null as int)) d, coalesce(count(try_cast(@ as double))/nullif(count(@),0),0) share')})""")
def _(s, d):
    return Q.profile_headline(joined(s, d))


@query("b6_missing_rate", "column:s missing_rate:d", _each("avg(cast(@ is null as int)) missing_rate"))
def _(s, d):
    return Q.missing_rate(joined(s, d))


@query("b8_ordinal_encode", "sample_id column:s code", """
 with t as (select d.doc_id sample_id, lang, source, coalesce(quality,2)<>0 fit from documents d left join labels l on l.doc_id=d.doc_id),
 u as (select sample_id, 'lang' as "column", lang v, fit from t union all select sample_id, 'source', source, fit from t),
 st as (select "column", v, row_number() over (partition by "column" order by v)-1 code from (select distinct "column", v from u where fit))
 select sample_id, u."column", coalesce(code,-1) code from u left join st on st."column"=u."column" and st.v=u.v""")
def _(s, d):
    t = W.table(s, d, "documents").join(W.table(s, d, "labels"), "doc_id", "left")
    t = t.select(F.col("doc_id").alias("sample_id"), "lang", "source", (F.coalesce("quality", F.lit(2)) != 0).alias("fit"))
    return Q.ordinal_encode(t, Q.ordinal_state(t.filter("fit"), ["lang", "source"]), ["lang", "source"])


@query("b9_ordinal_wt_zero", "sample_id gene:s code", """
 with c as (select sample_id, gene, coalesce(cell,'__MISSING__') v from cells),
 r as (select gene, v, row_number() over (partition by gene order by v) code from (select gene, v from c union select gene, 'WT' from c))
 select sample_id, c.gene, r.code-w.code code from c join r on r.gene=c.gene and r.v=c.v join r w on w.gene=c.gene and w.v='WT'""")
def _(s, d):
    return Q.ordinal_wt_zero(W.cells(s, d))


def _psi_sql(keys: str, src: str) -> str:
    """PSI with ten reference quantile bins; ``src`` gives keys, x, is_ref."""
    k = f"{keys}," if keys else ""
    on = f"using ({keys})" if keys else "on true"
    by = f"group by {keys}" if keys else ""
    return f"""with d as ({src}),
 q as (select {k} list_distinct(quantile_cont(x,[0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1])) u from d where is_ref {by}),
 e as (select {k} case when len(u)=1 then [u[1]-greatest(abs(u[1])*1e-6,1e-6),u[1]+greatest(abs(u[1])*1e-6,1e-6)]
   when len(u)=2 then [(u[1]+u[2])/2] else list_sort(u)[2:-2] end e from q),
 b as (select {k} is_ref, len(list_filter(e, lambda z: z<=x)) bin, len(e)+1 nb from d join e {on}),
 a as (select {k} nb, unnest(range(nb)) bin from (select distinct {k} nb from b)),
 c as (select {k} nb, bin, count(*) filter (is_ref) r, count(*) filter (not is_ref) v from b group by {k} nb, bin),
 f as (select {', '.join('a.'+x.strip() for x in keys.split(',') if x.strip())}{',' if keys else ''} a.nb, coalesce(r,0) r, coalesce(v,0) v from a left join c using ({k} nb, bin)),
 s as (select *, (r+1e-6)/(sum(r) over w + 1e-6*nb) pr, (v+1e-6)/(sum(v) over w + 1e-6*nb) pv from f window w as ({'partition by '+keys if keys else ''}))
 select {k} sum((pv-pr)*ln(pv/pr)) psi from s {by}"""


@query("b10_psi", "psi:d", _psi_sql("", "select l_extendedprice x, l_linestatus='F' is_ref from lineitem"))
def _(s, d):
    t = W.table(s, d, "lineitem")
    return Q.psi(t.filter("l_linestatus = 'F'"), t.filter("l_linestatus <> 'F'"), "l_extendedprice")


@query("b11_fold_psi", "fold feature:s psi:d", _psi_sql("fold, feature", """
 select k fold, feature, x, f.fold<>k is_ref from (
  select c_custkey sample_id, 'acctbal' feature, c_acctbal x from customer
  union all select o_custkey, 'totalprice', o_totalprice from orders
  union all select o_custkey, 'status', ascii(o_orderstatus) from orders) join folds f using (sample_id) cross join (select unnest(range(5)) k)"""))
def _(s, d):
    o = W.table(s, d, "orders").withColumnRenamed("o_custkey", "sample_id")
    rows = W.table(s, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.lit("acctbal").alias("feature"), F.col("c_acctbal").alias("value"))
    rows = rows.unionByName(o.select("sample_id", F.lit("totalprice").alias("feature"), F.col("o_totalprice").alias("value")))
    rows = rows.unionByName(o.select("sample_id", F.lit("status").alias("feature"), F.ascii("o_orderstatus").cast("double").alias("value")))
    return Q.fold_psi(rows, W.labelled(s, d), 5)


# --- J: folds ------------------------------------------------------------------------
@query("j1_stratified_folds", "sample_id label:s seed fold", "select sample_id, label, seed, fold from folds3 where seed=42")
def _(s, d):
    return W.folds(s, d)


_PROF = f"""select s.sample_id, label, coalesce(key,'ALL_WT') profile from samples s left join ({digest('gene,token', 'ev', 'sample_id')}) using (sample_id)"""
# documents grouped by their exact text, stratified by language
_DOCG = "select doc_id sample_id, lang label, sha256(text) profile from documents"
_GF = f"""with j as ({_DOCG}), n as (select profile, label, count(*) n from j group by 1,2),
 o as (select profile, first(label order by n desc, label) st, sum(n) size from n group by 1),
 r as (select profile, (row_number() over (partition by st order by size desc, md5(concat(profile,'|42')))-1)%5 fold from o)
 select sample_id, label, profile, fold from j join r using (profile)"""


def doc_groups(s, d):
    t = W.table(s, d, "documents")
    smp = t.select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("label"))
    return smp, t.select(F.col("doc_id").alias("sample_id"), F.sha2("text", 256).alias("profile"))


@query("j2_group_folds", "sample_id label:s profile:s fold", _GF)
def _(s, d):
    smp, g = doc_groups(s, d)
    return J.group_folds(smp, g, 5, 42)


# Dealing is a loop; tested against one that deals group by group.
@query("j2_balanced_group_folds", "sample_id label:s profile:s fold")
def _(s, d):
    smp, g = doc_groups(s, d)
    return J.balanced_group_folds(smp, g, 5, 42)


@query("j3_holdout", "sample_id label:s held", """
 select sample_id, label, cast(row_number() over (partition by label order by md5(concat(sample_id,'|7'))) <= 0.2*count(*) over (partition by label) as int) held from samples""")
def _(s, d):
    return J.holdout(W.samples(s, d), 0.2, 7)


_BUR = "select s.sample_id, label, count(p.gene) burden from samples s left join pres p using (sample_id) group by 1,2"


@query("j4_strata", "sample_id label:s burden_bin:s stratum:s", f"""
 with b as (select *, case when burden<=5 then '0-5' when burden<=9 then '6-9' when burden<=16 then '10-16' when burden<=33 then '17-33' else '34+' end burden_bin from ({_BUR})),
 c as (select label, min(n) m from (select label, burden_bin, count(*) n from b group by 1,2) group by 1)
 select sample_id, label, burden_bin, case when m<5 then 'CLASS_ONLY='||label else 'CLASS='||label||'|BURDEN='||burden_bin end stratum from b join c using (label)""")
def _(s, d):
    smp = W.samples(s, d)
    return J.strata(smp, Y.burden(W.events(s, d), smp, 150), 5)


@query("j5_fold_audit", "fold train_size valid_size train_groups valid_groups group_overlap", f"""
 with f as ({_GF}), g as (select distinct fold, profile from f), n as (select profile, count(*) nf from g group by 1)
 select k fold, (select count(*) from f where fold<>k) train_size, (select count(*) from f where fold=k) valid_size,
  (select count(distinct profile) from f where fold<>k) train_groups, (select count(*) from g where fold=k) valid_groups,
  (select count(*) from g join n using (profile) where fold=k and nf>1) group_overlap from (select unnest(range(5)) k)""")
def _(s, d):
    smp, g = doc_groups(s, d)
    return J.fold_audit(J.group_folds(smp, g, 5, 42), g)


@query("j5_class_gap", "label:s n gap:d", f"""
 with f as (select label, fold, count(*) n from ({_GF}) group by 1,2)
 select label, sum(n) n, (max(n)-case when count(*)<5 then 0 else min(n) end)/cast(sum(n) as double) gap from f group by 1""")
def _(s, d):
    smp, g = doc_groups(s, d)
    return J.class_gap(J.group_folds(smp, g, 5, 42), 5)


# The same dealing loop; beside j5_class_gap.
@query("j5_balanced_class_gap", "label:s n gap:d")
def _(s, d):
    smp, g = doc_groups(s, d)
    return J.class_gap(J.balanced_group_folds(smp, g, 5, 42), 5)


@query("j5_fold_audit_rows", "fold train_size valid_size train_groups valid_groups group_overlap", """
 with f as (select doc_id, sha256(text) profile, (row_number() over (partition by lang order by md5(concat(doc_id,'|42')))-1)%5 fold from documents),
 g as (select distinct fold, profile from f), n as (select profile, count(*) nf from g group by 1)
 select k fold, (select count(*) from f where fold<>k) train_size, (select count(*) from f where fold=k) valid_size,
  (select count(distinct profile) from f where fold<>k) train_groups, (select count(*) from g where fold=k) valid_groups,
  (select count(*) from g join n using (profile) where fold=k and nf>1) group_overlap from (select unnest(range(5)) k)""")
def _(s, d):
    smp, g = doc_groups(s, d)
    return J.fold_audit(J.stratified_folds(smp, 5, 42), g)


@query("j6_nested_folds", "sample_id label:s outer_fold inner_fold", """
 select sample_id, label, o outer_fold, (row_number() over (partition by o, label order by md5(concat(sample_id,'|',42*1009+o*9173)))-1)%4 inner_fold
 from folds cross join (select unnest(range(5)) o) where fold<>o""")
def _(s, d):
    return J.nested_folds(W.labelled(s, d), 5, 4, 42)


@query("j7_holdout_across_seeds", "sample_id seed fold role:s", """
 select sample_id, seed, fold, case when sample_id in (select sample_id from folds3 where seed=43 and fold=2) then 'held' else 'selection' end role
 from folds3 where seed=43 or sample_id not in (select sample_id from folds3 where seed=43 and fold=2)""")
def _(s, d):
    return J.holdout_across_seeds(W.folds(s, d, W.SEEDS), 43, 2)


# --- H: patterns ------------------------------------------------------------------------
@query("h1_pattern_key", "sample_id label:s key:s", f"""
 select s.sample_id, label, coalesce(key,'ALL_WT') key from samples s left join
 ({digest('gene,cell', '(select sample_id, gene, upper(cell) cell from cells where cell is not null)', 'sample_id')}) using (sample_id)""")
def _(s, d):
    return P.pattern_key(W.cells(s, d), W.samples(s, d))


@query("h2_profile_group", "sample_id label:s profile:s", _PROF)
def _(s, d):
    return P.profile_group(W.events(s, d), W.samples(s, d))


_KEYS = "select doc_id sample_id, sha256(text) key, lang label from documents"


def doc_keys(s, d):
    return W.table(s, d, "documents").select(F.col("doc_id").alias("sample_id"), F.sha2("text", 256).alias("key"), F.col("lang").alias("label"))


@query("h3_pattern_support", "sample_id key:s support_log1p:d seen_multiple", f"""
 select sample_id, key, ln(1+n) support_log1p, cast(n>=2 as int) seen_multiple from ({_KEYS}) join (select key, count(*) n from ({_KEYS}) group by 1) using (key)""")
def _(s, d):
    return P.pattern_support(doc_keys(s, d))


# A coarser key (length bucket) so that groups have several labels.
_LK = "select doc_id sample_id, cast(floor(n_chars/100e0) as bigint) key, lang label, (doc_id*7+n_chars)%5 fold from documents"


def length_keys(s, d):
    return W.table(s, d, "documents").select(
        F.col("doc_id").alias("sample_id"), F.floor(F.col("n_chars") / 100).alias("key"), F.col("lang").alias("label"),
        ((F.col("doc_id") * 7 + F.col("n_chars")) % 5).alias("fold"))


@query("h4_pattern_uncertainty", "key support_log1p:d entropy:d max_probability:d conflict", f"""
 select key, ln(1+sum(n)) support_log1p, -sum(p*ln(p))/ln((select count(distinct label) from ({_LK}))) entropy, max(p) max_probability, cast(count(*)>1 as int) conflict
 from (select key, n, n/sum(n) over (partition by key) p from (select key, label, count(*) n from ({_LK}) group by 1,2)) group by 1""")
def _(s, d):
    return P.pattern_uncertainty(length_keys(s, d).drop("fold"))


@query("h5_pattern_uncertainty_oof", "sample_id fold support_log1p:d entropy:d max_probability:d conflict", f"""
 with k as ({_LK}), c as (select t.f, key, label, count(*) n from k cross join (select unnest(range(5)) f) t where k.fold<>t.f group by 1,2,3),
 u as (select f, key, ln(1+sum(n)) s, -sum(p*ln(p))/ln((select count(distinct label) from k)) e, max(p) m, cast(count(*)>1 as int) conflict from
  (select *, n/sum(n) over (partition by f, key) p from c) group by 1,2)
 select sample_id, fold, coalesce(s,0) support_log1p, coalesce(e,0) entropy, coalesce(m,0) max_probability, coalesce(conflict,0) conflict
 from k left join u on u.f=k.fold and u.key=k.key""")
def _(s, d):
    k = length_keys(s, d)
    return P.pattern_uncertainty_oof(k.drop("fold"), k.select("sample_id", "fold"))


_POST = f"""select key, l.label, n, (coalesce(c,0)+1.5e0*pr)/(n+1.5e0) posterior from (select key, count(*) n from ({_LK}) group by 1 having count(*)>=2)
 cross join (select label, count(*)/(select count(*) from ({_LK})) pr from ({_LK}) group by 1) l
 left join (select key, label, count(*) c from ({_LK}) group by 1,2) using (key, label)"""


@query("h6_pattern_posterior", "key label:s n posterior:d", _POST)
def _(s, d):
    return P.pattern_posterior(length_keys(s, d), 1.5)


@query("h7_posterior_blend", "sample_id label:s p:d", f"""
 with k as ({_LK}), p as (select sample_id, key, l.label, case when k.label=l.label then 0.4e0 else 0.6e0/((select count(distinct label) from k)-1) end p
  from k cross join (select distinct label from k) l)
 select sample_id, label, case when posterior is null then p else 0.7e0*p+0.3e0*posterior end p from p left join ({_POST}) using (key, label)""")
def _(s, d):
    k = length_keys(s, d)
    labels = k.agg(F.collect_set("label").alias("v")).scalar()
    own = F.col("label") == F.col("own")
    proba = k.withColumn("v", labels).select("sample_id", F.col("label").alias("own"), F.size("v").alias("c"), F.explode("v").alias("label"))
    proba = proba.select("sample_id", "label", F.when(own, 0.4).otherwise(0.6 / (F.col("c") - 1)).alias("p"))
    return P.posterior_blend(proba, k, P.pattern_posterior(k, 1.5), 0.3)


_TR = ", ".join(f"case when fold<>{i} then avg(cast(tot-coalesce(h{i},0)<=1 as int)) end t{i}" for i in range(5))
_NOV = f"""with j as (select * from ev join folds using (sample_id)),
 t as (select gene, token, count(*) tot, {", ".join(f"count(*) filter (fold={i}) h{i}" for i in range(5))} from j group by 1,2),
 g as (select sample_id, fold, avg(cast(tot-(case fold when 0 then h0 when 1 then h1 when 2 then h2 when 3 then h3 else h4 end)=0 as int)) v, {_TR}
  from j join t using (gene, token) group by 1,2)
 select f.sample_id, f.fold, coalesce(v,0) valid, {", ".join(f"case when f.fold<>{i} then coalesce(t{i},0) end train_{i}" for i in range(5))}
 from folds f left join g using (sample_id)"""


@query("h8_novelty", "sample_id fold valid:d " + " ".join(f"train_{i}:d" for i in range(5)), _NOV)
def _(s, d):
    return P.novelty(W.events(s, d), W.labelled(s, d), 5)


@query("h9_pattern_summary", "matched_groups conflicting_groups matched_samples", f"""
 select count(*) matched_groups, count(*) filter (l>1) conflicting_groups, sum(n) matched_samples from (select key, count(*) n, count(distinct label) l from ({_LK}) group by 1 having count(*)>=2)""")
def _(s, d):
    return P.pattern_summary(length_keys(s, d))
