"""Feature selection, redundancy, text vectors and latent factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenfold.functions import stats as S
from tokenfold.operators import genes as G
from tokenfold.operators import latent as L
from tokenfold.operators import selection as X
from tokenfold.operators import summaries as Y
from tokenfold.operators import text as T
from tokenfold.session import keep
from tokenfold.workload import query
from tokenfold.workload import views as W

K = W.K
VIEWS = {
    "feat": "select sample_id, gene feature, n*1e0 as value from gn",
    "dense": """select s.sample_id, label, fold, f.feature, coalesce(x.value,0) as value from folds s cross join (select distinct feature from feat) f
  left join feat x on x.sample_id=s.sample_id and x.feature=f.feature""",
    # ANOVA F without fold k (-1: all rows)
    "anova": """select k, feature, case when sst-ssb>1e-9 then (ssb/(c-1))/((sst-ssb)/(n-c)) else 0 end f, support, n, var from (
  select k, feature, sum(s*s/m)-sum(s)*sum(s)/sum(m) ssb, sum(q)-sum(s)*sum(s)/sum(m) sst, count(*) c, sum(m) n, sum(z) support, sum(q)/sum(m)-pow(sum(s)/sum(m),2) var
  from (select k, feature, label, sum(value) s, sum(value*value) q, count(*)*1e0 m, count(*) filter (value<>0) z from dense cross join (select unnest(range(-1,5)) k) where fold<>k group by 1,2,3) group by 1,2)""",
    "prio": """select feature, f, support, stability, row_number() over (order by round(f,9) desc, stability desc, support desc,
   case when regexp_matches(upper(feature),'HOTSPOT|CONSEQUENCE') then 4 else 1 end desc, length(feature), feature) rank
  from (select feature, f, support from anova where k=-1) left join (select feature, count(*)/5 stability from (
   select *, row_number() over (partition by k order by round(f,9) desc, feature) r, ceil(0.2*count(*) over (partition by k)) top from anova where k>=0) where r<=top group by 1) using (feature)""",
    "pairs": """select a.feature a, b.feature b, corr(a.value,b.value) r from dense a join dense b on a.sample_id=b.sample_id and a.feature<b.feature group by 1,2""",
}
W.SQL.update(VIEWS)


def feat(s, d):
    return G.gene_event_count(W.events(s, d)).select("sample_id", F.col("gene").alias("feature"), F.col("n_events").cast("double").alias("value"))


def presence(s, d):
    """Cached: the operators on pairs of genes read it for the supports, the products and the representatives."""
    return keep(G.gene_presence(W.events(s, d)))


@query("i1_active_filter", "feature:s active", "select feature, count(*) active from feat where abs(value)>1 group by 1 having count(*)>=60")
def _(s, d):
    return X.active_filter(feat(s, d), 60, 1.0)


@query("i2_chi2_select", "feature:s chi2:d rank", """
 select *, row_number() over (order by round(chi2,9) desc, feature) rank from (select feature, sum((o-e)*(o-e)/e) chi2 from (
  select feature, label, sum(value) o, sum(sum(value)) over (partition by feature)*count(*)/sum(count(*)) over (partition by feature) e from dense group by 1,2) group by 1) order by rank limit 40""")
def _(s, d):
    return X.chi2_select(feat(s, d), W.samples(s, d), 40)


@query("i3_mi_select", "feature:s mi:d rank", """
 select *, row_number() over (order by round(mi,9) desc, feature) rank from (select feature, sum(n/t*ln(n*t/(nv*nc))) mi from (
  select feature, value, label, count(*)*1e0 n, sum(count(*)) over (partition by feature, value) nv, sum(count(*)) over (partition by feature, label) nc,
   sum(count(*)) over (partition by feature) t from dense group by 1,2,3) group by 1) order by rank limit 40""")
def _(s, d):
    return X.mi_select(feat(s, d), W.samples(s, d), 40)


_CONT = """select c_custkey sample_id, c_mktsegment label, 'acctbal' feature, cast(c_acctbal as double) as value from customer
 union all select c_custkey, c_mktsegment, 'largest', cast(max(o_totalprice) as double) from customer join orders on o_custkey=c_custkey group by 1,2
 union all select c_custkey, c_mktsegment, 'orders', count(*) from customer join orders on o_custkey=c_custkey group by 1,2"""


@query("i3_neighbour_information", "feature:s n mi:d", f"""
 with d as materialized (select * from (select *, count(*) over (partition by feature, label) nl from ({_CONT})) where nl>1),
 q as (select a.feature, a.sample_id, a.value as v, a.nl, abs(a.value-b.value) t, row_number() over (partition by a.feature, a.sample_id order by abs(a.value-b.value)) r
  from d a join d b on a.feature=b.feature and a.label=b.label and a.sample_id<>b.sample_id),
 rad as materialized (select feature, sample_id, v, nl, max(t) r, count(*) k from q where r<=3 group by 1,2,3,4),
 m as materialized (select rad.feature, rad.sample_id, rad.nl, k, count(*) m from rad join d on d.feature=rad.feature and (d.value=v or (d.value>v-r and d.value<v+r)) group by 1,2,3,4),
 ps as materialized (select n, sum(1e0/n) over (order by n rows between unbounded preceding and 1 preceding) h from (select unnest(range(1, (select max(c)+2 from (select count(*) c from d group by feature)))) n)),
 psi as (select n, coalesce(h,0)-0.57721566490153286e0 p from ps)
 select feature, c n, greatest(0, t.p+x.pk-x.pl-x.pm) mi from (select feature, count(*) c, avg(a.p) pk, avg(b.p) pl, avg(e.p) pm from m join psi a on a.n=k join psi b on b.n=nl join psi e on e.n=m group by 1) x join psi t on t.n=c""")
def _(s, d):
    c = W.table(s, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("label"), "c_acctbal")
    o = W.table(s, d, "orders").groupBy(F.col("o_custkey").alias("sample_id")).agg(F.max("o_totalprice").cast("double").alias("largest"), F.count("*").cast("double").alias("orders"))
    long = o.unpivot(["sample_id"], ["largest", "orders"], "feature", "value").unionByName(
        c.select("sample_id", F.lit("acctbal").alias("feature"), F.col("c_acctbal").cast("double").alias("value")))
    return X.neighbour_information(long, c, 3)


@query("i4_anova_f", "feature:s f:d support", "select feature, f, support from anova where k=-1")
def _(s, d):
    return X.anova_f(feat(s, d), W.samples(s, d))


def stability(s, d):
    return X.anova_stability(feat(s, d), W.labelled(s, d), K)


@query("i5_anova_stability", "feature:s f:d support stability:d", "select feature, f, support, coalesce(stability,0) stability from prio")
def _(s, d):
    return stability(s, d)


@query("i6_stable_anova", "feature:s f:d frequency stable rank", """
 with el as (select feature, f from anova where k=-1 and support>=5 and support<=0.6*n and var>=1e-4),
 fr as (select feature, count(*) frequency from (select k, feature, row_number() over (partition by k order by round(anova.f,9) desc, feature) r from anova join el using (feature) where k>=0) where r<=45 group by 1)
 select feature, f, coalesce(frequency,0) frequency, cast(coalesce(frequency,0)>=3 as int) stable,
  row_number() over (order by cast(coalesce(frequency,0)>=3 as int) desc, coalesce(frequency,0) desc, round(f,9) desc, feature) rank
 from (select feature, el.f f from el) left join fr using (feature) order by rank limit 30""")
def _(s, d):
    return X.stable_anova(feat(s, d), W.labelled(s, d), K, 30, max_prevalence=0.6)


@query("i7_priority", "feature:s rank stability:d", "select feature, rank, coalesce(stability,0) stability from prio")
def _(s, d):
    return X.priority(stability(s, d))


# Duplicates: every document's text hash seen as a feature over its words is too fine; parts of one token
# are features over the customers that bought them, and two parts duplicate when the customers agree.
_DUP = "select distinct l_orderkey sample_id, concat('p',l_partkey%7,'_',l_linenumber) feature, 1 as value from lineitem union select distinct l_orderkey, concat('copy_',l_linenumber), 1 from lineitem union select distinct l_orderkey, concat('line_',l_linenumber), 1 from lineitem"


@query("i8_dedupe_features", "feature:s keep:s", f"""
 with f as ({_DUP}), k as (select feature, md5(string_agg(cast(sample_id as varchar),',' order by sample_id)) h from f group by 1)
 select feature, keep from k join (select h, min(feature) keep, count(*) n from k group by 1 having count(*)>1) using (h)""")
def _(s, d):
    t = W.table(s, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), "l_partkey", F.col("l_linenumber").cast("string").alias("n"))
    names = F.explode(F.array(F.concat(F.lit("p"), (F.col("l_partkey") % 7).cast("string"), F.lit("_"), "n"), F.concat(F.lit("copy_"), "n"), F.concat(F.lit("line_"), "n")))
    f = t.select("sample_id", names.alias("feature"), F.lit(1.0).alias("value")).distinct()
    ranks = f.select("feature").distinct().withColumn("rank", F.dense_rank().over(_by_name()))
    return X.dedupe_features(f, ranks)


def _by_name():
    from pyspark.sql import Window

    return Window.orderBy("feature")


THR = 0.08
_EDGE = f"(select x.rank i, y.rank j from pairs join prio x on x.feature=a join prio y on y.feature=b where abs(round(r,9))>={THR})"


@query("i9_corr_groups", "feature:s keep:s", f"""
 with recursive e as (select i, j from {_EDGE} union select j, i from {_EDGE}),
 reach(n, m) as (select distinct i, i from e union select reach.n, e.j from reach join e on e.i=reach.m),
 c as (select n, min(m) m from reach group by 1)
 select x.feature, y.feature keep from c join prio x on x.rank=c.n join prio y on y.rank=c.m""")
def _(s, d):
    return X.corr_groups(feat(s, d), W.samples(s, d), X.priority(stability(s, d)), THR)


@query("i10_corr_greedy", "feature:s", f"""
 with recursive e as materialized (select distinct least(i,j) i, greatest(i,j) j from {_EDGE}), n as (select max(j) m from e),
 g(r, kept) as (select cast(0 as bigint), cast([] as bigint[]) union all
  select r+1, case when len(list_intersect(kept, coalesce(prev, []))) > 0 then kept else list_append(kept, r+1) end
  from g join n on r<m left join (select j, list(i) prev from e group by 1) p on p.j=r+1)
 select feature from prio where rank<=(select m from n) and not list_contains((select kept from g order by r desc limit 1), rank)""")
def _(s, d):
    f = keep(feat(s, d))
    return X.corr_greedy(f, W.samples(s, d), X.priority(X.anova_stability(f, W.labelled(s, d), K)), THR)


def _phi(parts: str) -> str:
    """phi and Jaccard of all gene pairs without fold k."""
    return f"""(select *, (n*t-ta*tb)/sqrt(ta*tb*(n-ta)*(n-tb)) phi, t/(ta+tb-t) jaccard from (
  select k, a.gene a, b.gene b, count(*)*1e0 t, max(x.c)*1e0 ta, max(y.c)*1e0 tb, max(z.n)*1e0 n from (select p.*, fold from pres p join folds using (sample_id)) a join pres b on a.sample_id=b.sample_id and a.gene<b.gene
  cross join ({parts}) join (select k, gene, count(*) c from pres join folds using (sample_id) cross join ({parts}) where fold<>k group by 1,2) x using (k) join (select k, gene, count(*) c from pres join folds using (sample_id) cross join ({parts}) where fold<>k group by 1,2) y using (k)
  join (select k, count(*) n from folds cross join ({parts}) where fold<>k group by 1) z using (k) where fold<>k and x.gene=a.gene and y.gene=b.gene group by 1,2,3))"""


PHI, JAC = 0.02, 0.14


@query("i11_phi_jaccard", "a:s b:s both phi:d jaccard:d", f"""
 select a, b, t as "both", phi, jaccard from {_phi('select -1 k')} where round(phi,9)>={PHI} and round(jaccard,9)>={JAC}""")
def _(s, d):
    return X.phi_jaccard(presence(s, d), W.samples(s, d), PHI, JAC)


_STE = f"""(select f.a, f.b, n_folds from (select a, b from {_phi('select -1 k')} where round(phi,9)>={PHI} and round(jaccard,9)>={JAC}) f join
 (select a, b, count(*) n_folds from {_phi('select unnest(range(5)) k')} where round(phi,9)>={PHI} and round(jaccard,9)>={JAC} group by 1,2) g using (a, b) where n_folds>=4)"""


@query("i12_stable_edges", "a:s b:s n_folds", f"select * from {_STE}")
def _(s, d):
    return X.stable_edges(presence(s, d), W.labelled(s, d), K, PHI, JAC, 4)


@query("i13_components", "gene:s keep:s", f"""
 with recursive st as (select * from {_STE}), e as (select a i, b j, n_folds w from st union select b, a, n_folds from st),
 reach(n, m) as (select distinct i, i from e union select reach.n, e.j from reach join e on e.i=reach.m),
 c as (select n, min(m) m from reach group by 1), w as (select i n, sum(w) w from e group by 1), u as (select gene n, count(*) c from pres group by 1),
 r as (select c.n, m, row_number() over (partition by m order by w desc, u.c desc, c.n) rk from c join w using (n) join u using (n))
 select c.n gene, r.n keep from c join r on r.m=c.m and r.rk=1""")
def _(s, d):
    p = presence(s, d)
    f = W.labelled(s, d)
    return X.representatives(X.stable_edges(p, f, K, PHI, JAC, 4), p, f)


# A gene has three features, in this order of names: largest consequence, multi-hit, mutation count.
@query("i14_gene_corr_drop", "feature:s", """
 with c as (select sample_id, gene, max(conseq)*1e0 x1, cast(count(*)>=2 as int)*1e0 x2, count(*)*1e0 x3 from ev group by 1,2),
 g as (select gene, sum(x1) s1, sum(x2) s2, sum(x3) s3, sum(x1*x1) q11, sum(x2*x2) q22, sum(x3*x3) q33, sum(x1*x2) q12, sum(x1*x3) q13, sum(x2*x3) q23,
   (select count(*) from samples)*1e0 n from c group by 1),
 r as (select gene, s2>0 has2, round(abs((q12-s1*s2/n)/sqrt(nullif((q11-s1*s1/n)*(q22-s2*s2/n),0))),9) r12,
   round(abs((q13-s1*s3/n)/sqrt(nullif((q11-s1*s1/n)*(q33-s3*s3/n),0))),9) r13, round(abs((q23-s2*s3/n)/sqrt(nullif((q22-s2*s2/n)*(q33-s3*s3/n),0))),9) r23 from g),
 d as (select gene, has2 and coalesce(r12>=0.9,false) d2, coalesce(r13>=0.9,false) d13, has2 and coalesce(r23>=0.9,false) d23 from r)
 select gene||'_multi_hit' feature from d where d2
 union all select gene||'_mutation_count' from d where d13 or (d23 and not d2)""")
def _(s, d):
    g = keep(W.events(s, d).groupBy("sample_id", "gene").agg(F.count("*").alias("mutation_count"), F.max("conseq").alias("consequence_max"),
                                                            (F.count("*") >= 2).cast("int").alias("multi_hit")))
    f = S.unpivot(g, ["sample_id", "gene"], "kind").filter("value <> 0")
    f = f.select("sample_id", "gene", F.concat_ws("_", "gene", "kind").alias("feature"), "value")
    rank = F.row_number().over(_by_name())
    order = f.select("feature", "gene").distinct().withColumn("rank", rank)
    return X.gene_corr_drop(f.drop("gene"), W.samples(s, d), order, 0.9)


# --- text -----------------------------------------------------------------------------------
_TERMS = """(select sample_id, unnest(['G='||gene, 'GT='||gene||':'||event_type, 'E='||gene||':'||token, 'T='||event_type,
  case when wp is not null then 'AA='||gene||':'||lw||'>'||rw end, case when wp is not null then 'AAG='||lw||'>'||rw end,
  case when wp is not null then 'POS='||gene||':'||b end, case when wp is not null then 'POSG='||b end]) term from (select *, case when wp<=50 then '001_050' when wp<=100 then '051_100'
  when wp<=250 then '101_250' when wp<=500 then '251_500' else '501_PLUS' end b from js1))"""


@query("i15_document_terms", "sample_id term:s tf", f"""
 select sample_id, term, count(*) tf from {_TERMS} where term is not null group by 1,2
 union all select sample_id, 'NO_MUTATION', 1 from samples where sample_id not in (select sample_id from js1)""")
def _(s, d):
    return T.document_terms(W.cells(s, d), W.samples(s, d))


# Terms of a document stand by gene, then event, then kind; the sorted terms must agree, and their number.
@query("i15_mutation_document", "sample_id n_terms digest:s", f"""
 select s.sample_id, greatest(count(t.term),1) n_terms, md5(coalesce(string_agg(t.term, ' ' order by t.term), 'NO_MUTATION')) digest
 from samples s left join (select * from {_TERMS} where term is not null) t using (sample_id) group by 1""")
def _(s, d):
    words = F.split("text", " ")
    return T.mutation_document(W.cells(s, d), W.samples(s, d)).select(
        "sample_id", F.size(words).alias("n_terms"), F.md5(F.array_join(F.array_sort(words), " ")).alias("digest"))


def _tfidf(terms: str, n: str, min_df: int, top: int, weight: str = "1e0") -> str:
    return f"""with t as ({terms}), v as (select term, count(*) df from t group by 1 having count(*)>={min_df} order by sum(tf) desc, term limit {top}),
 x as (select id sample_id, term feature, (1+ln(tf))*(ln((1+({n}))/(1e0+df))+1) w from t join v using (term))
 select sample_id, feature, {weight}*w/sqrt(sum(w*w) over (partition by sample_id)) as value from x"""


_WORDS = r"(select doc_id id, list_filter(regexp_split_to_array(text,'\s+'), lambda x: x<>'') w from documents)"


@query("i16_word_tfidf", "sample_id feature:s value:d", _tfidf(f"""
 select id, term, count(*) tf from (select id, unnest(w) term from {_WORDS} union all
  select id, unnest(list_transform(range(1,len(w)), lambda i: w[i]||' '||w[i+1])) from {_WORDS}) group by 1,2""", "select count(*) from documents", 3, 400))
def _(s, d):
    return T.word_tfidf(W.table(s, d, "documents"), "doc_id", 2, 3, 400)


_WC = f"(select id, ' '||x||' ' x, count(*) c from (select id, unnest(list_transform(w, lambda z: lower(z))) x from {_WORDS}) group by 1,2)"


@query("i17_char_tfidf", "sample_id feature:s value:d", _tfidf("select id, term, sum(c) tf from (" + " union all ".join(
    f"select id, unnest(list_transform(range(1,cast(length(x) as int)-{n - 2}), lambda i: substr(x,i,{n}))) term, c from {_WC} where length(x)>={n}" for n in (3, 4, 5))
    + ") group by 1,2", "select count(*) from documents", 3, 300, "0.5e0"))
def _(s, d):
    return T.char_tfidf(W.table(s, d, "documents"), "doc_id", 3, 300)


@query("i18_token_tfidf", "sample_id feature:s value:d", """
 with t as (select sample_id, concat(gene,':',token) feature, fold from ev join folds using (sample_id)),
 v as (select feature, count(*) df from t where fold<>0 group by 1 having count(*)>=5),
 x as (select sample_id, feature, ln((1+(select count(*) from folds where fold<>0))/(1e0+df))+1 w from t join v using (feature))
 select sample_id, feature, w/sqrt(sum(w*w) over (partition by sample_id)) as value from x""")
def _(s, d):
    t = W.events(s, d).select("sample_id", F.concat_ws(":", "gene", "token").alias("feature"))
    return T.token_tfidf(t, W.labelled(s, d), 0, 5)


@query("i19_compress", "sample_id feature:s value:d")
def _(s, d):
    e = keep(W.events(s, d))
    t = G.gene_presence(e).select("sample_id", F.col("gene").alias("feature"))
    f1 = Y.burden(e, W.samples(s, d), 150).select("sample_id", "burden", "burden_log1p")
    return L.compress(t, f1, W.labelled(s, d), 0, 8)


@query("i20_svd", "feature:s variance:d ratio:d")
def _(s, d):
    f = keep(feat(s, d))
    return L.explained_variance(L.svd_apply(f, L.svd_state(f, 8)), f, W.samples(s, d))


@query("i21_nmf", "sample_id module value:d")
def _(s, d):
    return L.nmf(keep(feat(s, d)), 4)


_HOT = "(select gene, token from ev group by 1,2 having count(*)>=20 order by count(*) desc, gene, token limit 100)"


@query("i22_genes_burden_hotspot", "sample_id feature:s value:d", f"""
 select sample_id, 'gene__'||gene feature, 1 as value from pres
 union all select sample_id, 'summary__burden', count(p.gene) from samples left join pres p using (sample_id) group by 1
 union all select sample_id, 'summary__burden_log1p', ln(1+count(p.gene)) from samples left join pres p using (sample_id) group by 1
 union all select sample_id, 'summary__burden_rate', count(p.gene)/(select count(distinct gene) from ev) from samples left join pres p using (sample_id) group by 1
 union all select sample_id, 'hotspot__'||gene||':'||token, 1 from ev join {_HOT} using (gene, token)
 union all select sample_id, 'hotspots__hotspot_mutation_count', count(h.token) from samples left join (select sample_id, token from ev join {_HOT} using (gene, token)) h using (sample_id) group by 1""")
def _(s, d):
    return L.genes_burden_hotspot(W.events(s, d), W.samples(s, d), 20, 100)
