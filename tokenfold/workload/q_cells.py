"""Cell and token queries (scalar dialect rules, unpivot, event build)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenfold.functions import cells as C
from tokenfold.operators import events as E
from tokenfold.workload import query
from tokenfold.workload import views as W

_TOKENS = "select distinct gene, tok from toks"
AA = W.AA
BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def tokens(s, d):
    t = W.cells(s, d).filter(F.col("cell").isNotNull())
    return t.select("gene", F.explode(C.raw_tokens(F.col("cell"))).alias("tok")).distinct()


@query("c1_norm_cell", "sample_id gene:s em:s v47:s jh:s jyp:s", """
 select sample_id, gene, upper(coalesce(cell,'WT')) em, upper(coalesce(cell,'WT')) v47, upper(coalesce(cell,'WT')) jh,
  upper(coalesce(cell,'MISSING')) jyp from cells""")
def _(s, d):
    return W.cells(s, d).select("sample_id", "gene", *[
        C.norm_cell(F.col("cell"), p).alias(p) for p in ("em", "v47", "jh", "jyp")])


def wide(s, d):
    """One row per customer, one string column per brand (null where nothing was bought)."""
    line = W.table(s, d, "lineitem").select("l_orderkey", "l_partkey")
    part = W.table(s, d, "part").select("p_partkey", "p_brand", "p_size")
    orders = W.table(s, d, "orders").select("o_orderkey", "o_custkey")
    j = line.join(part, line.l_partkey == part.p_partkey).join(orders, line.l_orderkey == orders.o_orderkey)
    size = lambda b: F.max(F.when(F.col("p_brand") == b, F.col("p_size")))
    cell = lambda c: F.when(c > 25, F.concat(F.lit(" r"), c.cast("string"), F.lit("h"))).otherwise("wt")
    g = j.groupBy(F.col("o_custkey").alias("sample_id")).agg(*[size(b).alias(b) for b in BRANDS])
    return g.select("sample_id", *[F.when(F.col(f"`{b}`").isNotNull(), cell(F.col(f"`{b}`"))).alias(b) for b in BRANDS])


_WIDE = """select o_custkey sample_id, p_brand gene, max(p_size) m
 from lineitem join part on l_partkey=p_partkey join orders on l_orderkey=o_orderkey group by 1,2"""


@query("c2_to_cells", "sample_id gene:s cell:s", f"""
 select sample_id, gene, concat(' r',m,'h') cell from ({_WIDE}) where m>25""")
def _(s, d):
    return E.to_cells(wide(s, d))


@query("c2_to_cells_with_missing", "sample_id gene:s cell:s", f"""
 select c.sample_id, b.gene, case when m>25 then concat(' r',m,'h') end cell
 from (select distinct sample_id from ({_WIDE})) c cross join (select concat('Brand#',unnest(range(1,26))) gene) b
 left join ({_WIDE}) w on w.sample_id=c.sample_id and w.gene=b.gene where m is null or m>25""")
def _(s, d):
    return E.to_cells(wide(s, d), keep_null=True)


@query("c3_split_tokens", "sample_id gene:s token:s", "select sample_id, gene, token from ev")
def _(s, d):
    return W.events(s, d).select("sample_id", "gene", "token")


@query("c4_norm_token_jh", "gene:s tok:s token:s", rf"""
 select gene, tok, regexp_replace(regexp_replace(upper(tok),'^P\.',''),'^([A-Z])([0-9]+)X$','\1\2*') token from ({_TOKENS})""")
def _(s, d):
    return tokens(s, d).withColumn("token", C.norm_token_jh(F.col("tok")))


@query("c5_norm_token_jyp", "gene:s tok:s token:s", rf"""
 select gene, tok, replace(replace(replace(replace(regexp_replace(upper(tok),'^([{AA}X])([0-9]+)X$','\1\2*'),
  'DEL','del'),'INS','ins'),'DUP','dup'),'FS','fs') token from ({_TOKENS})""")
def _(s, d):
    return tokens(s, d).withColumn("token", C.norm_token_jyp(F.col("tok")))


@query("c6_norm_token_jsj", "gene:s tok:s token:s", f"""
 select gene, tok, case when regexp_matches(lower(t),'splice|ext|dup') then 'WT'
  when t like '%=%' then replace(t,'=',substr(t,1,1)) else t end token
 from (select *, regexp_replace(tok,'^p\\.','') t from ({_TOKENS}))""")
def _(s, d):
    return tokens(s, d).withColumn("token", C.norm_token_jsj(F.col("tok")))


@query("c7_cell_severity", "sample_id gene:s severity", r"""
 select sample_id, gene, case when regexp_matches(u,'FS|\*|TER') then 4 when regexp_matches(u,'DEL|INS|DUP|>') then 3
  when regexp_extract(u,'^([A-Z])[0-9]+([A-Z])$',1)<>'' and regexp_extract(u,'^([A-Z])[0-9]+([A-Z])$',1)=regexp_extract(u,'^([A-Z])[0-9]+([A-Z])$',2) then 1
  when u<>'WT' then 2 else 0 end severity from (select *, upper(coalesce(cell,'WT')) u from cells)""")
def _(s, d):
    return W.cells(s, d).select("sample_id", "gene", C.cell_severity(F.col("cell")).alias("severity"))


@query("c8_consequence4", "sample_id gene:s token:s conseq", "select * from ev4")
def _(s, d):
    return W.events(s, d, "em4")


@query("c9_consequence5", "sample_id gene:s token:s conseq", "select * from ev")
def _(s, d):
    return W.events(s, d, "em5")


@query("c10_parse_event_jh", "sample_id gene:s token:s consequence:s position aa_from:s aa_to:s",
       "select sample_id, gene, token, consequence, position, aa_from, aa_to from jh")
def _(s, d):
    return W.events(s, d, "jh")


@query("c11_parse_event_jyp", "sample_id gene:s token:s consequence:s",
       "select sample_id, gene, token, consequence from jy")
def _(s, d):
    return W.events(s, d, "jyp")


@query("c12_event_type_jsj1", "event_type:s n", "select event_type, count(*) n from js1 group by 1")
def _(s, d):
    return W.events(s, d, "jsj1").groupBy("event_type").agg(F.count("*").alias("n"))


@query("c12_event_type_jsj2", "sample_id gene:s token:s event_type:s",
       "select sample_id, gene, token, event_type from js2")
def _(s, d):
    return W.events(s, d, "jsj2")


@query("c13_kind_jsj", "sample_id gene:s token:s kind:s", "select sample_id, gene, token, kind from js3")
def _(s, d):
    return W.events(s, d, "jsj3")


@query("c14_flags_f", "sample_id gene:s token:s kind:s truncating missense splice",
       "select sample_id, gene, token, kind, truncating, missense, splice from evf")
def _(s, d):
    return W.events(s, d, "f")


@query("c15_protein_position", "sample_id gene:s token:s position", "select sample_id, gene, token, position from jy")
def _(s, d):
    return W.events(s, d, "jyp")


@query("c16_position_bin", "scheme:s position_bin:s n", """
 select 'jyp' scheme, case when position<=50 then 'pos_1_50' when position<=100 then 'pos_51_100' when position<=250 then 'pos_101_250'
  when position<=500 then 'pos_251_500' when position<=1000 then 'pos_501_1000' else 'pos_gt_1000' end position_bin, count(*) n
  from jy where position>=1 group by 1,2
 union all select 'jh', case when position<=50 then '1-50' when position<=100 then '51-100' when position<=200 then '101-200'
  when position<=400 then '201-400' when position<=800 then '401-800' else '801+' end, count(*) from jy where position is not null group by 1,2
 union all select 'jsj', case when position<=50 then '001_050' when position<=100 then '051_100' when position<=250 then '101_250'
  when position<=500 then '251_500' else '501_PLUS' end, count(*) from jy where position is not null group by 1,2""")
def _(s, d):
    e = W.events(s, d, "jyp")
    bins = F.explode(F.array(*[
        F.struct(F.lit(x).alias("scheme"), C.position_bin(F.col("position"), x).alias("position_bin"))
        for x in ("jyp", "jh", "jsj")]))
    return (e.select(bins.alias("b")).select("b.*").filter("position_bin is not null")
            .groupBy("scheme", "position_bin").agg(F.count("*").alias("n")))


@query("c17_aa_transition", "sample_id gene:s token:s transition:s",
       "select sample_id, gene, token, transition from jy where transition is not null")
def _(s, d):
    return W.events(s, d, "jyp").filter("transition is not null")


@query("c18_cell_state", "state:s n", """
 select case when cell is null then 'MISSING' else 'MUTATED' end state, count(*) n from cells group by 1""")
def _(s, d):
    return W.cells(s, d).groupBy(C.cell_state(F.col("cell")).alias("state")).agg(F.count("*").alias("n"))


@query("c19_missing_genes", "sample_id gene:s", "select * from missing")
def _(s, d):
    return E.missing_genes(W.cells(s, d))


@query("c20_cell_code", "sample_id gene:s code", "select * from codes")
def _(s, d):
    return E.cell_code(W.events(s, d, "jsj3"))


@query("c20_cell_code_v2", "sample_id gene:s code", """
 select sample_id, gene, case when c=0 and o>0 then -1 else c end code from (
 select sample_id, gene, least(9,count(*) filter (event_type in ('FS','DEL','INS','DELINS')))*1000+least(9,count(*) filter (event_type='STOP'))*100
  +least(9,count(*) filter (event_type='SUB'))*10+least(9,count(*) filter (event_type='SYN')) c, count(*) filter (event_type='OTHER') o
 from js2 group by 1,2)""")
def _(s, d):
    return E.cell_code(W.events(s, d, "jsj2"), 2)


@query("c21_functional_flag", "doc_id functional", """
 select doc_id, cast(not regexp_matches(lower(text),'synonymous|silent|intron') as int) functional from documents""")
def _(s, d):
    return W.table(s, d, "documents").select("doc_id", C.functional_flag(F.col("text")).cast("int").alias("functional"))


@query("c22_build_events", "sample_id n_jh n_jyp n_jsj", """
 select coalesce(a.sample_id,b.sample_id,c.sample_id) sample_id, a.n n_jh, b.n n_jyp, c.n n_jsj
 from (select sample_id, count(*) n from jh group by 1) a full join (select sample_id, count(*) n from jy group by 1) b using (sample_id)
 full join (select sample_id, count(*) n from js2 group by 1) c using (sample_id)""")
def _(s, d):
    out = None
    for name, dialect in (("n_jh", "jh"), ("n_jyp", "jyp"), ("n_jsj", "jsj2")):
        n = W.events(s, d, dialect).groupBy("sample_id").agg(F.count("*").alias(name))
        out = n if out is None else out.join(n, "sample_id", "full")
    return out
