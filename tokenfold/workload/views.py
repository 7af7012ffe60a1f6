"""Views that Spark (functions) and the oracle (SQL) derive from the driver tables.

A sample is a customer, its label the market segment. A gene is a part brand
with its size band, a token a protein-change string written from the part key.
A cell joins the distinct tokens of one (sample, gene); a cell with an untaxed
line is a missing one (null).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenfold.functions import stats
from tokenfold.operators import events as E
from tokenfold.operators import folds as J
from tokenfold.session import keep

AA = "ACDEFGHIKLMNPQRSTVWY"
SEEDS = [42, 43, 44]
CLASSES = 5
MODELS = 3
K = 5

# Both engines read this text.
TOKEN = f"""
 case cast(floor(p_partkey/7e0) as bigint)%12
  when 0 then concat(r,pos,'fs') when 1 then concat(r,pos,'*')
  when 2 then concat(r,pos,'_',a,pos+3,'del') when 3 then concat(r,pos,r)
  when 4 then concat('p.',r,pos,a) when 5 then concat(r,pos,'X')
  when 6 then concat(r,pos,'=') when 7 then concat('splice',pos)
  when 8 then concat(r,pos,'delins',a) when 9 then concat(r,pos,'dup')
  else concat(r,pos,a) end"""
PART = f"""
 select p_partkey, concat(p_brand,'.',cast(cast(floor(p_size/10e0) as int) as string)) gene,
  substr('{AA}',cast(1+p_partkey%20 as int),1) r, cast(1+(p_partkey*37)%1200 as int) pos,
  substr('{AA}',1+cast((1+floor(p_partkey/20e0))%20 as int),1) a from part"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def parts(spark: SparkSession, d: str) -> DataFrame:
    """(p_partkey, gene, token) dictionary of the token fixture."""
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    p = p.select(
        "p_partkey", F.concat("p_brand", F.lit("."), F.floor(F.col("p_size") / 10).cast("string")).alias("gene"),
        F.substring(F.lit(AA), (1 + key % 20).cast("int"), F.lit(1)).alias("r"), (1 + (key * 37) % 1200).alias("pos"),
        F.substring(F.lit(AA), 1 + ((1 + F.floor(key / 20)) % 20).cast("int"), F.lit(1)).alias("a"))
    return p.select("p_partkey", "gene", F.expr(TOKEN).alias("token"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """One text per (customer, gene).

    Lines are reduced to (customer, part) on their integer keys before any text
    is joined; a cell then holds at most its gene's vocabulary.
    """
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_tax")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    one = line.join(orders, line.l_orderkey == orders.o_orderkey).groupBy("o_custkey", "l_partkey").agg(F.min("l_tax").alias("t"))
    j = one.join(parts(spark, d), one.l_partkey == F.col("p_partkey"))
    c = j.groupBy(F.col("o_custkey").alias("sample_id"), "gene").agg(
        F.min("t").alias("t"), F.array_join(F.array_sort(F.collect_set("token")), " ").alias("cell"))
    return c.select("sample_id", "gene", F.when(F.col("t") > 0, F.col("cell")).alias("cell"))


def kept_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cached cells for queries that read them more than once."""
    return keep(cells(spark, d))


def events(spark: SparkSession, d: str, dialect: str = "em5") -> DataFrame:
    return E.build_events(cells(spark, d), dialect)


def missing(spark: SparkSession, d: str, source: DataFrame | None = None) -> DataFrame:
    return E.missing_genes(cells(spark, d) if source is None else source, "em")


def samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("label"))


def folds(spark: SparkSession, d: str, seeds: Sequence[int] = (42,)) -> DataFrame:
    parts_ = [J.stratified_folds(samples(spark, d), K, s) for s in seeds]
    out = parts_[0]
    for p in parts_[1:]:
        out = out.unionByName(p)
    return keep(out)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, label, fold) for seed 42."""
    return folds(spark, d).select("sample_id", "label", "fold")


def proba(spark: SparkSession, d: str) -> DataFrame:
    """Packed probabilities (sample_id, model, y, p array) of three synthetic models."""
    s = samples(spark, d)
    names = s.agg(F.array_sort(F.collect_set("label")).alias("c")).scalar()
    s = s.select("sample_id", "label", (F.array_position(names, F.col("label")) - 1).cast("int").alias("y"))
    s = s.select("*", F.explode(F.array(*[F.lit(m) for m in range(MODELS)])).alias("model"))
    i = F.col("sample_id")

    def v(c):
        boost = (c == F.col("y")) & (i % 3 != F.col("model"))
        noise = (i * 31 + c * 17 + F.col("model") * 7 + (i * c) % 13) % 97
        return F.lit(1.0) + noise + F.when(boost, 60.0).otherwise(0.0)

    values = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), v)
    total = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x)
    s = s.withColumn("v", values).withColumn("t", total)
    return s.select("sample_id", "model", "y", F.transform("v", lambda x: x / F.col("t")).alias("p"))


SQL = {
    "part_": PART.replace("as string", "as varchar"),
    "raw": f"""select o_custkey sample_id, gene, {TOKEN} token, l_tax
 from lineitem join part_ on l_partkey=p_partkey join orders on l_orderkey=o_orderkey""",
    "cells": """select sample_id, gene,
 case when min(l_tax)>0 then string_agg(distinct token,' ' order by token) end cell from raw group by 1,2""",
    "missing": "select sample_id, gene from cells where cell is null",
    "toks": "select sample_id, gene, unnest(string_split(cell,' ')) tok from cells where cell is not null",
    "ev": r"""select sample_id, gene, token, case
  when regexp_extract(token,'^([A-Z])[0-9]+([A-Z])$',1)<>'' and regexp_extract(token,'^([A-Z])[0-9]+([A-Z])$',1)=regexp_extract(token,'^([A-Z])[0-9]+([A-Z])$',2) then 1
  when token like '%FS%' then 5 when regexp_matches(token,'\*|TER$|X$') then 4
  when regexp_matches(token,'DEL|INS|DUP|>|_') then 3 else 2 end conseq
 from (select distinct sample_id, gene, upper(tok) token from toks)""",
    "ev4": r"""select sample_id, gene, token, case
  when regexp_extract(token,'^([A-Z])[0-9]+([A-Z])$',1)<>'' and regexp_extract(token,'^([A-Z])[0-9]+([A-Z])$',1)=regexp_extract(token,'^([A-Z])[0-9]+([A-Z])$',2) then 1
  when regexp_matches(token,'FS|\*|TER') then 4
  when regexp_matches(token,'DEL|INS|DUP|>') then 3 else 2 end conseq
 from (select distinct sample_id, gene, upper(tok) token from toks)""",
    "evf": r"""select *, case when splice=1 then 'splice' when fs then 'frameshift' when nons then 'nonsense' when missense=1 then 'missense' else 'other' end kind,
  cast(fs or nons as int) truncating from (
 select *, cast(regexp_matches(token,'SPLICE|SPL_|IVS|[+-][0-9]+') as int) splice, token like '%FS%' fs,
  regexp_matches(token,'\*|TER$|STOP') nons,
  cast(regexp_matches(token,'^[A-Z*][0-9]+[A-Z*]$') and substr(token,1,1)<>substr(token,-1,1) and not regexp_matches(token,'\*|TER$|STOP') as int) missense
 from (select distinct sample_id, gene, upper(tok) token from toks))""",
    "jh": r"""select *, case when token like '%FS%' then 'FRAMESHIFT' when regexp_matches(token,'DEL|INS|DUP') then 'COMPLEX'
   when rt='*' then 'STOP' when rt='=' or (rt<>'' and rt=lt) then 'SYNONYMOUS' when rt<>'' then 'MISSENSE'
   when position is not null then 'OTHER' else 'UNPARSED' end consequence,
   case when token like '%FS%' and lt<>'' then lt when regexp_matches(token,'DEL|INS|DUP') then null when rt<>'' then lt end aa_from,
   case when regexp_matches(token,'DEL|INS|DUP|FS') then null when rt='=' then lt when rt<>'' then rt end aa_to
 from (select *, try_cast(nullif(regexp_extract(token,'[0-9]+'),'') as bigint) position,
   regexp_extract(token,'^[A-Z]') lt, regexp_extract(token,'^[A-Z][0-9]+([A-Z*=])$',1) rt
 from (select distinct sample_id, gene, regexp_replace(regexp_replace(upper(tok),'^P\.',''),'^([A-Z])([0-9]+)X$','\1\2*') token from toks))""",
    "jy": rf"""select *, case when regexp_matches(u,'X$') and regexp_matches(u,'DEL|INS|DUP|FS') then 'COMPLEX'
   when u like '%FS%' then 'FRAMESHIFT' when regexp_matches(u,'DEL|INS|DUP') then 'COMPLEX'
   when regexp_matches(u,'^[{AA}X][0-9]+\*$') then 'STOP' when lt<>'' and (rt='=' or rt=lt) then 'SYNONYMOUS'
   when lt<>'' and rt<>'*' then 'MISSENSE' when regexp_matches(u,'SPLICE|FUSION|AMP') then 'OTHER' else 'UNPARSED' end consequence,
   case when lt<>'' then concat(lt,'>',case when rt='=' then lt else rt end) end transition
 from (select *, upper(token) u, try_cast(nullif(regexp_extract(token,'[0-9]+'),'') as bigint) position,
   regexp_extract(upper(token),'^([{AA}])[0-9]+([{AA}*=])$',1) lt, regexp_extract(upper(token),'^([{AA}])[0-9]+([{AA}*=])$',2) rt
 from (select distinct sample_id, gene, replace(replace(replace(replace(regexp_replace(upper(tok),'^([{AA}X])([0-9]+)X$','\1\2*'),
   'DEL','del'),'INS','ins'),'DUP','dup'),'FS','fs') token from toks))""",
    "js1": r"""select *, case when lo like '%delins%' then 'DELINS' when lo like '%fs%' then 'FS' when lo like '%del%' then 'DEL'
   when lo like '%ins%' then 'INS' when lo like '%dup%' then 'DUP' when token like '%*%' or lo like '%stop%' then 'STOP'
   when token like '%>%' then 'SUB' else 'OTHER' end event_type
 from (select *, lower(token) lo, regexp_extract(token,'^([A-Za-z*]+)([0-9]+)([A-Za-z*]+)$',1) lw,
   try_cast(nullif(regexp_extract(token,'^([A-Za-z*]+)([0-9]+)([A-Za-z*]+)$',2),'') as bigint) wp,
   regexp_extract(token,'^([A-Za-z*]+)([0-9]+)([A-Za-z*]+)$',3) rw
  from (select sample_id, gene, regexp_replace(tok,'^p\.','') token from toks))""",
    "js2": r"""select * exclude (event_type), case when lo like '%delins%' then 'DELINS' when lo like '%fs%' then 'FS' when lo like '%del%' then 'DEL'
   when lo like '%ins%' or lo like '%dup%' then 'INS' when token like '%*%' or token like '%X' or lo like '%stop%' then 'STOP'
   when lw<>'' and lw=rw then 'SYN' when lw<>'' or token like '%>%' then 'SUB' else 'OTHER' end event_type,
   case when pos is null then null when pos<=50 then '001_050' when pos<=100 then '051_100' when pos<=250 then '101_250'
    when pos<=500 then '251_500' else '501_PLUS' end position_bin
 from (select *, try_cast(nullif(regexp_extract(token,'[0-9]+'),'') as bigint) pos from js1)""",
    "js3": rf"""select * from (select *, case when token='WT' then 'WT' when regexp_matches(lower(token),'fs|ins|del') then 'FS' when token like '%*%' then 'STOP'
   when token like '%>%' then 'MISSENSE'
   when len(runs)>=2 then case when runs[1]=runs[-1] then 'SILENT' else 'MISSENSE' end
   when length(token)>=2 and regexp_matches(token,'^[{AA}].*[{AA}]$') and substr(token,1,1)=substr(token,-1,1) then 'SILENT'
   else 'MISSENSE' end kind
  from (select *, regexp_extract_all(token,'[{AA}X*]+') runs from (
   select sample_id, gene, case when regexp_matches(lower(t1),'splice|ext|dup') then 'WT' else t1 end token from (
    select sample_id, gene, case when t0 like '%=%' then replace(t0,'=',substr(t0,1,1)) else t0 end t1 from (
     select sample_id, gene, replace(regexp_replace(tok,'^p\.',''),'?','X') t0 from toks))))) where kind<>'WT'""",
    "codes": """select sample_id, gene, least(9,count(*) filter (kind='FS'))*1000+least(9,count(*) filter (kind='STOP'))*100
  +least(9,count(*) filter (kind='MISSENSE'))*10+least(9,count(*) filter (kind='SILENT')) code from js3 group by 1,2""",
    "samples": "select c_custkey sample_id, c_mktsegment label from customer",
    "folds3": """select sample_id, label, seed, (row_number() over (partition by seed, label
   order by md5(concat(cast(sample_id as varchar),'|',cast(seed as varchar))))-1)%5 fold
 from samples cross join (values (42),(43),(44)) s(seed)""",
    "folds": "select sample_id, label, fold from folds3 where seed=42",
    "pres": "select distinct sample_id, gene from ev",
    "sev": "select sample_id, gene, max(conseq) severity from ev4 group by 1,2",
    "gn": "select sample_id, gene, count(*) n from ev group by 1,2",
    "proba": """select sample_id, model, class_id, y, v/sum(v) over (partition by sample_id, model) p from (
  select sample_id, model, class_id, y, 1e0+(sample_id*31+class_id*17+model*7+(sample_id*class_id)%13)%97
    + case when class_id=y and sample_id%3<>model then 60e0 else 0e0 end v
  from (select sample_id, dense_rank() over (order by label)-1 y from samples)
   cross join (select unnest(range(5)) class_id) cross join (select unnest(range(3)) model))""",
}
