"""Gene-level aggregations over the event table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenfold.functions import cells as C
from tokenfold.functions import stats as S
from tokenfold.functions import vocabulary as V
from tokenfold.session import SENT_ROWS

SG = ["sample_id", "gene"]


def gene_presence(events: DataFrame) -> DataFrame:
    return events.select(*SG).distinct()


def marker_flags(events: DataFrame, samples: DataFrame, genes: Sequence[str] = V.MARKER_GENES) -> DataFrame:
    """One 0/1 column ``<gene>_mutated`` per marker gene, for every sample."""
    flags = (
        events.filter(F.col("gene").isin(*genes)).groupBy("sample_id")
        .agg(*[F.max(F.when(F.col("gene") == g, 1).otherwise(0)).alias(f"{g}_mutated") for g in genes])
    )
    return samples.select("sample_id").join(flags, "sample_id", "left").fillna(0)


def gene_support(events: DataFrame) -> DataFrame:
    """Number of samples mutated per gene."""
    return gene_presence(events).groupBy("gene").agg(F.count("*").alias("support"))


def filter_genes(events: DataFrame, minimum: int = 1) -> DataFrame:
    return gene_support(events).filter(F.col("support") >= minimum)


def filter_genes_class(events: DataFrame, samples: DataFrame, minimum: int, class_minimum: int | None) -> DataFrame:
    """Genes kept by total support, or rescued by the support in their best class."""
    by_class = gene_presence(events).join(samples.select("sample_id", "label"), "sample_id")
    per = by_class.groupBy("gene", "label").agg(F.count("*").alias("n"))
    out = per.groupBy("gene").agg(F.sum("n").alias("support"), F.max("n").alias("class_support"))
    keep = F.col("support") >= minimum
    if class_minimum is not None:
        keep = keep | (F.col("class_support") >= class_minimum)
    return out.filter(keep)


def top_genes(events: DataFrame, n: int) -> DataFrame:
    return S.top_rows(gene_support(events), n, F.desc("support"), F.asc("gene"))


def gene_severity(events: DataFrame) -> DataFrame:
    return events.groupBy(*SG).agg(F.max("conseq").alias("severity"))


def cell_severities(cells: DataFrame) -> DataFrame:
    """Whole-cell severity of mutated cells."""
    return cells.select(*SG, C.cell_severity(F.col("cell")).alias("severity")).filter("severity > 0")


def gene_functional(events: DataFrame) -> DataFrame:
    return events.filter(F.col("conseq") >= 2).select(*SG).distinct()


def gene_event_count(events: DataFrame) -> DataFrame:
    return events.groupBy(*SG).agg(F.count("*").alias("n_events"))


def gene_multi_hit(events: DataFrame) -> DataFrame:
    return gene_event_count(events).filter("n_events >= 2").select(*SG)


def gene_flag(events: DataFrame, kinds: Sequence[str] = ("truncating", "missense", "splice")) -> DataFrame:
    """0/1 flags per (sample, gene), rows with at least one flag set."""
    out = events.groupBy(*SG).agg(*[F.max(k).alias(k) for k in kinds])
    return out.filter(reduce(lambda a, b: a | b, [F.col(k) == 1 for k in kinds]))


def support_filter(features: DataFrame, minimum: int, key: str = "feature") -> DataFrame:
    """Keep rows of features active in at least ``minimum`` samples."""
    kept = features.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= minimum).select(key)
    return features.join(kept, key, "left_semi")


def gene_consequence(events: DataFrame, col: str = "consequence") -> DataFrame:
    return events.select(*SG, F.col(col).alias("consequence")).distinct()


def profile_support(gene_conseq: DataFrame, groups: DataFrame) -> DataFrame:
    """Support of each gene and consequence counted over distinct profiles."""
    j = gene_conseq.join(groups.select("sample_id", "profile"), "sample_id")
    return j.groupBy("gene", "consequence").agg(F.countDistinct("profile").alias("support"))


def gene_position_bin(events: DataFrame, minimum: int = 1, scheme: str = "jyp") -> DataFrame:
    b = events.select(*SG, C.position_bin(F.col("position"), scheme).alias("position_bin"))
    b = b.filter(F.col("position_bin").isNotNull()).distinct()
    return _min_support(b, ["gene", "position_bin"], minimum)


def gene_aa(events: DataFrame, minimum: int = 1) -> DataFrame:
    b = events.select(*SG, "transition").filter(F.col("transition").isNotNull()).distinct()
    return _min_support(b, ["gene", "transition"], minimum)


def _min_support(rows: DataFrame, key: Sequence[str], minimum: int) -> DataFrame:
    if minimum <= 1:
        return rows
    kept = rows.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= minimum).select(*key)
    return rows.join(kept, list(key), "left_semi")


def _f3_parts() -> Column:
    letters = list(V.AMINO_ACIDS) + ["*", "X"]
    left, right = F.col("aa_from"), F.col("aa_to")
    lok, rok = left.isin(*letters), right.isin(*letters)
    pos = C.position_bin(F.col("position"), "jh")
    parts = F.array(
        F.when(lok, F.concat(F.lit("AA_FROM="), left)),
        F.when(rok, F.concat(F.lit("AA_TO="), right)),
        F.when(lok & rok, F.concat(F.lit("AA_CHANGE="), left, F.lit(">"), right)),
        F.concat(F.lit("POSITION_BIN="), pos),
    )
    return F.array_compact(parts)


def global_f3(events: DataFrame) -> DataFrame:
    """Gene-free amino-acid and position tokens per sample."""
    return events.select("sample_id", F.explode(_f3_parts()).alias("feature")).distinct()


def gene_f3_tokens(events: DataFrame) -> DataFrame:
    """The same tokens prefixed by their gene."""
    part = events.select(*SG, F.explode(_f3_parts()).alias("part"))
    return part.select("sample_id", F.concat_ws("__", "gene", "part").alias("feature")).distinct()


def learn_vocab(features: DataFrame, minimum: int) -> DataFrame:
    return features.groupBy("feature").agg(F.count("*").alias("support")).filter(F.col("support") >= minimum)


def vocab_apply(features: DataFrame, vocab: DataFrame) -> DataFrame:
    return features.join(vocab.select("feature"), "feature", "left_semi").select("sample_id", "feature")


def stable_gene_onehot(events: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, consequence) flags restricted to the selected genes."""
    kept = events.join(genes.select("gene"), "gene", "left_semi")
    return kept.select(*SG, "conseq").distinct()


def pathway_table(spark, pathways: Mapping[str, Sequence[str]] = V.PATHWAYS) -> DataFrame:
    rows = [(p, g) for p, genes in pathways.items() for g in genes]
    return spark.createDataFrame(rows, "pathway string, gene string")


def pathway_scores(events: DataFrame, pathways: DataFrame) -> DataFrame:
    """Mutated gene count, any-flag and rate per (sample, pathway); zero rows are implicit."""
    size = F.count("*").over(_by("pathway"))
    sized = pathways.select("pathway", "gene").distinct().withColumn("size", size)
    hits = gene_presence(events).join(sized, "gene").groupBy("sample_id", "pathway")
    return hits.agg(F.count("*").alias("n"), F.max("size").alias("size")).select(
        "sample_id", "pathway", "n", F.lit(1).alias("any"), (F.col("n") / F.col("size")).alias("rate"))


def _by(*keys: str):
    from pyspark.sql import Window as W

    return W.partitionBy(*keys)


def code_flags(codes: DataFrame) -> DataFrame:
    """Presence flags of the five kinds packed in a cell code."""
    c = F.col("code")
    kinds = {
        "MUT": c > 0, "FS": c >= 1000, "STOP": F.floor(c / 100) % 10 > 0,
        "MISSENSE": F.floor(c / 10) % 10 > 0, "SILENT": c % 10 > 0,
    }
    named = F.array_compact(F.array(*[F.when(v & (c > 0), k) for k, v in kinds.items()]))
    return codes.select(*SG, F.explode(named).alias("kind"))


def assemble(blocks: Mapping[str, DataFrame]) -> DataFrame:
    """Union feature blocks (sample_id, feature, value) under ``block__feature`` names.

    A (sample, feature) pair that occurs twice raises at run time instead of
    being summed. Blocks whose names cannot meet are looked at one by one: one
    whose samples lie together is not shuffled for it.
    """
    parts = {
        name: b.select("sample_id", F.concat(F.lit(f"{name}__"), "feature").alias("feature"), F.col("value").cast("double"))
        for name, b in blocks.items()
    }
    if len(set(blocks)) != len(parts):
        raise ValueError("block names must be unique")
    # null features of several blocks are one, and a__b__c may be of a or of a__b
    meets = lambda a: parts[a].schema["feature"].nullable or any(b != a and (b.startswith(f"{a}__") or a.startswith(f"{b}__")) for b in parts)
    together = [a for a in parts if meets(a)]
    groups = [[parts[a]] for a in parts if a not in together] + ([[parts[a] for a in together]] if together else [])
    return reduce(DataFrame.unionByName, [_occurs_once(reduce(DataFrame.unionByName, g)) for g in groups])


def _occurs_once(rows: DataFrame) -> DataFrame:
    one = rows.groupBy("sample_id", "feature").agg(F.max("value").alias("value"), F.count("*").alias("_n"))
    return one.withColumn(
        "value", F.when(F.col("_n") == 1, F.col("value")).otherwise(
            F.raise_error(F.concat(F.lit("duplicate feature "), "feature")).cast("double"))
    ).drop("_n")


def feature_index(features: DataFrame) -> DataFrame:
    """Dense index of the feature names in the order of their hashes (a vocabulary-sized table)."""
    named = features.select("feature").distinct().withColumn("h", F.md5("feature"))
    return S.hash_rank(named, [], "h").select("feature", (F.col("rank") - 1).cast("int").alias("idx"))


def to_vectors(features: DataFrame, index: DataFrame, size: int, samples: DataFrame | None = None) -> DataFrame:
    """One sparse ML vector per sample; a row holds at most one entry per feature.

    A sparse vector is stored as a struct of kind, size, indices and values. The
    JVM builds it from the sorted entries; Arrow batches pass through unread, only
    to give the column its vector type. With ``samples`` each of them has a row.
    """
    from pyspark.ml.linalg import VectorUDT

    if size <= SENT_ROWS:
        index = F.broadcast(index)
    rows = features.join(index, "feature").groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("e"))
    if samples is not None:
        rows = samples.select("sample_id").join(rows, "sample_id", "left")
        rows = rows.withColumn("e", F.coalesce("e", F.array().cast(rows.schema["e"].dataType)))
    shape = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.col("e.idx").alias("indices"), F.col("e.value").alias("values"))
    as_rows = rows.select("sample_id", shape.alias("features"))
    schema = T.StructType([as_rows.schema["sample_id"], T.StructField("features", VectorUDT())])

    def passed(batches):
        yield from batches

    return as_rows.mapInArrow(passed, schema)
