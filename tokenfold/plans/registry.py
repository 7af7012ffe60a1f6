"""Registered pipelines: named lists of feature blocks with learnt state.

``fit`` learns the tables of every block on training samples; ``transform``
applies them to samples, seen or not, as long features (sample_id, feature,
value). A training sample carries its fold and is scored by what was learnt
without that fold; a new sample carries fold ``FULL`` and is scored by what was
learnt on all training samples. Labels are read while learning only.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenfold.functions import stats as S
from tokenfold.functions import vocabulary as V
from tokenfold.operators import events as E
from tokenfold.operators import genes as G
from tokenfold.operators import hotspots as H
from tokenfold.operators import latent as L
from tokenfold.operators import patterns as P
from tokenfold.operators import quality as Q
from tokenfold.operators import selection as X
from tokenfold.operators import signatures as Z
from tokenfold.operators import summaries as Y
from tokenfold.operators import text as T
from tokenfold.session import keep, sent, settle

FULL = Z.FULL
State = dict[str, DataFrame]


def _by_sample(cells: DataFrame) -> DataFrame:
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "sample_id")


@dataclass
class Inputs:
    """Cells and samples (sample_id, fold and, for learning, label), and what is derived from them once.

    Derived tables are persisted when first used; ``release`` lets them go.
    ``whole`` are inputs of more samples, of whose events those of these samples are taken.
    """

    cells: DataFrame
    samples: DataFrame
    k: int
    pairs: tuple = ()
    families: dict = field(default_factory=dict)
    _held: dict = field(default_factory=dict)
    whole: Inputs | None = None
    _lock: object = field(default_factory=threading.RLock, repr=False, compare=False)

    @classmethod
    def unseen(cls, cells: DataFrame, samples: DataFrame, like: Inputs) -> Inputs:
        """Samples that nothing was learnt from; only their ids are read."""
        return cls(cells, samples.select("sample_id").withColumn("fold", F.lit(FULL)), like.k, like.pairs, like.families, whole=like.whole)

    def shared(self) -> tuple[Inputs, int]:
        """The same inputs with their cells made once, for parts that several threads derive, and the number of cells."""
        cells = self.shared_cells
        return Inputs(cells, self.samples, self.k, self.pairs, self.families, self._held, self.whole), cells.count()

    def part(self, samples: DataFrame) -> Inputs:
        """Inputs of some of the samples."""
        cells = self.cells.join(samples.select("sample_id"), "sample_id", "left_semi")
        return Inputs(cells, samples, self.k, self.pairs, self.families, whole=self)

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        with self._lock:
            if name not in self._held:
                self._held[name] = keep(make())
                self._held[name].count()  # once cached, the planner knows how its rows are spread
            return self._held[name]

    @property
    def shared_cells(self) -> DataFrame:
        """The cells, those of a sample in one place: what is derived by sample needs no further shuffle of its much larger rows."""
        return self._once("cells", lambda: self.cells if self.whole is not None else _by_sample(self.cells))

    def events(self, dialect: str = "em5") -> DataFrame:
        if self.whole is not None:
            return self._once(dialect, lambda: self.whole.events(dialect).join(self.samples.select("sample_id"), "sample_id", "left_semi"))
        return self._once(dialect, lambda: E.build_events(self.shared_cells, dialect))

    @property
    def presence(self) -> DataFrame:
        return self._once("presence", lambda: G.gene_presence(self.events()))

    @property
    def functional(self) -> DataFrame:
        return G.gene_functional(self.events())

    @property
    def missing(self) -> DataFrame:
        return E.missing_genes(self.shared_cells, "em")

    @property
    def keys(self) -> DataFrame:
        return self._once("keys", lambda: P.pattern_key(self.shared_cells, self.samples))

    @property
    def parts(self) -> list[tuple[int, int]]:
        """Every training part: without each fold, and all rows."""
        return [*[(i, FULL) for i in range(self.k)], (FULL, FULL)]

    def release(self) -> None:
        for df in self._held.values():
            df.unpersist()
        self._held.clear()


@dataclass(frozen=True)
class Block:
    """``learn`` gives state tables from training inputs, ``apply`` features of any inputs."""

    learn: Callable[[Inputs], State]
    apply: Callable[[State, Inputs], DataFrame]


# --- shapes ---------------------------------------------------------------------
def _flags(rows: DataFrame, *name: str) -> DataFrame:
    return rows.select("sample_id", F.concat_ws(":", *name).alias("feature"), F.lit(1.0).alias("value")).distinct()


def _dense(rows: DataFrame, name: str, value: str) -> DataFrame:
    return rows.select("sample_id", F.col(name).alias("feature"), F.col(value).cast("double").alias("value"))


def _wide(df: DataFrame) -> DataFrame:
    return S.unpivot(df, ["sample_id"]).filter("value <> 0")


def _by_label(df: DataFrame) -> DataFrame:
    """(sample, label, measures...) to features named label:measure."""
    long = S.unpivot(df, ["sample_id", "label"], "m")
    return long.select("sample_id", F.concat_ws(":", "label", "m").alias("feature"), "value")


def _one(state: State, name: str) -> Column:
    """A learnt number as a scalar."""
    return state[name].select("v").scalar()


def _number(df: DataFrame, expr: Column) -> DataFrame:
    return df.agg(expr.alias("v"))


# --- kinds of blocks ------------------------------------------------------------------
def summary(fn: Callable[[Inputs], DataFrame]) -> Block:
    """Fixed columns, nothing learnt."""
    return Block(lambda x: {}, lambda s, x: _wide(fn(x)))


def vocabulary(fn: Callable[[Inputs], DataFrame]) -> Block:
    """Features named by the data: those of the training samples are kept."""
    return Block(lambda x: {"names": fn(x).select("feature").distinct()}, lambda s, x: fn(x).join(sent(s["names"]), "feature", "left_semi"))


def supported(fn: Callable[[Inputs], DataFrame], minimum: int) -> Block:
    """Features active in at least ``minimum`` training samples."""
    return Block(lambda x: {"names": G.learn_vocab(fn(x), minimum).select("feature")}, lambda s, x: fn(x).join(sent(s["names"]), "feature", "left_semi"))


def gene_set(pick: Callable[[Inputs], DataFrame], rows: Callable[[Inputs], DataFrame] = lambda x: _flags(x.presence, "gene")) -> Block:
    """Features named by a gene, for genes learnt on the training samples."""
    return Block(lambda x: {"genes": pick(x).select(F.col("gene").alias("feature"))}, lambda s, x: rows(x).join(sent(s["genes"]), "feature", "left_semi"))


def token_set(pick: Callable[[Inputs], DataFrame], dialect: str = "em5") -> Block:
    def flags(s: State, x: Inputs) -> DataFrame:
        return _flags(x.events(dialect).join(sent(s["tokens"]), ["gene", "token"], "left_semi"), "gene", "token")

    return Block(lambda x: {"tokens": pick(x).select("gene", "token")}, flags)


def _frequent(rows: DataFrame, minimum: int) -> DataFrame:
    """Rows of genes that enough samples have."""
    genes = rows.groupBy("gene").agg(F.count("*").alias("n")).filter(F.col("n") >= minimum).select("gene")
    return rows.join(genes, "gene", "left_semi")


def signature(rows: Callable[[Inputs], DataFrame] = lambda x: x.presence, labels: Callable[[Inputs], DataFrame] = lambda x: x.samples,
              only: Callable[[Inputs], Sequence[str]] | None = None, siblings: Callable[[Inputs], dict] | None = None, rate: bool = False,
              minimum: int = 5, **params) -> Block:
    """Class weights of every training part; a sample is scored by the part without its fold."""
    def learn(x: Inputs) -> State:
        w = Z.class_weights(_frequent(rows(x), minimum), labels(x), parts=x.parts, siblings=siblings(x) if siblings else None, **params)
        return {"w": w.filter(F.col("label").isin(*only(x))) if only else w}

    def score(s: State, x: Inputs) -> DataFrame:
        z = Z.signature_score(rows(x), sent(s["w"]), x.samples)
        return _by_label(Z.signature_rate(z, rows(x)) if rate else z)

    return Block(learn, score)


def union(**blocks: Block) -> Block:
    """Several blocks as one; features get the part's name."""
    def learn(x: Inputs) -> State:
        return {f"{n}.{k}": df for n, b in blocks.items() for k, df in b.learn(x).items()}

    def apply(s: State, x: Inputs) -> DataFrame:
        out = None
        for n, b in blocks.items():
            own = {k.split(".", 1)[1]: df for k, df in s.items() if k.split(".", 1)[0] == n}
            f = b.apply(own, x).withColumn("feature", F.concat(F.lit(f"{n}:"), "feature"))
            out = f if out is None else out.unionByName(f)
        return out

    return Block(learn, apply)


def tfidf(terms: Callable[[Inputs], DataFrame], min_df: int, most: int | None = None, weight: float = 1.0, sublinear: bool = True,
          only: str | None = None) -> Block:
    """Document frequencies of the training samples, applied to any samples; ``only`` filters (term, df)."""
    def learn(x: Inputs) -> State:
        idf = T.learn_idf(terms(x), S.total(x.samples, F.count("*")), min_df, most)
        return {"idf": idf if only is None else idf.filter(only)}

    return Block(learn, lambda s, x: T.tfidf(terms(x), sent(s["idf"], T.MOST_SENT), sublinear, weight))


def svd(base: Block, k: int) -> Block:
    """Right singular vectors of the training samples' features."""
    def learn(x: Inputs) -> State:
        held = {n: settle(df) for n, df in base.learn(x).items()}
        return held | {"svd": L.svd_state(base.apply(held, x), k)}

    return Block(learn, lambda s, x: L.svd_apply(base.apply(s, x), s["svd"]))


def modules(base: Block, k: int) -> Block:
    """Non-negative modules of the training samples' features."""
    def learn(x: Inputs) -> State:
        held = {n: settle(df) for n, df in base.learn(x).items()}
        return held | {"modules": L.nmf_state(base.apply(held, x), k)}

    def apply(s: State, x: Inputs) -> DataFrame:
        return L.nmf_apply(base.apply(s, x), s["modules"]).select("sample_id", F.col("module").cast("string").alias("feature"), "value")

    return Block(learn, apply)


def selected(pick: Callable[[DataFrame, Inputs], DataFrame]) -> Block:
    """Gene counts of the genes that ``pick`` chooses on the training samples."""
    return Block(lambda x: {"names": pick(_counts(x), x).select("feature")}, lambda s, x: _counts(x).join(sent(s["names"]), "feature", "left_semi"))


def _counts(x: Inputs) -> DataFrame:
    return _dense(G.gene_event_count(x.events()), "gene", "n_events")


def _patterns(measures: Callable[[State, Inputs], DataFrame], support: bool) -> Block:
    def learn(x: Inputs) -> State:
        if support:
            return {"n": x.keys.groupBy("key").agg(F.count("*").alias("n"))}
        return {"u": P.uncertainty_state(x.keys.drop("fold"), x.samples)}

    return Block(learn, lambda s, x: _wide(measures(s, x)))


def _support(s: State, x: Inputs) -> DataFrame:
    n = x.keys.select("sample_id", "key").join(s["n"], "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.select("sample_id", F.log1p(F.col("n").cast("double")).alias("support_log1p"), (F.col("n") >= 2).cast("int").alias("seen_multiple"))


def _f5() -> Block:
    def learn(x: Inputs) -> State:
        return {"f5": Z.f5_stable(x.presence, x.missing, x.samples, x.k, outer=[*range(x.k), FULL])}

    return Block(learn, lambda s, x: _by_label(Z.f5_score(x.presence, x.missing, x.samples, sent(s["f5"]), oof=True)))


def _f5_selective(n: int = 10) -> Block:
    """The class scores of the rarest training classes only."""
    base = _f5()

    def apply(s: State, x: Inputs) -> DataFrame:
        z = Z.f5_score(x.presence, x.missing, x.samples, sent(s["f5"]), oof=True)
        return _by_label(z.join(s["rare"], "label", "left_semi"))

    return Block(lambda x: base.learn(x) | {"rare": Z.rare_classes(x.samples, n).select("label")}, apply)


def _raw() -> Block:
    """Codes of whole cells by gene, wild type zero; a cell unknown to the training samples stands one below its gene's first code."""
    exact = lambda x: Q.exact_cells(x.shared_cells)

    def learn(x: Inputs) -> State:
        codes = keep(Q.wt_zero_codes(exact(x)))
        return {"codes": codes, "first": codes.groupBy("gene").agg(F.least(F.min("code"), F.lit(0)).alias("least"))}

    def apply(s: State, x: Inputs) -> DataFrame:
        z = exact(x).join(s["first"], "gene").join(s["codes"], ["gene", "value"], "left")
        z = z.withColumn("code", F.coalesce("code", F.when(F.col("value") == "WT", 0).otherwise(F.col("least") - 1)))
        return _dense(z.where("code <> 0"), "gene", "code")

    return Block(learn, apply)


def _f7(pairs: Callable[[Inputs], Sequence[tuple[str, str]]], **params) -> Block:
    """Burden-adjusted contrasts of label pairs; the pairs are part of the state."""
    def learn(x: Inputs) -> State:
        outer = [*range(x.k), FULL]
        return {f"{a}_vs_{b}": Z.pair_select(x.presence, x.missing, x.samples, (a, b), x.k, outer=outer, **params) for a, b in pairs(x)}

    def apply(s: State, x: Inputs) -> DataFrame:
        out = x.samples.select("sample_id", F.lit("").alias("feature"), F.lit(0.0).alias("value")).limit(0)
        for name, state in s.items():
            z = Z.pair_score(x.presence, x.missing, x.samples, sent(state), oof=True)
            out = out.unionByName(_wide(z.select("sample_id", *[F.col(c).alias(f"{name}_{c}") for c in z.columns if c != "sample_id"])))
        return out

    return Block(learn, apply)


def _discovered(x: Inputs, top: int = 6) -> list[tuple[str, str]]:
    """Label pairs that the out-of-fold signature arg-max confuses most (a bounded list)."""
    w = Z.class_weights(x.presence, x.samples, parts=[(i, FULL) for i in range(x.k)])
    z = Z.signature_score(x.presence, w, x.samples)
    best = z.groupBy("sample_id").agg(F.min_by("label", F.struct(-F.round("weighted", 9), F.col("label"))).alias("yhat"))
    pred = x.samples.select("sample_id", F.col("label").alias("y")).join(best, "sample_id")
    return [(r["left"], r["right"]) for r in Z.discover_pairs(pred, top).collect()]


def _contrast() -> Block:
    """Difference of the two signatures of each nested pair."""
    base = signature()

    def apply(s: State, x: Inputs) -> DataFrame:
        d = Z.pair_contrast(Z.signature_score(x.presence, sent(s["w"]), x.samples), list(x.pairs))
        return _by_label(d.withColumn("label", F.concat_ws("_", "left", "right")).drop("left", "right"))

    return Block(base.learn, apply)


def _similarity(*measures: str) -> Block:
    """Scores against class profiles; per-sample measures stand once."""
    def apply(s: State, x: Inputs) -> DataFrame:
        z = Z.similarity_score(x.presence, x.samples.select("sample_id", F.col("fold").alias("outer")), s["profiles"])
        own, shared = [m for m in measures if m in ("weighted", "similarity")], [m for m in measures if m in ("margin", "entropy")]
        parts = [_by_label(z.select("sample_id", "label", *own))] if own else []
        parts += [_wide(z.groupBy("sample_id").agg(*[F.max(m).alias(m) for m in shared]))] if shared else []
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    return Block(lambda x: {"profiles": Z.similarity_state(x.presence, x.samples, parts=x.parts)}, apply)


def _jh_tokens(x: Inputs) -> DataFrame:
    """Mutated genes, gene-free amino-acid tokens and exact events as 0/1 terms."""
    e = x.events("jh")
    return (_flags(G.gene_presence(e), "gene").withColumn("feature", F.concat(F.lit("gene="), "feature"))
            .unionByName(G.global_f3(e).select("sample_id", F.concat(F.lit("f3="), "feature").alias("feature"), F.lit(1.0).alias("value")))
            .unionByName(_flags(e, "gene", "token").withColumn("feature", F.concat(F.lit("event="), "feature"))))


def _jyp_tokens(x: Inputs) -> DataFrame:
    """Presence, consequence, position, amino-acid and exact-event terms of the strict dialect."""
    e = x.events("jyp")
    parts = {"gene": _flags(G.gene_presence(e), "gene"), "consequence": _flags(G.gene_consequence(e), "gene", "consequence"),
             "position": _flags(G.gene_position_bin(e), "gene", "position_bin"), "aa": _flags(G.gene_aa(e), "gene", "transition"),
             "event": _flags(e, "gene", "token")}
    out = None
    for n, f in parts.items():
        f = f.withColumn("feature", F.concat(F.lit(f"{n}="), "feature"))
        out = f if out is None else out.unionByName(f)
    return out


def _as_terms(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    return lambda x: fn(x).select("sample_id", F.col("feature").alias("term"), F.lit(1).alias("tf"))


def _scaled(fn: Callable[[Inputs], DataFrame]) -> Block:
    """Summary columns scaled by the means and deviations of the training samples."""
    def apply(s: State, x: Inputs) -> DataFrame:
        df = fn(x)
        return _wide(Y.standardize(df, s["scale"], [c for c in df.columns if c != "sample_id"]))

    return Block(lambda x: {"scale": Y.standardize_state(fn(x), [c for c in fn(x).columns if c != "sample_id"])}, apply)


def _with_genes(fn: Callable[[Inputs, Column], DataFrame]) -> Block:
    """Summary columns that relate to the number of genes of the training samples."""
    return Block(lambda x: {"genes": _number(x.events(), F.countDistinct("gene"))}, lambda s, x: _wide(fn(x, _one(s, "genes"))))


def _clipped_f1() -> Block:
    def learn(x: Inputs) -> State:
        e = x.events("jyp")
        return {"clip": x.samples.agg(F.lit(1).alias("one")).select(Y.burden_clip(G.gene_presence(e), x.samples).alias("v"))}

    return Block(learn, lambda s, x: _wide(Y.f1_summary(x.events("jyp"), x.missing, x.samples, _one(s, "clip"))))


def _distinct_genes(x: Inputs) -> DataFrame:
    """Genes without those whose mutated samples equal those of an earlier gene."""
    rows = _flags(x.presence, "gene")
    order = S.range_rank(rows.select("feature").distinct(), F.asc("feature"))
    twins = X.dedupe_features(rows, order).filter("feature <> keep").select("feature")
    return order.select("feature").join(twins, "feature", "left_anti").select(F.col("feature").alias("gene"))


def _top_pairs(x: Inputs, minimum: int = 5, top: int = 200) -> DataFrame:
    return Y.aa_pairs_state(x.events("jyp"), minimum, top).select(F.col("transition").alias("feature")).distinct()


def _families(x: Inputs) -> list[str]:
    return [f for f, members in x.families.items() if len(members) >= 2]


def _siblings(x: Inputs) -> dict:
    return {m: members for members in x.families.values() if len(members) >= 2 for m in members}


def _f_column(*names: str) -> Block:
    """Chosen columns of the per-sample event counts."""
    return summary(lambda x: Y.f_counts(x.events("f"), x.samples).select("sample_id", *names))


def _gene_flag(kind: str) -> Block:
    return vocabulary(lambda x: _flags(G.gene_flag(x.events("f"), [kind]), "gene"))


def _severity(x: Inputs) -> DataFrame:
    return _dense(G.gene_severity(x.events()), "gene", "severity")


#: Exact events need five training samples; genes and amino-acid tokens need one.
_KNOWN_EVENT = "not startswith(term, 'event=') or df >= 5"
#: Largest vocabularies of the text blocks.
WORDS, CHARACTERS = 250_000, 180_000

BLOCKS: dict[str, Block] = {
    "genes": vocabulary(lambda x: _flags(x.presence, "gene")),
    "active_genes": gene_set(lambda x: G.filter_genes(x.events(), 5)),
    "rescued_genes": gene_set(lambda x: G.filter_genes_class(x.events(), x.samples, 5, 3)),
    "top_genes": gene_set(lambda x: G.top_genes(x.events(), 3000)),
    "capped_genes": gene_set(lambda x: Z.gene_cap(x.presence, x.samples, 1500)),
    "class_genes": gene_set(lambda x: Z.class_gene_union(x.presence, x.samples, 20)),
    "markers": summary(lambda x: G.marker_flags(x.events(), x.samples)),
    "severity": vocabulary(_severity),
    "severity_active": gene_set(lambda x: G.filter_genes(x.events(), 5), _severity),
    "severity_capped": gene_set(lambda x: Z.gene_cap(x.presence, x.samples, 1500), _severity),
    "severity_distinct": gene_set(_distinct_genes, _severity),
    "severity_capped_distinct": gene_set(lambda x: Z.gene_cap(x.presence, x.samples, 1500).join(_distinct_genes(x), "gene", "left_semi"), _severity),
    "severity_other": gene_set(lambda x: G.filter_genes(x.events(), 5).join(Z.stable_genes(x.presence, x.samples, x.k, min(3, x.k)).select("gene"), "gene", "left_anti"), _severity),
    "raw": _raw(),
    "missing_mask": vocabulary(lambda x: _flags(x.missing, "gene")),
    "gene_counts": vocabulary(_counts),
    "multi_hit": vocabulary(lambda x: _flags(G.gene_multi_hit(x.events()), "gene")),
    "truncating": _gene_flag("truncating"), "missense": _gene_flag("missense"), "splice": _gene_flag("splice"),
    "gene_consequence": vocabulary(lambda x: _flags(G.gene_consequence(x.events("jyp")), "gene", "consequence")),
    "gene_position": supported(lambda x: _flags(G.gene_position_bin(x.events("jyp")), "gene", "position_bin"), 3),
    "gene_aa": supported(lambda x: _flags(G.gene_aa(x.events("jyp")), "gene", "transition"), 3),
    "gene_position_2": supported(lambda x: _flags(G.gene_position_bin(x.events("jyp")), "gene", "position_bin"), 2),
    "gene_aa_2": supported(lambda x: _flags(G.gene_aa(x.events("jyp")), "gene", "transition"), 2),
    "gene_f3": supported(lambda x: _flags(G.gene_f3_tokens(x.events("jh")), "feature"), 3),
    "gene_f3_rare": supported(lambda x: _flags(G.gene_f3_tokens(x.events("jh")), "feature"), 5),
    "global_f3": vocabulary(lambda x: _flags(G.global_f3(x.events("jh")), "feature")),
    "exact_tokens": token_set(lambda x: H.exact_vocab(x.events("jyp"), 5), "jyp"),
    "exact_tokens_10": token_set(lambda x: H.exact_vocab(x.events("jyp"), 10), "jyp"),
    "jh_tokens": token_set(lambda x: H.exact_vocab(x.events("jh"), 10), "jh"),
    "jh_tokens_rare": token_set(lambda x: H.exact_vocab(x.events("jh"), 5), "jh"),
    "pathways": vocabulary(lambda x: _by_label(G.pathway_scores(x.events(), G.pathway_table(x.cells.sparkSession)).withColumnRenamed("pathway", "label"))),
    "burden": _with_genes(lambda x, n: Y.burden(x.events(), x.samples, n)),
    "consequence_mix": summary(lambda x: Y.consequence_mix(G.cell_severities(x.cells), x.samples)),
    "severity_summary": summary(lambda x: Y.severity_summary(G.cell_severities(x.cells), x.samples)),
    "token_summary": summary(lambda x: Y.token_summary(x.events(), x.samples)),
    "compact_summary": summary(lambda x: Y.compact_summary(x.events(), x.samples)),
    "complexity": summary(lambda x: Y.token_complexity(x.events(), x.samples)),
    "mutated_genes": _f_column("mutated_gene_count"), "event_count": _f_column("mutation_event_count"),
    "log_burden": _f_column("mutation_burden_log1p"), "kind_counts": _f_column(*[f"{k}_event_count" for k in V.F_KINDS]),
    "multi_hit_genes": _f_column("multi_hit_gene_count"), "no_mutation": _f_column("no_mutation_sample"),
    "diversity": _with_genes(lambda x, n: Y.gene_diversity(x.events(), x.samples, n)),
    "f1": _clipped_f1(),
    "jh_f1": summary(lambda x: Y.jh_f1(x.events("jh"), x.samples)),
    "jh_f1_scaled": _scaled(lambda x: Y.jh_f1(x.events("jh"), x.samples)),
    "f1_scaled": _scaled(lambda x: Y.f1_summary(x.events("jyp"), x.missing, x.samples, float("inf"))),
    "aa_pairs": vocabulary(lambda x: _dense(Y.aa_pairs_log(x.events("jyp")), "transition", "value")),
    "top_aa_pairs": Block(lambda x: {"names": _top_pairs(x)},
                          lambda s, x: _dense(Y.aa_pairs_log(x.events("jyp")), "transition", "value").join(sent(s["names"]), "feature", "left_semi")),
    "aa_composition": summary(lambda x: Y.aa_composition(x.events("jyp"), x.samples)),
    "jsj1": summary(lambda x: Y.jsj1_structural(x.events("jsj1"), x.missing, x.samples)),
    "jsj2": summary(lambda x: Y.jsj2_summary(x.events("jsj2"), x.missing, x.samples)),
    "jsj3": summary(lambda x: Y.jsj3_summary(E.cell_code(x.events("jsj3")), x.samples)),
    "cell_code": vocabulary(lambda x: _dense(E.cell_code(x.events("jsj3")), "gene", "code")),
    "cell_code_v2": vocabulary(lambda x: _dense(E.cell_code(x.events("jsj2"), 2), "gene", "code")),
    "code_flags": vocabulary(lambda x: _flags(G.code_flags(E.cell_code(x.events("jsj3"))), "gene", "kind")),
    "e1": _with_genes(lambda x, n: Y.e1_summary(E.cell_code(x.events("jsj3")), x.samples, n)),
    "aa_profile": vocabulary(lambda x: _dense(Y.aa_profile(x.events("jsj3")), "feature", "n")),
    "hotspots": token_set(lambda x: H.learn_hotspots(x.events(), 5, 384)),
    "functional_hotspots": token_set(lambda x: H.functional_hotspots(x.events())),
    "synonymous_hotspots": token_set(lambda x: H.synonymous_hotspots(x.events())),
    "stable_hotspots": token_set(lambda x: H.stable_hotspots(x.events(), x.samples)),
    "hotspot_count": Block(lambda x: {"h": H.learn_hotspots(x.events())}, lambda s, x: _wide(H.hotspot_count(x.events(), s["h"], x.samples))),
    "gene_hotspot": Block(lambda x: {"h": H.learn_hotspots(x.events())}, lambda s, x: _flags(H.gene_hotspot(x.events(), s["h"]), "gene")),
    "signature": signature(),
    "signature_rate": signature(rate=True),
    "dual_signature": union(all=signature(), functional=signature(lambda x: x.functional)),
    "family_signature": signature(labels=lambda x: Z.map_labels(x.samples, x.families), only=_families, rate=True),
    "sibling_signature": signature(siblings=_siblings, rate=True),
    "weighted_profile": _similarity("weighted"), "similarity": _similarity("similarity"),
    "margin": _similarity("margin"), "entropy": _similarity("entropy"),
    "pair_contrast": _contrast(),
    "f5": _f5(),
    "f5_selective": _f5_selective(),
    "functional_signature": signature(lambda x: x.functional),
    "frequent": selected(lambda f, x: X.active_filter(f, 5, 1e-8)),
    "f7": _f7(lambda x: x.pairs, top=3, minimum=10, alpha=4.0),
    "f7_discovered": _f7(_discovered, top=3, minimum=10, alpha=4.0),
    "comutation": Block(lambda x: {"pairs": Z.comutation(x.presence, x.samples)}, lambda s, x: _flags(
        Z.comutation_flags(x.presence, s["pairs"]).withColumn("r", F.col("rank").cast("string")), "r")),
    "stable_genes": Block(lambda x: {"genes": Z.stable_genes(x.presence, x.samples, x.k, min(3, x.k))}, lambda s, x: _flags(
        G.stable_gene_onehot(x.events(), s["genes"]).withColumn("c", F.col("conseq").cast("string")), "gene", "c")),
    "pattern_support": _patterns(_support, True),
    "pattern_uncertainty": _patterns(lambda s, x: P.uncertainty_score(x.keys, x.samples, s["u"]).drop("fold"), False),
    "word_tfidf": tfidf(lambda x: T.word_terms(T.mutation_document(x.cells, x.samples), "sample_id"), 2, WORDS),
    "char_tfidf": tfidf(lambda x: T.char_terms(T.mutation_document(x.cells, x.samples), "sample_id"), 3, CHARACTERS, weight=0.5),
    "jh_tfidf": tfidf(_as_terms(_jh_tokens), 1, only=_KNOWN_EVENT),
    "svd": svd(gene_set(lambda x: G.filter_genes(x.events(), 5)), 128),
    "jh_svd": svd(tfidf(_as_terms(_jh_tokens), 1, only=_KNOWN_EVENT), 128),
    "jyp_svd": svd(tfidf(_as_terms(_jyp_tokens), 2, sublinear=False), 128),
    "modules": modules(gene_set(lambda x: G.filter_genes(x.events(), 5)), 16),
    "chi2": selected(lambda f, x: X.chi2_select(f, x.samples, 1500)),
    "mutual_information": selected(lambda f, x: X.mi_select(f, x.samples, 1500)),
    "anova": selected(lambda f, x: X.stable_anova(f, x.samples, x.k, 1500)),
}


# --- redundancy of a whole table: (features, inputs) -> names kept ------------------------------
def _ranked(f: DataFrame, x: Inputs) -> DataFrame:
    return settle(X.priority(X.anova_stability(f, x.samples, x.k)).select("feature", "rank"))


def without_redundancy(f: DataFrame, x: Inputs, minimum: int = 5, threshold: float = 0.9) -> DataFrame:
    """Active features; of equal ones and of highly correlated groups the best ranked."""
    active = settle(X.active_filter(f, minimum, 1e-8).select("feature"))
    f = f.join(active, "feature", "left_semi")
    ranks = _ranked(f, x)
    twins = settle(X.dedupe_features(f, ranks).filter("feature <> keep").select("feature"))
    ranks = ranks.join(twins, "feature", "left_anti")
    groups = X.corr_groups(f, x.samples, ranks, threshold).filter("feature <> keep").select("feature")
    return ranks.select("feature").join(groups, "feature", "left_anti")


def greedily_pruned(f: DataFrame, x: Inputs, threshold: float = 0.98) -> DataFrame:
    """Features in priority order without those too close to an earlier one."""
    ranks = _ranked(f, x)
    return ranks.select("feature").join(X.corr_greedy(f, x.samples, ranks, threshold), "feature", "left_anti")


def gene_representatives(f: DataFrame, x: Inputs, phi: float = 0.98, jaccard: float = 0.95, minimum: int = 5) -> DataFrame:
    """Gene features without genes that a stable, nearly equal gene represents."""
    edges = X.stable_edges(x.presence, x.samples, x.k, phi, jaccard, min(4, x.k), minimum)
    gone = X.representatives(edges, x.presence, x.samples).filter("gene <> keep").select("gene")
    names = f.select("feature").distinct().withColumn("gene", F.substring_index("feature", "__", -1))
    return names.join(gone, "gene", "left_anti").select("feature")


def pruned_within_genes(f: DataFrame, x: Inputs, threshold: float = 0.9) -> DataFrame:
    """Features of a gene in the order hotspots, count, multi-hit, consequence, without those close to an earlier one.

    Columns without a gene are pruned among themselves, in the order of their names.
    """
    block = F.substring_index("feature", "__", 1)
    blocks = ["hotspots", "gene_counts", "top_genes", "multi_hit", "severity"]
    place = F.array_position(F.array(*map(F.lit, blocks)), block)
    gene = F.when(place > 0, F.substring_index(F.expr("substr(feature, instr(feature, '__') + 2)"), ":", 1)).otherwise(F.lit(""))
    names = f.select("feature").distinct().select("feature", gene.alias("gene"), place.alias("place"))
    order = S.range_rank(names, F.asc("gene"), F.asc("place"), F.asc("feature")).select("feature", "gene", "rank")
    order = settle(order)
    return order.select("feature").join(X.gene_corr_drop(f, x.samples, order, threshold), "feature", "left_anti")


# --- compositions ----------------------------------------------------------------
_V16 = "severity_active consequence_mix signature hotspots".split()
_V24 = "severity_active token_summary dual_signature functional_hotspots".split()
_V44 = [*_V16, "pattern_uncertainty", "complexity", "pair_contrast"]
_V45 = [*_V24, "pattern_uncertainty", "complexity", "pair_contrast"]
_F_BLOCKS = ["mutated_genes", "event_count", "log_burden", "kind_counts", "hotspot_count", "multi_hit_genes", "no_mutation", "diversity", "genes",
             "gene_counts", "multi_hit", "gene_hotspot", "truncating", "missense", "splice", "weighted_profile", "similarity", "margin", "entropy"]
_V46 = [*_V45, *_F_BLOCKS]
_JYP = "active_genes f1 gene_consequence".split()
_JYP3 = [*_JYP, "gene_position", "gene_aa"]
_JYP4 = [*_JYP3, "exact_tokens"]
_RAW3 = ["raw", *_JYP, "gene_position_2", "gene_aa_2"]
_RAW4 = [*_RAW3, "exact_tokens_10"]
_JYP9 = [*_JYP4, "f7", "aa_pairs"]
_STABLE = ["severity_other", "token_summary", "functional_signature", "functional_hotspots", "stable_genes"]
_TEXT_TREE = ["word_tfidf", "char_tfidf", "active_genes", "jsj1"]
_TEXT = "word_tfidf char_tfidf".split()


def _swap(blocks: list[str], old: str, new: str) -> list[str]:
    return [new if b == old else b for b in blocks]


PIPELINES: dict[str, list[str]] = {
    "baseline": ["genes"], "em_v1": ["genes", "markers"], "em_v2": ["markers"], "em_v3": ["rescued_genes"],
    "em_v4": ["active_genes"], "em_v5": ["active_genes", "burden"], "em_v6": ["severity", "consequence_mix"], "em_v7": ["active_genes", "pathways"],
    "em_v8": ["active_genes", "modules"], "em_v9": ["active_genes", "signature"], "em_v10": ["severity", "burden"], "em_v11": ["active_genes", "burden", "signature"],
    "em_v12": ["severity", "signature"], "em_v13": ["severity", "burden", "signature"], "em_v14": _V16, "em_v15": _V16, "em_v16": _V16,
    "em_v17": ["hotspots", "gene_counts", "top_genes", "multi_hit"], "em_v18": ["severity_active", "token_summary", "functional_signature", "functional_hotspots"], "em_v19": _STABLE,
    "em_v20": _STABLE, "em_v21": ["severity_capped", "compact_summary", "functional_signature", "stable_hotspots"], "em_v22": [*_V16, "family_signature"],
    "em_v23": [*_V16, "sibling_signature"], "em_v24": _V24, "em_v25": ["hotspots", "gene_counts", "severity", "multi_hit", "signature"], "em_v26": [*_V16, "family_signature"],
    "em_v27": [*_V16, "sibling_signature"], "em_v28": ["severity_capped", "compact_summary", "functional_signature", "stable_hotspots"], "em_v29": _STABLE,
    **{f"em_v{i}": [*_V16, "burden"] for i in (30, 33, 34, 36)}, **{f"em_v{i}": _V16 for i in (31, 32, 35, 37, 38)},
    **{f"em_v{i}": _V24 for i in (39, 40, 41)}, **{f"em_v{i}": [*_V24, "synonymous_hotspots"] for i in (42, 43)},
    "em_v44": _V44, "em_v45": _V45, "em_v46": _V46, "em_v47": ["active_genes"],
    "em_E1": _V16, "em_E2": [*_V16, "pattern_support"], "em_E3": [*_V16, "complexity"], "em_E4": [*_V16, "comutation"],
    "em_E5": _swap(_V16, "hotspots", "stable_hotspots"), "em_E6": [*_V16, "pair_contrast"], "em_E7": [*_V16, "pattern_uncertainty"],
    "em_E8": _swap(_V16, "severity_active", "severity_capped"), "em_E9": _swap(_V16, "severity_active", "severity_distinct"),
    "em_E10": [*_swap(_swap(_V16, "hotspots", "stable_hotspots"), "severity_active", "severity_capped_distinct"),
               "pattern_support", "complexity", "comutation", "pair_contrast"],
    "em_E11": [*_V16, "pattern_uncertainty", "complexity"], "em_E12": [*_V16, "pattern_uncertainty", "pair_contrast"],
    "em_E13": [*_swap(_V16, "hotspots", "stable_hotspots"), "pattern_uncertainty"],
    "em_E14": [*_V16, "pattern_uncertainty", "complexity", "pair_contrast"],
    **{f"em_F{i:02d}": [*_V45, b] for i, b in enumerate(_F_BLOCKS, 1)}, "em_F20": _V46, "em_G01": _V46,
    "em_H01": ["frequent"], "em_H02": ["chi2"], "em_H03": ["mutual_information"], "em_H04": ["class_genes"], "em_H05": ["modules"], "em_H06": ["svd"],
    "em_H07": ["active_genes", "burden", "hotspots", "hotspot_count"],
    "jyp_raw": ["raw"], "jyp_f0": ["raw", "active_genes"], "jyp_f0_no_raw": ["active_genes"], "jyp_f1": ["raw", "active_genes", "f1"], "jyp_f2": ["raw", *_JYP],
    "jyp_f3_position": ["raw", *_JYP, "gene_position_2"], "jyp_f3": _RAW3, "jyp_f3_no_raw": _RAW3[1:], "jyp_f4": _RAW4, "jyp_f4_no_raw": _JYP4, "jyp_f5": [*_RAW4, "f5"],
    "jyp_f5_no_raw": [*_JYP4, "f5"], "jyp_f5_no_raw_missmask": [*_JYP4, "f5", "missing_mask"],
    "jyp_f5_selective_no_raw": [*_JYP4, "f5_selective", "missing_mask"], "jyp_f6": ["jyp_svd", "f1_scaled"], "jyp_f7": [*_JYP4, "f7"],
    "jyp_f8": [*_JYP4, "f5_selective", "f7"], "jyp_f9": _JYP9, "jyp_f10": [*_JYP9, "aa_composition"], "jyp_f11": [*_JYP9, "f7_discovered"],
    "pipeComb_v3": [*_JYP9, "dual_signature"], "pipeComb_v4": [*_JYP9, "dual_signature"],
    "jh_v01": ["genes"], "jh_v02": ["genes", "jh_f1"], "jh_v03": ["genes", "jh_f1", "gene_consequence"], "jh_v04": ["genes", "jh_f1", "global_f3"],
    "jh_v05": ["genes", "jh_f1", "gene_f3"], "jh_v06": ["genes", "jh_f1", "gene_f3_rare"], "jh_v07": ["genes", "jh_f1", "global_f3", "jh_tokens"],
    "jh_v08": ["genes", "jh_f1", "global_f3", "jh_tokens_rare"], "jh_v09": ["jh_tfidf", "jh_f1"], "jh_v10": ["jh_svd", "jh_f1"],
    "jsj_v1": [*_TEXT, "jsj1"], "jsj_v2": ["cell_code_v2", "jsj2"], "jsj_v3": _TEXT_TREE,
    **{f"jsj_v{i}": _TEXT_TREE for i in range(4, 12)},
    "pipeComb_em_v1_001": [*_V45, *_TEXT], "pipeComb_em_v1_006": [*_V45, *_TEXT], "pipeComb_em_v1_007": [*_V45, *_TEXT], "pipeComb_em_v2_001": [*_V46, *_TEXT],
    "pipeComb_em_v1": [*_V46, *_TEXT], "pipeComb_em_v2": [*_V46, *_TEXT, "f7"], "pipeComb_em_v3": [*_V46, *_TEXT, "f7", "top_aa_pairs"],
    "pipeComb_em_v4": [*_V46, *_TEXT, "f7", "top_aa_pairs", "svd"],
}

#: Pipelines whose whole feature table is thinned on the training samples.
THINNED: dict[str, Callable[[DataFrame, Inputs], DataFrame]] = {
    "em_G01": without_redundancy, "em_v47": gene_representatives, "em_v17": pruned_within_genes, "em_v25": pruned_within_genes,
    "pipeComb_em_v3": greedily_pruned, "pipeComb_em_v4": greedily_pruned,
}


@dataclass
class Fitted:
    """Learnt tables of a pipeline: one dict of small DataFrames a block, and the names kept if it is thinned."""

    name: str
    states: dict[str, State]
    kept: DataFrame | None = None

    def transform(self, x: Inputs) -> DataFrame:
        """Features of the samples of ``x``; their labels are not read."""
        blind = Inputs(x.cells, x.samples.select("sample_id", "fold"), x.k, x.pairs, x.families, x._held, x.whole)
        f = G.assemble({b: BLOCKS[b].apply(s, blind) for b, s in self.states.items()})
        return f if self.kept is None else f.join(sent(self.kept), "feature", "left_semi")


def fit(name: str, x: Inputs) -> Fitted:
    """Learn every block of a registered pipeline on labelled training samples with folds."""
    if name not in PIPELINES:
        raise KeyError(f"unknown pipeline {name!r}; known: {sorted(PIPELINES)}")
    learnt = Fitted(name, {b: {k: settle(df) for k, df in BLOCKS[b].learn(x).items()} for b in dict.fromkeys(PIPELINES[name])})
    if name in THINNED:
        f = keep(learnt.transform(x))
        learnt.kept = settle(THINNED[name](f, x).select("feature"))
        f.unpersist()
    return learnt


def build(name: str, x: Inputs) -> DataFrame:
    """Features of the training samples themselves, label statistics out of fold."""
    return fit(name, x).transform(x)
