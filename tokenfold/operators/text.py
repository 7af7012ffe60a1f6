"""Mutation documents and TF-IDF vectors as long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenfold.functions import cells as C
from tokenfold.functions import stats as S
from tokenfold.session import keep, sent, settle

EMPTY = "NO_MUTATION"
#: Terms that a query names one by one.
MOST_NAMED = 10_000
#: Terms of a learnt vocabulary that is sent to the documents, whose far more numerous terms then stay where they are.
MOST_SENT = 1 << 18
_WORD = r"^([A-Za-z*]+)(\d+)([A-Za-z*]+)$"


def event_terms(gene: Column, event: Column) -> Column:
    """The four to eight document terms of one event (G, GT, E, T and for substitutions AA, AAG, POS, POSG)."""
    kind = C.event_type_jsj(event, 1)
    left, pos, right = (F.regexp_extract(event, _WORD, i) for i in (1, 2, 3))
    change = F.concat(left, F.lit(">"), right)
    where = C.position_bin(pos.try_cast("bigint"), "jsj")
    cat = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    base = F.array(cat("G=", gene), cat("GT=", gene, ":", kind), cat("E=", gene, ":", event), cat("T=", kind))
    more = F.array(cat("AA=", gene, ":", change), cat("AAG=", change), cat("POS=", gene, ":", where), cat("POSG=", where))
    return F.when(pos != "", F.concat(base, more)).otherwise(base)


def _mutated(cells: DataFrame) -> DataFrame:
    cell = F.col("cell")
    return cells.filter(cell.isNotNull() & ~C.norm_cell(cell).isin("WT", ""))


def cell_terms(cells: DataFrame) -> DataFrame:
    """(sample_id, gene, terms): the terms of a cell in order, computed inside the row."""
    toks = F.transform(C.raw_tokens(F.col("cell")), C.jsj_body)
    return _mutated(cells).select("sample_id", "gene", F.flatten(F.transform(toks, lambda t: event_terms(F.col("gene"), t))).alias("terms"))


def mutation_document(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """One text per sample, genes in name order; a sample without events is NO_MUTATION.

    The text is as long as the sample's row of the wide table; use
    :func:`document_terms` where only term counts are needed.
    """
    parts = cell_terms(cells).select("sample_id", F.struct("gene", F.array_join("terms", " ").alias("t")).alias("x"))
    g = parts.groupBy("sample_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    g = g.select("sample_id", F.array_join(F.transform("xs", lambda x: x["t"]), " ").alias("text"))
    return samples.select("sample_id").join(g, "sample_id", "left").fillna(EMPTY, ["text"])


def document_terms(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, term, tf) of the mutation documents without building their text."""
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = keep(cells.select("sample_id", "gene", "cell").repartition(parts, "sample_id"))  # a sample's cells meet before they grow to terms
    c.count()  # once cached, the planner knows that they have met
    t = cell_terms(c).select("sample_id", F.explode("terms").alias("term")).groupBy("sample_id", "term").agg(F.count("*").alias("tf"))
    some = _mutated(c).filter(F.size(C.raw_tokens(F.col("cell"))) > 0).select("sample_id").distinct()
    none = samples.select("sample_id").join(some, "sample_id", "left_anti").groupBy("sample_id").agg(F.count("*").alias("tf"))
    return t.unionByName(none.select("sample_id", F.lit(EMPTY).alias("term"), "tf"))


def _by_document(docs: DataFrame, id_col: str) -> DataFrame:
    """Texts spread by their id, one row each: term counts, norms and joins per
    document then need no further shuffle of the much larger exploded terms. The
    number of parts is given, so that small texts are not merged before they grow."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select(F.col(id_col).alias("sample_id"), "text").repartition(parts, "sample_id")


def word_terms(docs: DataFrame, id_col: str, n_max: int = 2) -> DataFrame:
    """(id, term, tf) of word 1..n-grams; every gram is built inside its row."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    d = _by_document(docs, id_col).select("sample_id", words.alias("w"))
    grams = [F.col("w")]
    for n in range(2, n_max + 1):
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        grams.append(F.transform(starts, _word_gram(n)))
    return d.select("sample_id", F.explode(F.concat(*grams)).alias("term")).groupBy("sample_id", "term").agg(F.count("*").alias("tf"))


def _words() -> Column:
    return F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")


def _char_grams(n_min: int, n_max: int) -> Column:
    """The n-grams of the padded word ``x``; one shorter than n gives itself once, at the first such n."""
    size, parts = F.length("x"), []
    for n in range(n_min, n_max + 1):
        cut = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), _substring(n))
        whole = F.array(F.col("x")) if n == n_min else F.array().cast("array<string>")
        parts.append(F.when(size >= n, cut).otherwise(whole))
    return F.concat(*parts)


def char_terms(docs: DataFrame, id_col: str, n_min: int = 3, n_max: int = 5, among: Sequence[str] | None = None) -> DataFrame:
    """(id, term, tf) of character n-grams inside space-padded lower-case words.

    Words are counted per document first, so repeated words are cut only once. A
    word shorter than n gives its padded form once, at the first such n. ``among``
    names the terms that are wanted; the others are dropped inside their row.
    """
    w = _by_document(docs, id_col).select("sample_id", F.explode(_words()).alias("w"))
    w = w.groupBy("sample_id", "w").agg(F.count("*").alias("c")).withColumn("x", F.concat(F.lit(" "), "w", F.lit(" ")))
    grams = _char_grams(n_min, n_max)
    if among is not None:
        grams = F.filter(grams, lambda g: g.isin(*among))
    return w.select("sample_id", "c", F.explode(grams).alias("term")).groupBy("sample_id", "term").agg(F.sum("c").alias("tf"))


def char_totals(docs: DataFrame, n_min: int = 3, n_max: int = 5) -> DataFrame:
    """(term, total) over all documents: each different word is cut once."""
    w = docs.select(F.explode(_words()).alias("w")).groupBy("w").agg(F.count("*").alias("c")).withColumn("x", F.concat(F.lit(" "), "w", F.lit(" ")))
    return w.select("c", F.explode(_char_grams(n_min, n_max)).alias("term")).groupBy("term").agg(F.sum("c").alias("total"))


def _word_gram(n: int):
    return lambda i: F.array_join(F.slice("w", i, n), " ")


def _substring(n: int):
    return lambda i: F.substring(F.col("x"), i, F.lit(n))


def learn_idf(terms: DataFrame, n_docs: Column, min_df: int = 1, max_features: int | None = None, smooth: bool = True) -> DataFrame:
    """(term, df, idf): ln((1+n)/(1+df)) + 1 of terms frequent enough.

    ``max_features`` keeps the terms with the largest total count, ties by term.
    """
    v = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    if max_features is not None:
        v = v.orderBy(F.desc("total"), "term").limit(max_features)
    return v.withColumn("_n", n_docs).select("term", "df", (F.ln((1 + F.col("_n")) / (1.0 + F.col("df"))) + 1).alias("idf"))


def tfidf(terms: DataFrame, idf: DataFrame, sublinear: bool = True, weight: float = 1.0) -> DataFrame:
    """(sample_id, feature, value): tf-idf with unit length per document, times ``weight``."""
    tf = F.col("tf").cast("double")
    tf = 1 + F.ln(tf) if sublinear else tf
    x = terms.join(idf.select("term", "idf"), "term").select("sample_id", F.col("term").alias("feature"), (tf * F.col("idf")).alias("value"))
    # the norm is a plain aggregate joined back, so a long document is not one window; it has a row a document, the terms are not sorted for it
    norm = x.groupBy("sample_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_l")).hint("shuffle_hash")
    return x.join(norm, "sample_id").select("sample_id", "feature", (F.col("value") / F.col("_l") * weight).alias("value"))


def word_tfidf(docs: DataFrame, id_col: str, n_max: int = 2, min_df: int = 2, max_features: int | None = None) -> DataFrame:
    t = word_terms(docs, id_col, n_max)
    return tfidf(t, learn_idf(t, S.total(docs, F.count("*")), min_df, max_features))


def char_tfidf(docs: DataFrame, id_col: str, min_df: int = 2, max_features: int | None = None, weight: float = 0.5) -> DataFrame:
    """TF-IDF of character n-grams.

    With ``max_features`` only the terms with the largest totals are counted per
    document. Where too many of them are in fewer than ``min_df`` documents, more
    are taken, and past ``MOST_NAMED`` all.
    """
    n_docs, take = S.total(docs, F.count("*")), max_features
    if take is not None:
        # a term has no more documents than occurrences
        totals = keep(char_totals(docs).filter(F.col("total") >= min_df))
        while take <= MOST_NAMED:
            among = [r["term"] for r in totals.orderBy(F.desc("total"), "term").limit(take).collect()]
            if not among:
                break
            t = char_terms(docs, id_col, among=among)
            idf = settle(learn_idf(t, n_docs, min_df, max_features))
            if len(among) < take or idf.count() >= max_features:
                totals.unpersist()
                return tfidf(t, sent(idf, MOST_SENT), weight=weight)
            take *= 4
        totals.unpersist()
    t = char_terms(docs, id_col)
    return tfidf(t, sent(settle(learn_idf(t, n_docs, min_df, max_features)), MOST_SENT), weight=weight)


def token_tfidf(features: DataFrame, folds: DataFrame, held: int, min_df: int = 1) -> DataFrame:
    """TF-IDF of 0/1 token features (sample_id, feature), document frequencies without the held fold."""
    t = features.select("sample_id", F.col("feature").alias("term"), F.lit(1).alias("tf"))
    train = folds.filter(F.col("fold") != held).select("sample_id")
    idf = learn_idf(t.join(train, "sample_id", "left_semi"), S.total(train, F.count("*")), min_df)
    return tfidf(t, idf, sublinear=False)
