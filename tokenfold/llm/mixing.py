"""Mixing sources to target weights by blocks of words; native expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenfold.llm.common import WORD, numbered
from tokenfold.session import settle

BLOCK = 512
SHARD_WORDS = 1 << 20


def _primes(start: int, n: int) -> list[int]:
    """The first ``n`` primes from ``start`` on."""
    found: list[int] = []
    while len(found) < n:
        if all(start % d for d in range(2, int(start**0.5) + 1)):
            found.append(start)
        start += 1
    return found


#: Multipliers of index permutations: a product with a block number below 2**35 stays a long.
MULTIPLIERS = _primes(100_000_000, 8)


def sized(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, tie): words of every whole text and a hash of the row."""
    words = F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({WORD})"))).cast("long")
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words.alias("size"), F.xxhash64(*docs.columns).alias("tie"))


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source: (nth, source, source_size, rows, target).

    Sources in code point order, null last, take ``weights`` in turn and share
    ``share`` times all words by them. No target exceeds ``most`` times its
    source; what is cut off goes to the others by weight until none is above.
    With sources by size per weight, that level is the greatest of (words left)
    / (weights left) before each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    nth = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int")
    per = per.withColumn("nth", nth)
    per = per.withColumn("_w", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("nth") % len(weights)))
    per = per.withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    per = per.withColumn("_level", left / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    level = F.max("_level").over(every)
    return per.select("nth", "source", "source_size", "rows", F.least("_cap", level * F.col("_w")).alias("target"))


def permuted(k: Column, n: Column, *seed: Column) -> Column:
    """Image of ``k`` under a pseudorandom permutation of 0 to n - 1 that ``seed`` picks."""
    turn = F.pmod(F.xxhash64(F.lit("a"), *seed), F.lit(len(MULTIPLIERS))).cast("int")
    ring = F.array(*[F.lit(p).cast("long") for p in MULTIPLIERS * 2])
    coprime = F.get(F.filter(F.slice(ring, turn + 1, F.lit(len(MULTIPLIERS))), lambda p: n % p != 0), F.lit(0))
    return F.pmod(coprime * k + F.pmod(F.xxhash64(F.lit("b"), *seed), n), n)


def slots(per: DataFrame, seed: int = 0, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Blocks that the mix takes: (nth, pass, block, words, shard).

    A source's words in passes: a pass takes every block once, in the order of
    an index permutation; the last pass stops at the target, inside a block. The
    short last block stands outside the permutation, at the end. Every slot draws
    its output shard on its own, so the source counts of a shard are multinomial
    while the source totals keep their targets.
    """
    size, target = F.col("source_size"), F.col("target")
    whole = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("long")
    rest = F.least(size, F.greatest(F.lit(0), F.round(target - whole * size).cast("long")))
    shards = F.greatest(F.lit(1), F.ceil(F.sum("target").over(Window.partitionBy()) / shard_words)).cast("long")
    passes = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_whole")))
    p = per.where("source_size > 0").select("nth", "source_size", whole.alias("_whole"), rest.alias("_rest"), shards.alias("_shards"))
    p = p.select("*", passes.alias("pass"))
    p = p.withColumn("_take", F.when(F.col("pass") < F.col("_whole"), F.col("source_size")).otherwise(F.col("_rest"))).where("_take > 0")
    # a row for each run of slots first, so that a large source is dealt out before its slots are made
    run = 1 << 14
    p = p.withColumn("_slots", F.ceil(F.col("_take") / block).cast("long"))
    p = p.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_slots") - 1) / run).cast("long"))).alias("_run"))
    p = p.repartition(F.col("nth"), F.col("pass"), F.col("_run"))
    last = F.least((F.col("_run") + 1) * run, F.col("_slots")) - 1
    p = p.select("*", F.explode(F.sequence(F.col("_run") * run, last)).alias("_k"))
    full = F.floor(F.col("source_size") / block).cast("long")
    at = F.when(F.col("_k") < full, permuted(F.col("_k"), full, F.lit(seed), F.col("nth"), F.col("pass"))).otherwise(full)
    shard = F.pmod(F.xxhash64(F.lit("shard"), F.lit(seed), F.col("nth"), F.col("pass"), F.col("_k")), F.col("_shards"))
    return p.select("nth", "pass", at.alias("block"), F.least(F.lit(block), F.col("_take") - F.col("_k") * block).cast("long").alias("words"), shard.alias("shard"))


def streams(sizes: DataFrame, per: DataFrame, rows: int) -> DataFrame:
    """Documents with words, placed in their source's stream: (nth, start, doc_id, size, tie, source_size, target)."""
    other = per.select(F.col("source").alias("_source"), "nth", "source_size", "target")
    own = sizes.where("size > 0").join(other, F.col("source").eqNullSafe(F.col("_source")))
    return numbered(own.drop("_source", "source"), ["nth"], ["doc_id", "tie", "size"], rows, "start", value="size")


def mixed_spans(placed: DataFrame, taken: DataFrame, block: int = BLOCK, how: str = "inner") -> DataFrame:
    """Join blocks by index: (placed columns, pass, shard, block, first, n): words first to first + n - 1 of a document."""
    blocks = F.sequence(F.floor(F.col("start") / block).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block).cast("long"))
    parts = placed.select("*", F.explode(blocks).alias("block"))
    parts = parts.withColumn("first", F.greatest(F.lit(0).cast("long"), F.col("block") * block - F.col("start")))
    parts = parts.withColumn("_in", F.col("start") + F.col("first") - F.col("block") * block)
    parts = parts.withColumn("n", F.least(F.col("size") - F.col("first"), block - F.col("_in")))
    # both sides grow with the words; the planner cannot see how many rows an explode makes
    got = parts.join(taken.hint("merge"), ["nth", "block"], how)
    in_slot = F.coalesce(F.col("words"), F.lit(0).cast("long")) - F.col("_in")
    return got.withColumn("n", F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), in_slot))).drop("_in", "words")


def mix_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, block: int = BLOCK,
                  key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """How often the mix takes the words of every document: (doc_id, source, size, source_size, target, taken).

    A source's taken words equal its rounded target; a document is taken in at
    most ceil(target / size of its source) passes. Defined cases: a null or
    blank text has size 0 and is never taken; null is a source of its own, last
    in order; repeated rows are documents each, and rows equal in every column
    may swap their taken words; an empty table gives no rows; further columns
    only take part in the order of equal ids.
    """
    sizes = settle(sized(docs, key, source, text))
    per = settle(targets(sizes, weights, share, most))
    rows = per.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    spans = mixed_spans(streams(sizes, per, rows), slots(per, seed, block), block, "left")
    got = spans.groupBy("nth", "start", "doc_id", "size").agg(F.sum("n").alias("taken"))
    none = sizes.where("size = 0").join(per.select(F.col("source").alias("_source"), "nth"), F.col("source").eqNullSafe(F.col("_source")))
    out = got.select("doc_id", "nth", "size", "taken").unionByName(none.select("doc_id", "nth", "size", F.lit(0).cast("long").alias("taken")))
    return out.join(per.select("nth", "source", "source_size", "target"), "nth").select("doc_id", "source", "size", "source_size", "target", "taken")


def shard_words(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, block: int = BLOCK,
                words: int = SHARD_WORDS, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """What the output shards hold of the mix: (shard, source, slots, words), about ``words`` words a shard.

    A source's slots are dealt to the shards at random; its words add up to its
    rounded target over all shards. A shard without a source has no row for it.
    """
    per = settle(targets(sized(docs, key, source, text), weights, share, most))
    held = slots(per, seed, block, words).groupBy("shard", "nth").agg(F.count(F.lit(1)).alias("slots"), F.sum("words").alias("words"))
    return held.join(per.select("nth", "source"), "nth").select("shard", "source", "slots", "words")


def mixed_texts(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, block: int = BLOCK,
                key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: a row with the columns of ``docs`` for each pass over a document, with the taken words as its text.

    A document that a pass takes whole keeps its text; otherwise the taken words
    are joined by one space. Documents of which nothing is taken are absent.
    """
    sizes = settle(sized(docs, key, source, text))
    per = settle(targets(sizes, weights, share, most))
    rows = per.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    spans = mixed_spans(streams(sizes, per, rows), slots(per, seed, block), block).where("n > 0")
    ranges = spans.groupBy("nth", "start", "pass", "size", "tie").agg(F.array_sort(F.collect_list(F.struct("first", "n"))).alias("_spans"))
    ranges = ranges.select(F.col("tie").alias("_tie"), "_spans", F.col("size").alias("_size"))
    # rows equal in every column are one text here: each has its passes among the ranges
    row = docs.groupBy(F.xxhash64(*docs.columns).alias("_row")).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_doc"))
    got = row.join(ranges, F.col("_row") == F.col("_tie"))
    words = F.regexp_extract_all(F.col("_doc").getField(text), F.lit(f"({WORD})"))
    cut = F.array_join(F.flatten(F.transform("_spans", lambda s: F.slice(F.col("_words"), (s["first"] + 1).cast("int"), s["n"].cast("int")))), " ")
    whole = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["n"]) == F.col("_size")
    got = got.withColumn("_whole", whole).withColumn("_words", F.when(~F.col("_whole"), words))
    return got.select(*[(F.when(F.col("_whole"), F.col("_doc").getField(c)).otherwise(cut) if c == text else F.col("_doc").getField(c)).alias(c) for c in docs.columns])
