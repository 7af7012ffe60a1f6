"""Prefix trie of conversations: a compacted trie with two-fattest handles, grown in batches and expanded."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenfold.functions.stats import range_rank
from tokenfold.llm.common import WORD
from tokenfold.session import settle

#: Conversations of so many consecutive ids share their opening, of fewer than OPENING turns.
FAMILY, OPENING = 20, 4
#: One of so many different conversations belongs to the first batch.
FIRST_BATCH = 8
#: Depths in a slice of a path, and bits of an id inside a run of ids, that one task step works on.
PER_SLICE, RUN_BITS = 4_096, 12
#: Turns of a group of conversations that one task inserts.
PER_GROUP = 1 << 17
#: Path of the root, which holds no turn.
ROOT = -1
CHAIN = "array<struct<path:bigint,depth:int>>"

_MERGED = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def running(df: DataFrame, group: str, at: str, out: dict[str, tuple[str, Column]], backward: bool = False, before: bool = False,
            per_slice: int = PER_SLICE) -> DataFrame:
    """Add running sums, minima or maxima over ``at`` inside each group, slice by slice, so that a long group is many tasks.

    ``out`` maps a new column to (kind, input). ``backward`` runs from the end, ``before`` leaves the own row out. ``df`` is read
    twice: pass a settled table.
    """
    turned = F.desc if backward else F.asc
    sliced = df.withColumn("_slice", F.floor(F.col(at) / per_slice))
    upto = Window.partitionBy(group, "_slice").orderBy(turned(at)).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    slices = Window.partitionBy(group).orderBy(turned("_slice"))
    totals = sliced.groupBy(group, "_slice").agg(*[_MERGED[kind][0](c).alias(f"_{n}") for n, (kind, c) in out.items()])
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(group).alias("_of"), F.col("_slice").alias("_nth"), F.row_number().over(slices).alias("_place"),
                           *[_MERGED[kind][0](f"_{n}").over(earlier).alias(f"_{n}") for n, (kind, _) in out.items()]).where("_place > 1")
    own = sliced.select("*", *[_MERGED[kind][0](c).over(upto).alias(n) for n, (kind, c) in out.items()])
    both = own.join(totals, (F.col(group) == F.col("_of")) & (F.col("_slice") == F.col("_nth")), "left")
    return both.select(*df.columns, *[_MERGED[kind][1](F.col(n), F.col(f"_{n}")).alias(n) for n, (kind, _) in out.items()])


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the highest power of two divides."""
    bits = F.length(F.bin(low.cast("long").bitwiseXOR(high.cast("long")))) - 1
    return high.cast("long").bitwiseAND(F.expr("-1L") * F.pow(F.lit(2.0), bits).cast("long")).cast("int")


def rebuilt_turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(conversations (conv, size), their turns (conv, depth, a, b, words)), (depth, a, b) naming the turns up to depth.

    A turn's role and text become a SHA-256 digest, so texts stay in the scan. A prefix is named by sums of hashes of (depth,
    digest): 128 bits, whatever its length, and any stretch of it can be summed by itself.
    """
    said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(said[0]).cast("string"), F.lit(":"), *said), 256), 1, 32))
    turns = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), said[0].alias("role"), digest.alias("digest"),
        F.regexp_count(said[1], F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"))
    order = F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"), F.asc("row")
    ranked = settle(range_rank(turns, *order, rank="nth", keys=["conv"]).select("conv", "nth", "digest", "words"))
    taken = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(OPENING)).cast("int")
    first = F.col("conv") - F.col("conv") % FAMILY
    sizes = ranked.groupBy("conv").agg(F.count(F.lit(1)).cast("int").alias("n"))
    openings = sizes.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("first"), F.least("n", F.lit(OPENING - 1)).alias("there"))
    sizes = sizes.withColumns({"taken": taken, "first": first}).join(openings, "first", "left")
    sizes = sizes.withColumn("given", F.least("taken", F.coalesce("there", F.lit(0))))
    sizes = settle(sizes.select("conv", "first", "taken", "given", (F.col("given") + F.greatest(F.col("n") - F.col("taken"), F.lit(0))).alias("size")))
    own = ranked.join(sizes, "conv").where("nth > taken").select("conv", (F.col("given") + F.col("nth") - F.col("taken")).alias("depth"), "digest", "words")
    lent = ranked.where((F.col("conv") % FAMILY == 0) & (F.col("nth") < OPENING)).withColumnRenamed("conv", "first")
    lent = sizes.where("given > 0").select("conv", "first", "given").join(lent, "first").where("nth <= given")
    both = own.unionByName(lent.select("conv", F.col("nth").alias("depth"), "digest", "words"))
    hashes = [F.xxhash64(F.lit(k), "depth", "digest") for k in range(2)]
    halves = {f"s{k}": ("sum", part) for k, part in enumerate(
        x for h in hashes for x in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)))}
    summed = running(settle(both), "conv", "depth", halves)
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    named = [F.shiftleft(low(f"s{k}"), 32).bitwiseOR(low(f"s{k + 1}")).alias(n) for k, n in ((0, "a"), (2, "b"))]
    return sizes.select("conv", "size"), settle(summed.select("conv", "depth", *named, "words"))


def id_digests(keyed: DataFrame, key: list[str], conv: str = "conv") -> DataFrame:
    """SHA-256 of the ids of each key, ascending and joined by commas: (key..., n, least, digest).

    Ids are gathered in runs of bounded length, and a task feeds the runs to the hash one after the other.
    """
    runs = keyed.groupBy(*key, F.shiftright(F.col(conv), RUN_BITS).alias("run")).agg(
        F.count(F.lit(1)).alias("n"), F.min(conv).alias("least"), F.array_join(F.sort_array(F.collect_list(conv)), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, n, least, done = None, None, 0, 0, []
        for b in batches:
            for *own, count, first, ids in zip(*[b.column(c).to_pylist() for c in (*key, "n", "least", "ids")]):
                if own != held:
                    if held is not None:
                        done.append((*held, n, least, state.hexdigest()))
                    held, state, n, least = own, hashlib.sha256(ids.encode()), count, first
                else:
                    state.update(b"," + ids.encode())
                    n += count
            yield batch(done)
            done = []
        yield batch([] if held is None else [(*held, n, least, state.hexdigest())])

    kinds = [f.dataType.simpleString() for f in runs.select(*key).schema]
    into = {"int": pa.int32(), "bigint": pa.int64()}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [*[into[k] for k in kinds], pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[*key, "n", "least", "digest"])

    schema = ", ".join([*[f"{c} {k}" for c, k in zip(key, kinds)], "n long, least long, digest string"])
    return runs.repartition(*key).sortWithinPartitions(*key, "run").mapInArrow(hashed, schema)


@dataclass
class Trie:
    """A compacted trie as two tables of paths, over the prefix names ``turns`` (conv, depth, a, b, words).

    paths (path, parent, start, end, chain): the turns of conversation ``path`` from depth start + 1 to end, hanging on path
    ``parent`` at depth start; chain lists where it and its ancestors hang. ends (conv, path, depth, chain): where conversations end.
    """

    turns: DataFrame
    paths: DataFrame | None = None
    ends: DataFrame | None = None

    def nodes(self) -> DataFrame:
        """Compacted nodes (path, above, depth, handle, a, b, mouth_a, mouth_b): the turns (above, depth] of a path.

        Paths are cut where conversations end and where other paths hang. A node's handle is the prefix whose length is the
        two-fattest number in (above, depth], its mouth the prefix of length above + 1.
        """
        cuts = self.paths.select("path", F.col("end").alias("depth")).union(self.ends.select("path", "depth"))
        cuts = cuts.union(self.paths.select("parent", "start")).where(F.col("path") != ROOT).distinct()
        cuts = running(settle(cuts), "path", "depth", {"above": ("max", F.col("depth"))}, before=True)
        cuts = cuts.join(self.paths.select("path", "start"), "path").withColumn("above", F.coalesce("above", "start"))
        cuts = cuts.withColumn("handle", fattest(F.col("above"), F.col("depth")))
        name = lambda at, a, b: self.turns.select(F.col("conv").alias("path"), F.col("depth").alias(at), F.col("a").alias(a), F.col("b").alias(b))
        cuts = cuts.withColumn("mouth", F.col("above") + 1).join(name("handle", "a", "b"), ["path", "handle"])
        return cuts.join(name("mouth", "mouth_a", "mouth_b"), ["path", "mouth"]).drop("mouth", "start")

    def matched(self, asked: DataFrame) -> DataFrame:
        """Lengthen ``depth``, up to which conversations follow ``path``, by the turns that they go on to share up to ``upto``."""
        own = self.turns.withColumnRenamed("depth", "at").join(asked.select("conv", "path", "depth", "upto"), "conv").where("at > depth AND at <= upto")
        along = self.turns.select(F.col("conv").alias("path"), F.col("depth").alias("at"), "a", "b")
        more = own.join(along, ["path", "at", "a", "b"]).groupBy("conv").agg(F.count(F.lit(1)).cast("int").alias("more"))
        return asked.join(more, "conv", "left").withColumn("depth", F.col("depth") + F.coalesce("more", F.lit(0))).drop("more")

    def named(self, asked: DataFrame, at: Column) -> DataFrame:
        """Add the name (a, b) of each conversation's prefix of length ``at``; depths that it doesn't have get nulls."""
        turns = self.turns.select("conv", F.col("depth").alias("_at"), "a", "b")
        return asked.withColumn("_at", at).join(turns, ["conv", "_at"], "left").drop("_at")

    def located(self, batch: DataFrame) -> DataFrame:
        """Exit places (conv, size, path, depth, chain): the longest prefix of each conversation that the trie holds.

        Fat binary search: the two-fattest length of what is still possible is looked up among the handles; a hit moves the lower
        end to the end of the node that was hit, a miss the upper end below the length. The last node that was hit is the exit
        node or its parent, so the turns of that node, then of the child at its end, are compared.
        """
        if self.paths is None:
            return batch.select("conv", "size", F.lit(ROOT).cast("long").alias("path"), F.lit(0).alias("depth"), F.array().cast(CHAIN).alias("chain"))
        nodes = settle(self.nodes())
        handles = nodes.select(F.col("handle").alias("_f"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("path").alias("_path"), F.col("depth").alias("_end"))
        at = batch.select("conv", "size", F.lit(0).alias("low"), F.col("size").alias("high"), F.lit(ROOT).cast("long").alias("path"),
                          F.lit(0).alias("hit"), F.lit(0).alias("end"))
        for _ in range(int(batch.agg(F.max("size")).first()[0] or 0).bit_length()):
            open_ = F.col("low") < F.col("high")
            at = self.named(at.withColumn("f", F.when(open_, fattest(F.col("low"), F.col("high"))).otherwise(0)), F.col("f"))
            spread = F.coalesce("a", F.xxhash64("conv"))  # a finished search looks up nothing, in any task
            at = at.join(handles, (F.col("f") == F.col("_f")) & (spread == F.col("_a")) & (F.coalesce("b", "conv") == F.col("_b")), "left")
            found = F.col("_f").isNotNull()
            at = at.select("conv", "size", F.when(found, F.col("_end")).otherwise(F.col("low")).alias("low"),
                           F.when(open_ & ~found, F.col("f") - 1).otherwise(F.col("high")).alias("high"),
                           F.coalesce("_path", "path").alias("path"), F.when(found, F.col("f")).otherwise(F.col("hit")).alias("hit"),
                           F.coalesce("_end", "end").alias("end"))
        at = settle(at.withColumnRenamed("hit", "depth").withColumn("upto", F.least("size", "end")))
        at = self.matched(at)
        mouths = nodes.select((F.col("above") + 1).alias("_f"), F.col("mouth_a").alias("_a"), F.col("mouth_b").alias("_b"), F.col("path").alias("_path"), F.col("depth").alias("_end"))
        through = (F.col("depth") == F.col("end")) & (F.col("depth") < F.col("size"))
        at = self.named(at.withColumn("f", F.when(through, F.col("depth") + 1).otherwise(0)), F.col("f"))
        at = at.join(mouths, (F.col("f") == F.col("_f")) & (F.coalesce("a", F.xxhash64("conv")) == F.col("_a")) & (F.coalesce("b", "conv") == F.col("_b")), "left")
        found = F.col("_f").isNotNull()
        at = settle(at.select("conv", "size", F.coalesce("_path", "path").alias("path"), F.when(found, F.col("f")).otherwise(F.col("depth")).alias("depth"),
                              F.when(found, F.least("size", "_end")).otherwise(F.col("depth")).alias("upto")))
        at = self.matched(at).join(self.paths.select("path", "chain"), "path", "left")
        return at.select("conv", "size", "path", "depth", F.coalesce("chain", F.array().cast(CHAIN)).alias("chain"))

    def inserted(self, batch: DataFrame, per_group: int = PER_GROUP) -> Trie:
        """The trie with a batch of different conversations (conv, size).

        Conversations that leave the trie at one place by the same turn form a group. A group of at most ``per_group`` turns is
        inserted by one task. Of a larger one, a member drawn by hash becomes a new path and the others are compared with it, which
        splits the group; each draw settles half of the turns that still tell members apart on average, so rounds grow with the
        logarithm of the group, also for a chain of prefixes.
        """
        paths, ends = [x for x in (self.paths,) if x is not None], [x for x in (self.ends,) if x is not None]
        at = settle(self.located(batch))
        while True:
            ends.append(at.where("depth = size").select("conv", "path", "depth", "chain"))
            left = at.where("depth < size")
            if left.isEmpty():
                break
            left = self.named(left, F.col("depth") + 1).withColumn("h", F.xxhash64("conv")).withColumn("mouth", F.struct("depth", "a", "b"))
            left = settle(left.drop("a", "b"))
            groups = left.groupBy("mouth").agg(F.sum(F.col("size") - F.col("depth")).alias("turns"), F.min(F.struct("h", "conv", "size")).alias("r"))
            left = settle(left.join(groups.select("mouth", "turns", F.col("r.conv").alias("rep"), F.col("r.size").alias("end")), "mouth"))
            grown = settle(self._grown(left.where(F.col("turns") <= per_group)))
            new = F.col("start") < F.col("size")
            hung = F.concat("chain", F.array(F.struct(F.col("parent").alias("path"), F.col("start").alias("depth")))).cast(CHAIN)
            paths.append(grown.where(new).select(F.col("conv").alias("path"), "parent", "start", F.col("size").alias("end"), hung.alias("chain")))
            ends.append(grown.select("conv", F.when(new, F.col("conv")).otherwise(F.col("parent")).alias("path"), F.col("size").alias("depth"),
                                     F.when(new, hung).otherwise(F.col("chain")).alias("chain")))
            large = left.where(F.col("turns") > per_group)
            if large.isEmpty():
                break
            large = large.withColumn("chain", F.concat("chain", F.array(F.struct("path", "depth"))).cast(CHAIN)).withColumn("upto", F.least("size", "end"))
            paths.append(large.where("conv = rep").select(F.col("rep").alias("path"), F.col("path").alias("parent"), F.col("depth").alias("start"), "end", "chain"))
            asked = large.withColumns({"path": F.col("rep"), "depth": F.when(F.col("conv") == F.col("rep"), F.col("size")).otherwise(F.col("depth") + 1)})
            at = settle(self.matched(asked.select("conv", "size", "path", "depth", "upto", "chain")))
        return Trie(self.turns, reduce(DataFrame.unionByName, paths) if paths else None, reduce(DataFrame.unionByName, ends))

    def _grown(self, left: DataFrame) -> DataFrame:
        """Insert small groups: where each member hangs, (conv, size, parent, start, chain of parent); start = size if it ends on a path there."""
        group = F.struct(*[F.col(f"mouth.{c}").alias(c) for c in ("depth", "a", "b")]).alias("group")
        turns = self.turns.join(left.select("conv", group, F.col("depth").alias("above")), "conv").where("depth > above").select("group", "conv", "depth", "a", "b")

        def grow(members: pa.Table, turns: pa.Table) -> pa.Table:
            own: dict[int, dict[int, tuple[int, int]]] = {}
            for c, d, a, b in zip(*[turns.column(x).to_pylist() for x in ("conv", "depth", "a", "b")]):
                own.setdefault(c, {})[d] = a, b
            out, holder, chains = [], {}, {}
            for _, conv, size, path, depth, chain in sorted(zip(*[members.column(x).to_pylist() for x in ("h", "conv", "size", "path", "depth", "chain")]), key=lambda m: m[:2]):
                names, low, high = own[conv], depth, size
                while low < high:
                    f = high & (-1 << (low ^ high).bit_length() - 1)
                    low, high = (f, high) if (f, names[f]) in holder else (low, f - 1)
                parent = holder[low, names[low]] if low > depth else path
                above = chains[parent] if low > depth else chain
                out.append((conv, size, parent, low, above))
                if low < size:
                    chains[conv] = [*above, {"path": parent, "depth": low}]
                    holder.update(((d, names[d]), conv) for d in range(low + 1, size + 1))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.struct([("path", pa.int64()), ("depth", pa.int32())]))]
            return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["conv", "size", "parent", "start", "chain"])

        members = left.select("mouth", "h", "conv", "size", "path", "depth", "chain").groupBy("mouth")
        return members.cogroup(turns.groupBy("group")).applyInArrow(grow, f"conv long, size int, parent long, start int, chain {CHAIN}")


def conversation_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                      first_batch: int = FIRST_BATCH, per_group: int = PER_GROUP) -> tuple[Trie, DataFrame]:
    """(trie of the different rebuilt conversations, its depth nodes); see ``trie_nodes`` for the nodes."""
    sizes, turns = rebuilt_turns(conversations, conv, turn, role, text)
    key = ["size", "a", "b"]
    last = turns.select("conv", F.col("depth").alias("size"), "a", "b")
    whole = sizes.join(last, ["conv", "size"], "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in "ab"})
    kinds = settle(id_digests(whole, key))
    every = kinds.select(F.col("least").alias("conv"), "size")
    turns = settle(turns.join(every.select("conv"), "conv", "left_semi"))
    trie = Trie(turns)
    early = F.pmod(F.xxhash64(F.lit("batch"), "conv"), F.lit(first_batch)) == 0
    for part in (early, ~early):
        trie = trie.inserted(every.where(part), per_group)
    return trie, trie_nodes(trie, kinds)


def trie_nodes(trie: Trie, kinds: DataFrame) -> DataFrame:
    """Expand the compacted trie: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``kinds`` (size, a, b, n, least, digest) are the different conversations. What ends or hangs at a place counts for all nodes
    above it: on its own path by running sums from the end, on the paths above at the places of its chain.
    """
    none = hashlib.sha256(b"").hexdigest()
    ends = trie.ends.join(kinds.select(F.col("least").alias("conv"), "n"), "conv")
    paths = trie.paths if trie.paths is not None else trie.turns.sparkSession.createDataFrame([], f"path long, parent long, start int, end int, chain {CHAIN}")
    hung = paths.groupBy(F.col("parent").alias("path"), F.col("start").alias("depth")).agg(F.count(F.lit(1)).alias("hung"))
    root = F.array(F.struct(F.lit(ROOT).cast("long").alias("path"), F.lit(0).alias("depth"))).cast(CHAIN)
    here = lambda path, depth: F.array(F.struct(F.col(path).alias("path"), F.col(depth).alias("depth"))).cast(CHAIN)
    places = lambda *chains: F.explode(F.array_distinct(F.concat(*chains))).alias("place")
    zero = F.lit(0).cast("long")
    tips = paths.select("path", F.col("end").alias("depth"), "chain").join(hung, ["path", "depth"], "left_anti")
    met = ends.select(places(root, "chain", here("path", "depth")), "n", F.col("conv").alias("least"), zero.alias("leaf"))
    met = met.unionByName(tips.select(places(root, "chain", here("path", "depth")), zero.alias("n"), F.lit(None).cast("long").alias("least"), F.lit(1).cast("long").alias("leaf")))
    met = met.groupBy("place.path", "place.depth").agg(*[f(c).alias(c) for f, c in ((F.sum, "n"), (F.min, "least"), (F.sum, "leaf"))])
    met = settle(met.join(hung, ["path", "depth"], "left"))
    count = lambda c: F.coalesce(c, zero)
    on = trie.turns.withColumnRenamed("conv", "path").join(paths.select("path", "parent", "start", "end"), "path").where("depth > start")
    on = settle(on.join(met, ["path", "depth"], "left"))
    on = running(on.withColumnsRenamed({"n": "n0", "least": "least0", "leaf": "leaf0"}), "path", "depth",
                 {"n_convs": ("sum", count("n0")), "conv_id": ("min", F.col("least0")), "n_leaves": ("sum", count("leaf0"))}, backward=True)
    on = on.withColumns({"value": (F.col("n_convs") - 1) * F.col("words"), "n_children": count("hung") + (F.col("depth") < F.col("end")).cast("long")})
    on = settle(on.drop("n0", "least0", "leaf0", "hung", "words"))
    saved = on.groupBy("path").agg(F.sum("value").alias("more")).join(paths.select("path", "chain"), "path")
    saved = settle(saved.select(places(root, "chain"), "more").groupBy("place.path", "place.depth").agg(F.sum("more").alias("more")))
    nodes = settle(on.join(saved, ["path", "depth"], "left"))
    nodes = running(nodes, "path", "depth", {"saved_tokens": ("sum", F.col("value") + count("more"))}, backward=True)
    nodes = nodes.withColumns({"up": F.when(F.col("depth") == F.col("start") + 1, F.col("parent")).otherwise(F.col("path")), "up_depth": F.col("depth") - 1})
    top = met.where(F.col("path") == ROOT).join(saved, ["path", "depth"], "left")
    turnless = kinds.where("size = 0").select(F.max("digest")).scalar()
    top = top.select(F.col("least").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                     count("hung").alias("n_children"), F.greatest("leaf", F.lit(1)).alias("n_leaves"), count("more").alias("saved_tokens"),
                     F.coalesce(turnless, F.lit(none)).alias("ends_sha256"))
    above = on.select(F.col("path").alias("up"), F.col("depth").alias("up_depth"), F.col("conv_id").alias("parent_conv_id"))
    above = above.unionByName(met.where(F.col("path") == ROOT).select(F.col("path").alias("up"), F.col("depth").alias("up_depth"), F.col("least").alias("parent_conv_id")))
    whole = kinds.where("size > 0").select(F.col("size").alias("depth"), "a", "b", "digest")
    nodes = nodes.join(above, ["up", "up_depth"]).join(whole, ["depth", "a", "b"], "left")
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("digest", F.lit(none)).alias("ends_sha256")).unionByName(top)
