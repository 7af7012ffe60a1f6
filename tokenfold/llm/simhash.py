"""SimHash near-duplicates by a segment-popcount grid join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenfold.llm.common import components
from tokenfold.llm.words import spans
from tokenfold.session import settle

SHINGLE = 3
MAX_BITS = 3
#: Two-bit segments of a 32-bit half: the low bits of all of them.
_EVEN = 0x55555555
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is in over half of the shingle hashes."""
    import xxhash

    data = b" ".join(text.encode().translate(_LOWER).split())  # bytes split at the ASCII blanks
    if not data:
        return 0
    starts, ends = spans(np.frombuffer(data, np.uint8))
    width = min(shingle, len(starts))
    first, last = starts[:len(starts) - width + 1], ends[width - 1:]
    counts, one = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(first), 1 << 16):
        cuts = zip(first[at:at + (1 << 16)].tolist(), last[at:at + (1 << 16)].tolist())
        hashes = np.array([one(data[a:b], seed) for a, b in cuts], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(first)).view(">u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, tie, fp) of every whole text; ``fp`` is the fingerprint as a signed long, ``tie`` a hash of the row."""
    row = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(*docs.columns).alias("tie"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py() or "", shingle) for x in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["doc_id", "tie", "fp"])

    return row.mapInArrow(run, "doc_id long, tie long, fp long")


def popcounts(half: Column) -> Column:
    """Bit counts (0 to 2) of the two-bit segments of a 32-bit half, in two bits each."""
    return half.bitwiseAND(F.lit(_EVEN).cast("long")) + F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(_EVEN).cast("long"))


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of different fingerprints in column ``fp`` that differ in at most ``max_bits`` (at most 3) bits.

    The bit counts of two-bit segments are a point of a grid, and the Manhattan
    distance of two points never exceeds the Hamming distance. Of 3 differing
    bits one half has at most one, so the points of that half are equal or lie
    one step apart: each point meets the points of its own cell and of the cells
    one step up. What meets is compared exactly. ``fps`` holds each fingerprint
    once.
    """
    if max_bits > 3:
        raise ValueError("the grid join finds at most 3 differing bits")
    half = F.explode(F.array(
        F.struct(F.lit(0).alias("h"), popcounts(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias("cell")),
        F.struct(F.lit(1).alias("h"), popcounts(F.shiftrightunsigned("fp", 32)).alias("cell"))))
    points = fps.select("fp", half.alias("_p")).select("fp", "_p.h", "_p.cell")
    up = [F.when(F.shiftright(F.col("cell"), 2 * j).bitwiseAND(F.lit(3).cast("long")) < 2, F.col("cell") + F.lit(1 << 2 * j).cast("long")) for j in range(16)]
    steps = F.explode(F.array_compact(F.array(F.col("cell"), *up)))
    probes = points.select(F.col("fp").alias("of"), F.col("h").alias("_h"), F.col("cell").alias("own"), steps.alias("_cell"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("of"))) <= max_bits
    once = (F.col("own") != F.col("_cell")) | (F.col("of") < F.col("fp"))
    met = probes.join(points, (F.col("h") == F.col("_h")) & (F.col("cell") == F.col("_cell")) & near & once)
    return met.select(F.least("of", "fp").alias("a"), F.greatest("of", "fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Groups of documents that links join: (doc_id, tie, fp, component_id, kept_tie).

    Documents with one fingerprint are one point, so a group of copies costs one
    row however large it is; links between points lose none. ``component_id`` is
    the smallest id of the group; ``kept_tie`` is the row hash of the document
    that stays (smallest id, then smallest row hash). Defined cases: a null or
    blank text has fingerprint 0, linked like any other; null ids come last, and
    a group of null ids alone has a null component; repeated rows are documents
    each; an empty table gives no rows; further columns only enter ``tie``.
    """
    rows = settle(fingerprints(docs, key, text, shingle))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie"))
    points = settle(rows.groupBy("fp").agg(least.alias("m")))
    linked = components(fingerprint_links(points.select("fp"), max_bits)).withColumnRenamed("id", "_id")
    rooted = points.join(linked, points["fp"] == linked["_id"], "left").select("fp", "m", F.coalesce("component", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("m").alias("least")).withColumnRenamed("root", "_root")
    groups = rooted.join(first, F.col("root") == F.col("_root"))
    groups = groups.select(F.col("fp").alias("_fp"), F.col("least.doc_id").alias("component_id"), F.col("least.tie").alias("kept_tie"))
    return rows.join(groups, F.col("fp") == F.col("_fp")).select("doc_id", "tie", "fp", "component_id", "kept_tie")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with one document of each group, its columns unchanged."""
    kept = near_duplicates(docs, key, text, shingle, max_bits).select(F.col("kept_tie").alias("_kept")).distinct()
    rows = docs.withColumn("_row_tie", F.xxhash64(*docs.columns)).join(kept, F.col("_row_tie") == F.col("_kept"), "left_semi")
    return rows.dropDuplicates(["_row_tie"]).select(*[F.col(f"`{c}`") for c in docs.columns])
