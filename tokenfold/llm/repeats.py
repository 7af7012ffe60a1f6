"""Exact removal of repeated passages by fixed-block anchors."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenfold.llm.common import slices_for
from tokenfold.llm.words import window_hashes, word_digests

WINDOW = 35
#: Text bytes of a chunk (documents of one task step) and of a bucket (hashes compared in one task step).
PER_CHUNK = 4 << 20
PER_BUCKET = 16 << 20
_TAG = 38  # bits of an anchor hash that travel beside the bucket


class _Chunk:
    """The words of a chunk's documents as one stream."""

    def __init__(self, texts: list[bytes], window: int):
        digests, self.n_words = word_digests(texts)
        self.words, self.others = np.ascontiguousarray(digests[:, 0]), np.ascontiguousarray(digests[:, 1])
        self.last = np.cumsum(self.n_words)
        self.first = self.last - self.n_words
        self.begin = np.repeat(self.first, self.n_words)
        self.end = np.repeat(self.last, self.n_words)
        self.window, self.block = window, (window + 1) // 2

    def inside(self, width: int) -> np.ndarray:
        """Positions whose ``width`` words lie in one document."""
        at = np.arange(max(0, len(self.words) - width + 1))
        return at[at + width <= self.end[:len(at)]]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, hashes, is a reference block) of the rolling windows of a block's length."""
        at = self.inside(self.block)
        return at, window_hashes(self.words, self.block)[at], (at - self.begin[at]) % self.block == 0

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        at = self.inside(self.window)
        return at, window_hashes(self.words, self.window)[at]

    def around(self, hits: np.ndarray) -> np.ndarray:
        """Whether a window that starts at a position holds a hit anchor."""
        step = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(step, np.maximum(hits - (self.window - self.block), 0), 1)
        np.add.at(step, hits + 1, -1)
        return np.cumsum(step)[:-1] > 0

    def covered(self, hits: np.ndarray) -> np.ndarray:
        """Words that a window starting at one of ``hits`` covers."""
        step = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(step, hits, 1)
        np.add.at(step, hits + self.window, -1)
        return np.cumsum(step)[:-1] > 0


def _texts(table: pa.Table, nth: int) -> list[bytes]:
    """The texts of a chunk, column ``nth`` of its rows."""
    return [x or b"" for x in pc.struct_field(table.column("row"), [nth]).cast(pa.binary()).to_pylist()]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _rows(chunk: int, bucket: np.ndarray, width: int, packed: np.ndarray) -> pa.Table:
    """One row for each bucket from entries of ``width`` bytes that stand in bucket order."""
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cuts[1:], len(bucket))
    data = packed.tobytes()
    return pa.table({
        "chunk": pa.array(np.full(len(cuts), chunk, np.int64)), "bucket": pa.array(bucket[cuts].astype(np.int32)),
        "data": pa.array([data[a * width:b * width] for a, b in zip(cuts.tolist(), ends.tolist())], pa.binary())})


def _anchor_rows(chunk: int, c: _Chunk, buckets: int) -> pa.Table:
    """A chunk's distinct anchor hashes: 38 bits, whether seen twice here, whether a reference block."""
    _, hashes, block = c.anchors()
    sorted_ = np.sort((hashes >> np.uint64(1) << np.uint64(1)) | block.astype(np.uint64))
    first, run = _runs(sorted_ >> np.uint64(1))
    twice = (np.bincount(run, minlength=len(first)) > 1).astype(np.uint64)
    own = sorted_[first] >> np.uint64(1) << np.uint64(1)
    ends = np.append(first[1:], len(sorted_))[:len(first)]
    entry = (_anchor_tag(own) << np.uint64(2)) | (twice << np.uint64(1)) | (sorted_[ends - 1] & np.uint64(1))
    return _rows(chunk, _bucket(own, buckets), 5, entry.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _anchor_tag(hashes: np.ndarray) -> np.ndarray:
    """The lowest bits but the one that marks a block."""
    return (hashes >> np.uint64(1)) & np.uint64((1 << _TAG) - 1)


def _unpack(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries as rows of bytes, row of the table that each came with)."""
    data = [x.as_buffer() for x in table.column("data")]
    n = np.fromiter((b.size // width for b in data), np.int64, len(data))
    return np.concatenate([np.frombuffer(b, np.uint8) for b in data]).reshape(-1, width), np.repeat(np.arange(len(data)), n)


def _replies(table: pa.Table, source: np.ndarray, hit: np.ndarray, entries: np.ndarray) -> pa.Table:
    """The hit entries, back to the chunks that sent them."""
    order = np.flatnonzero(hit)
    own = source[order]
    cuts = np.flatnonzero(np.diff(own, prepend=-1))
    ends = np.append(cuts[1:], len(own))
    chunks = table.column("chunk").to_numpy()
    found = entries[order]
    return pa.table({
        "chunk": pa.array(chunks[own[cuts]].astype(np.int64)), "data": pa.array([found[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())})


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which ``hashes`` are among the ``known`` ones, of which there is at least one; both are walked in order."""
    order, known = np.argsort(hashes), np.sort(known)
    inside = np.empty(len(hashes), bool)
    own = hashes[order]
    inside[order] = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
    return inside


def _runs(sorted_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, run of each row) of equal neighbours."""
    new = np.ones(len(sorted_key), bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, per_chunk: int = PER_CHUNK, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Drop every word that a repeated passage of ``window`` words covers: (row, n_words, n_removed, kept).

    ``row`` holds the columns of ``docs``, ``kept`` the words left, joined by one
    space. A window is repeated if its words also start anywhere else, in the same
    document too; all occurrences go, judged on the input.

    Reference blocks of (window + 1) / 2 words stand side by side in every
    document, so each window holds a whole one. Documents are dealt to chunks; a
    chunk sends the distinct hashes of its rolling block-long windows, packed, to
    hash buckets. A bucket answers with the hashes that meet a reference block
    elsewhere. Around these hits the chunk forms the windows that hold one and
    sends their hashes the same way, 95 bits from both halves of 128-bit digests
    of the words: what occurs twice is repeated. A passage that many documents
    share costs each chunk one entry, chunks and
    buckets have a bounded size, and texts are shuffled once.

    Defined cases: a null or blank text has no words; documents shorter than a
    window stay; repeated rows lose all words if long enough; an empty table
    gives no rows; further columns come back in ``row``.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks, buckets = slices_for(total, per_chunk), slices_for(total, per_bucket)
    block = (window + 1) // 2
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    nth = docs.columns.index(text)
    keyed = docs.select(row.alias("row"), F.pmod(F.xxhash64(*docs.columns), F.lit(chunks)).alias("chunk"))
    sent, back = "chunk long, bucket int, data binary", "chunk long, data binary"

    def ask_anchors(key: tuple, table: pa.Table) -> pa.Table:
        return _anchor_rows(key[0].as_py(), _Chunk(_texts(table, nth), window), buckets)

    def answer_anchors(key: tuple, table: pa.Table) -> pa.Table:
        raw, source = _unpack(table, 5)
        entry = np.zeros((len(raw), 8), np.uint8)
        entry[:, :5] = raw
        entry = entry.view("<u8")[:, 0].astype(np.uint64)
        order = np.argsort(entry >> np.uint64(2), kind="stable")
        first, run = _runs((entry >> np.uint64(2))[order])
        flags = entry[order]
        many = np.bincount(run, minlength=len(first)) > 1
        many |= np.bincount(run, ((flags >> np.uint64(1)) & np.uint64(1)).astype(np.float64), len(first)) > 0
        many &= np.bincount(run, (flags & np.uint64(1)).astype(np.float64), len(first)) > 0
        hit = np.zeros(len(entry), bool)
        hit[order] = many[run]
        key_ = ((entry >> np.uint64(2)) | np.uint64(key[0].as_py()) << np.uint64(_TAG)).astype("<u8")
        return _replies(table, source, hit, key_)

    def ask_windows(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
        c = _Chunk(_texts(table, nth), window)
        at, hashes, _ = c.anchors()
        own = _anchor_tag(hashes >> np.uint64(1) << np.uint64(1)) | (_bucket(hashes, buckets).astype(np.uint64) << np.uint64(_TAG))
        hits = at[_among(own, _unpack(answers, 8)[0].view("<u8")[:, 0])]
        start, one = c.windows()
        near = c.around(hits)[start]
        start, one = start[near], one[near]
        two = window_hashes(c.others, window)[start] >> np.uint64(33) << np.uint64(1)
        order = np.argsort(one, kind="stable")
        one, two = one[order], two[order]
        first, run = _runs(one)
        two = two[first] | (np.bincount(run, minlength=len(first)) > 1).astype(np.uint64)
        packed = np.empty((len(first), 12), np.uint8)
        packed[:, :8] = one[first].astype("<u8").view(np.uint8).reshape(-1, 8)
        packed[:, 8:] = two.astype("<u4").view(np.uint8).reshape(-1, 4)
        return _rows(key[0].as_py(), _bucket(one[first], buckets), 12, packed)

    def answer_windows(key: tuple, table: pa.Table) -> pa.Table:
        raw, source = _unpack(table, 12)
        one = np.ascontiguousarray(raw[:, :8]).view("<u8")[:, 0].astype(np.uint64)
        two = np.ascontiguousarray(raw[:, 8:]).view("<u4")[:, 0].astype(np.uint64)
        order = np.lexsort((two >> np.uint64(1), one))
        same = np.ones(len(one), bool)
        same[1:] = (one[order][1:] != one[order][:-1]) | ((two >> np.uint64(1))[order][1:] != (two >> np.uint64(1))[order][:-1])
        run = np.cumsum(same) - 1
        n = int(same.sum())
        many = (np.bincount(run, minlength=n) > 1) | (np.bincount(run, (two[order] & np.uint64(1)).astype(np.float64), n) > 0)
        hit = np.zeros(len(one), bool)
        hit[order] = many[run]
        return _replies(table, source, hit, one.astype("<u8"))

    def finish(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _texts(table, nth)
        c = _Chunk(texts, window)
        gone = np.zeros(len(c.words), bool)
        if answers.num_rows:
            start, one = c.windows()
            gone = c.covered(start[_among(one, _unpack(answers, 8)[0].view("<u8")[:, 0])])
        total_gone = np.concatenate(([0], np.cumsum(gone)))
        n_removed = total_gone[c.last] - total_gone[c.first]
        kept = []
        for t, a, b, n in zip(texts, c.first.tolist(), c.last.tolist(), n_removed.tolist()):
            kept.append(b" ".join(compress(t.split(), (~gone[a:b]).tolist()) if n else t.split()))
        return pa.table({"row": table.column("row"), "n_words": pa.array(c.n_words), "n_removed": pa.array(n_removed),
                         "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    out = T.StructType([T.StructField("row", docs.schema), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                        T.StructField("kept", T.StringType())])
    if block * 2 - 1 > window or block < 1:
        raise ValueError("a window must hold a whole block")
    anchors = keyed.groupBy("chunk").applyInArrow(ask_anchors, sent).groupBy("bucket").applyInArrow(answer_anchors, back)
    windows = keyed.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(ask_windows, sent).groupBy("bucket").applyInArrow(answer_windows, back)
    return keyed.groupBy("chunk").cogroup(windows.groupBy("chunk")).applyInArrow(finish, out)


def without_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the words left as its texts; a text that loses nothing stays as it is."""
    got = remove_repeats(docs, text, window)
    return got.select(*[(F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row").getField(c)) if c == text else F.col("row").getField(c)).alias(c)
                        for c in docs.columns])
