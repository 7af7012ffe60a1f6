"""Best-fit packing of tokenized documents with large-item matching."""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenfold.llm.common import numbered
from tokenfold.session import settle

CAPACITY = 2048
END_ID = 0
#: Characters whose letter, number and blank classes every regex engine shares.
PLAIN = "\t\n\r -~¡-ɏ"
#: Pre-tokens of a byte-level vocabulary (public pattern, as in the tokenizer files' description).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids (little-endian unsigned 32-bit bytes) of whole texts by a tokenizer file.

    A byte-level BPE file whose merges stand in id order is a table of ranks;
    texts of ``PLAIN`` characters without an added token go through the faster
    reader of such tables, which gives the same ids. All others go to the file's
    own tokenizer. Long texts are worked on in cuts before a single space between
    two non-blanks, which no pre-token spans.
    """

    def __init__(self, path: str, cut: int = 1 << 18):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.other = re.compile(f"[^{PLAIN}]")
        self.space = re.compile(r"(?<=\S) (?=\S)")
        self.cut, self.ranked = cut, _ranked(path)

    def ids(self, text: str) -> bytes:
        out, at = [], 0
        plain = self.ranked and not self.other.search(text) and not any(t in text for t in self.added)
        while at < len(text):
            end = len(text)
            if end - at > 2 * self.cut and (m := self.space.search(text, at + self.cut)):
                end = m.start()
            part = text[at:end]
            ids = self.ranked.encode_ordinary(part) if plain else self.tokenizer.encode(part, add_special_tokens=False).ids
            out.append(np.array(ids, "<u4").tobytes())
            at = end
        return b"".join(out)


def _ranked(path: str):
    """The file as a table of ranks, or None if it is not a plain byte-level BPE with merges in id order."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if [model["vocab"][a + b] for a, b in merged] != list(range(256, 256 + len(merged))):
        return None
    added = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in word): i for word, i in model["vocab"].items() if word not in added}
    return tiktoken.Encoding("ranked", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids of every whole document: (doc_id, piece, start, length, ids).

    A document is its token ids and ``end_id``. Only longer ones are cut, so that
    every piece but the first is full. Defined cases: a null text counts as
    empty and gives the end id alone; repeated rows give pieces each; null keys
    stay null; an empty table gives no rows; other columns are not read.
    """
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, held = [], 0
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.ids(value.as_py() or "") + end
                n = len(ids) // 4
                pieces = -(-n // capacity)
                start = 0
                for p in range(pieces):
                    stop = n - (pieces - 1 - p) * capacity
                    rows.append((doc, p, start, stop - start, ids[4 * start:4 * stop]))
                    start = stop
                held += len(ids)
                if held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Places for ``counts[length]`` items of every length, as steps (length, first, items, sequence, per, offset).

    Step: the items ``first`` to ``first + items - 1`` of a length go, ``per`` to
    each, to the sequences from ``sequence`` on, from ``offset`` on. Items above a
    third of the capacity come first, longest first, each with the longest left
    that still fits beside it (two at most). Shorter ones follow, longest first,
    into the smallest gap that takes them, else into a new sequence. Works on
    runs of equal sequences: the effort depends on the capacity, not the rows.
    """
    left = {n: c for n, c in counts.items() if c}
    taken = dict.fromkeys(left, 0)
    steps: list[tuple[int, ...]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_gaps: list[int] = []
    bins = 0

    def put(size: int, items: int, first_bin: int, per: int, offset: int) -> None:
        steps.append((size, taken[size], items, first_bin, per, offset))
        taken[size] += items
        left[size] -= items

    def free(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((first, n))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        for b in large:
            if not left[a]:
                break
            if b > a or a + b > capacity or not left[b]:
                continue
            pairs = left[a] // 2 if a == b else min(left[a], left[b])
            if not pairs:
                continue
            if a == b:
                put(a, 2 * pairs, bins, 2, 0)
            else:
                put(a, pairs, bins, 1, 0)
                put(b, pairs, bins, 1, a)
            free(capacity - a - b, bins, pairs)
            bins += pairs
        if n := left[a]:
            put(a, n, bins, 1, 0)
            free(capacity - a, bins, n)
            bins += n
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(open_gaps, s)
            if at == len(open_gaps):
                new = -(-left[s] // (capacity // s))
                free(capacity, bins, new)
                bins += new
                continue
            gap = open_gaps[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], open_gaps[at]
            per = gap // s
            if full := min(n, left[s] // per):
                put(s, full * per, first, per, capacity - gap)
                free(gap - per * s, first, full)
                first, n = first + full, n - full
            if n and (rest := left[s]) and rest < per:
                put(s, rest, first, rest, capacity - gap)
                free(gap - rest * s, first, 1)
                first, n = first + 1, n - 1
            free(gap, first, n)
    return np.array(sorted(steps), np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (gapless from 0) to rows with a ``length`` of 1 to ``capacity``.

    The plan needs only how many pieces have each length (at most ``capacity``
    numbers). A piece finds its place by its number among those of its length,
    so no task holds more than a slice of the pieces. ``pieces`` is read more
    than once: pass a settled table. Equal pieces may swap places. Defined
    cases: an empty table gives no rows; null keys and repeated rows are pieces
    like any other; a length outside 1 to ``capacity`` raises an error.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must be 1 to {capacity}")
    spark = pieces.sparkSession
    if not counts:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    steps = spark.sparkContext.broadcast(plan_sequences(counts, capacity))  # bounded by the capacity
    row = numbered(pieces, ["length"], [*order, *[c for c in pieces.columns if c not in order]], sum(counts.values()), "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = steps.value
        first = (plan[:, 0] << 44) + plan[:, 1]
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            step = plan[np.searchsorted(first, (size << 44) + rank, side="right") - 1]
            nth = rank - step[:, 1]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(step[:, 3] + nth // step[:, 4]), pa.array(step[:, 5] + nth % step[:, 4] * size)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return row.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their digests and places."""
    cut = token_pieces(docs, tokenizer, capacity)
    digest = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(settle(digest), capacity)
