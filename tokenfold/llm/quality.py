"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 512
OVERLAP = 64
WIDTH = 8
STRIDE = 2
FILTERS = 16
#: Labelled documents of each class, and chunks of each of them, that a model is fit on.
PER_CLASS = 1_000
CHUNKS_EACH = 8
_PAD = 256
_KINDS = 257  # bytes and padding; a second set of as many marks positions in a repetition
_PERIODS = range(2, 41)


@dataclass
class Network:
    """``tables[w][kind]``: what a byte at offset w adds to each filter (embedding times filter, folded)."""

    tables: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    offset: float

    def score(self, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """Probability of each document from its chunks ``kinds[start:end]``."""
        pooled = np.concatenate([_pool(_layout(kinds, starts[a:a + 256], ends[a:a + 256]), self.tables, self.bias)[0] for a in range(0, len(starts), 256)])
        pooled = np.maximum(pooled, 0)
        first = np.searchsorted(doc, np.arange(docs))
        mean = np.add.reduceat(pooled, first, axis=0) / np.bincount(doc, minlength=docs)[:, None]
        return _sigmoid(np.concatenate([mean, np.maximum.reduceat(pooled, first, axis=0)], axis=1) @ self.head + self.offset)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """Bytes, with ``_KINDS`` added where the 16 bytes up to here repeat with a period of at most 40."""
    mark = np.zeros(len(data), bool)
    for d in _PERIODS:
        if len(data) < d + 16:
            break
        run = data[d:] == data[:-d]
        for step in (1, 2, 4, 8):
            run = run[step:] & run[:-step]
        mark[d + 15:] |= run
    return data.astype(np.int16) + mark.astype(np.int16) * np.int16(_KINDS)


def chunk_spans(sizes: np.ndarray, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of overlapping chunks over documents that stand side by side; an empty one has an empty chunk."""
    step = chunk - overlap
    each = np.maximum(1, -(-(sizes - overlap) // step))
    doc = np.repeat(np.arange(len(sizes)), each)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)) * step
    begin = np.repeat(np.cumsum(sizes) - sizes, each)
    return begin + at, begin + np.minimum(at + chunk, np.repeat(sizes, each)), doc


def _layout(kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Chunks as rows of one length, padded."""
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < ends[:, None]
    if not len(kinds):
        return np.full(at.shape, _PAD, np.int16)
    return np.where(inside, kinds[np.minimum(at, len(kinds) - 1)], np.int16(_PAD))


def _pool(rows: np.ndarray, tables: np.ndarray, bias: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(greatest response of each filter in each chunk, its position)."""
    spots = (CHUNK - WIDTH) // STRIDE + 1
    total = np.empty((len(rows), spots, tables.shape[2]), np.float32)
    part = np.empty_like(total)
    for w in range(WIDTH):
        own = np.ascontiguousarray(rows[:, w:w + STRIDE * (spots - 1) + 1:STRIDE])
        np.take(tables[w], own, axis=0, out=total if w == 0 else part, mode="clip")
        if w:
            total += part
    at = total.argmax(axis=1) if where else None
    return (total.max(axis=1) if at is None else np.take_along_axis(total, at[:, None, :], axis=1)[:, 0]) + bias, at


def fit(rows: np.ndarray, doc: np.ndarray, label: np.ndarray, steps: int = 250, batch: int = 64, rate: float = 0.01, size: int = 8, seed: int = 7) -> Network:
    """Learn embedding, filters and head from chunks ``rows`` of labelled documents (Adam on the log loss).

    Only the position that wins the max-pooling passes a gradient on.
    """
    rng = np.random.default_rng(seed)
    p = {"e": rng.normal(0, 0.5, (_KINDS, size)), "u": rng.normal(0, 0.5, size), "k": rng.normal(0, 0.3, (WIDTH, size, FILTERS)), "b": np.zeros(FILTERS),
         "v": rng.normal(0, 0.1, 2 * FILTERS), "c": np.zeros(1)}
    p = {n: x.astype(np.float32) for n, x in p.items()}
    m1, m2 = ({n: np.zeros_like(x) for n, x in p.items()} for _ in range(2))
    first, last = np.searchsorted(doc, np.arange(len(label))), np.searchsorted(doc, np.arange(len(label)), side="right")
    weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9))
    step = 0
    while step < steps:
        order = rng.permutation(len(label))
        for at in range(0, len(order), batch):
            own = order[at:at + batch]
            take = np.concatenate([np.arange(first[i], last[i]) for i in own])
            each = last[own] - first[own]
            begin, who = np.cumsum(each) - each, np.repeat(np.arange(len(own)), each)
            kinds = np.concatenate([p["e"], p["e"] + p["u"]])
            tables = np.einsum("ne,wef->wnf", kinds, p["k"])
            x = rows[take]
            top, spot = _pool(x, tables, p["b"], where=True)
            z = np.maximum(top, 0)
            mean, high = np.add.reduceat(z, begin, axis=0) / each[:, None], np.maximum.reduceat(z, begin, axis=0)
            doc_vector = np.concatenate([mean, high], axis=1)
            err = ((_sigmoid(doc_vector @ p["v"] + p["c"][0]) - label[own]) * weight[own] / len(own)).astype(np.float32)
            back = err[:, None] * p["v"]
            dz = back[who, :FILTERS] / each[who, None] + back[who, FILTERS:] * (z == high[who])
            dz *= top > 0
            g = {"v": doc_vector.T @ err + 1e-4 * p["v"], "c": np.array([err.sum()]), "b": dz.sum(axis=0), "k": np.empty_like(p["k"])}
            de = np.zeros_like(kinds)
            for w in range(WIDTH):
                kind = np.take_along_axis(x, spot * STRIDE + w, axis=1)
                g["k"][w] = np.einsum("cf,cfe->ef", dz, kinds[kind])
                np.add.at(de, kind, dz[:, :, None] * p["k"][w].T[None])
            g["e"], g["u"] = de[:_KINDS] + de[_KINDS:], de[_KINDS:].sum(axis=0)
            step += 1
            for n in p:
                m1[n] = 0.9 * m1[n] + 0.1 * g[n]
                m2[n] = 0.99 * m2[n] + 0.01 * g[n] ** 2
                p[n] -= (rate * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    kinds = np.concatenate([p["e"], p["e"] + p["u"]])
    return Network(np.einsum("ne,wef->wnf", kinds, p["k"]).astype(np.float32), p["b"], p["v"], float(p["c"][0]))


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether the CRC of an id, as text, falls into ``part``; a null id does not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, ones: int, zeros: int, key: str = "doc_id") -> DataFrame:
    """Documents with a label where ``usable`` holds, at most ``ones`` and ``zeros`` of a class in hash order: (doc_id, label, columns)."""
    one = labels.where(usable & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    order = F.xxhash64(F.lit("sample"), "_key")
    taken = one.where("_label = 1").orderBy(order, "_key").limit(ones).unionByName(one.where("_label = 0").orderBy(order, "_key").limit(zeros))
    return docs.join(F.broadcast(taken), docs[key] == F.col("_key")).drop("_key")  # as many rows as the two bounds


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", key: str = "doc_id", text: str = "text",
          per_class: int = PER_CLASS, chunks_each: int = CHUNKS_EACH) -> Network | float:
    """A network from at most ``per_class`` documents of each class; a constant score if a class has no rows.

    Of a training document at most ``chunks_each`` chunks, at seeded random
    places over the whole text, come to the driver.
    """
    sample = labelled_sample(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), labels, label, usable, per_class, per_class)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, value, own in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                data = (value.as_py() or "").encode()
                kinds = byte_kinds(np.frombuffer(data, np.uint8))
                start, end, _ = chunk_spans(np.array([len(kinds)]))
                few = np.random.default_rng(doc % (1 << 32)).permutation(len(start))[:chunks_each]
                out = [kinds[start[i]:end[i]].astype("<i2").tobytes() for i in np.sort(few)]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(out), pa.int64()), pa.array([own] * len(out), pa.int32()), pa.array(out, pa.binary())],
                                                 names=["doc_id", "label", "kinds"])

    got = sample.select(F.col("doc_id").cast("long"), "text", "_label").mapInArrow(chunks, "doc_id long, label int, kinds binary").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("kinds", "ascending")])
    ids, doc = np.unique(got.column("doc_id").to_numpy(), return_inverse=True)
    label_ = np.zeros(len(ids), np.int64)
    label_[doc] = got.column("label").to_numpy()
    if len(set(label_.tolist())) < 2:
        return float((label_.sum() + 1) / (len(label_) + 2))
    rows = np.full((len(doc), CHUNK), _PAD, np.int16)
    for i, x in enumerate(got.column("kinds")):
        one = np.frombuffer(x.as_buffer(), "<i2")
        rows[i, :len(one)] = one
    return fit(rows, doc, label_)


def scored(docs: DataFrame, network: Network | float, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of every whole text as column ``name``.

    Overlapping chunks cover the text; filter responses are max-pooled in each
    chunk, mean and maximum over the chunks make the document's vector. Defined
    cases: a null text counts as empty, an empty one is a chunk of padding;
    equal texts score alike; an empty table gives no rows.
    """
    from pyspark.sql import types as T

    nth = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty(b.num_rows)
            texts = b.column(nth).cast(pa.large_binary())
            at = 0
            while at < b.num_rows:
                data, held = [], 0
                while at + len(data) < b.num_rows and held < 1 << 20:
                    data.append(texts[at + len(data)].as_py() or b"")
                    held += len(data[-1])
                out[at:at + len(data)] = _score_texts(network, data)
                at += len(data)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def _score_texts(network: Network | float, texts: list[bytes]) -> np.ndarray:
    if isinstance(network, float):
        return np.full(len(texts), network)
    kinds = np.concatenate([byte_kinds(np.frombuffer(t, np.uint8)) for t in texts])
    start, end, doc = chunk_spans(np.fromiter(map(len, texts), np.int64, len(texts)))
    return network.score(kinds, start, end, doc, len(texts))
