"""Jump consistent hashing of keyed rows to shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tokenfold.llm.common import numbered
from tokenfold.session import settle


def jump_shards(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, after Lamping and Veach (2014).

    A key jumps from one shard count at which it moves to the next until the
    next jump lies beyond ``shards``; about ln(shards) steps, no ring table.
    """
    key = keys.astype(np.uint64).copy()
    at = np.full(len(key), -1, np.int64)
    to = np.zeros(len(key), np.int64)
    open_ = np.arange(len(key))
    while len(open_):
        at[open_] = to[open_]
        key[open_] = key[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        step = np.float64(1 << 31) / ((key[open_] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        to[open_] = np.minimum((at[open_] + 1) * step, shards).astype(np.int64)
        open_ = open_[to[open_] < shards]
    return at


def jump(key: Column, shards: int) -> Column:
    """Shard (int, from 0) that ``key`` and the shard count decide; nulls share one shard."""

    @pandas_udf("int")
    def place(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump_shards(hashed.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return place(F.xxhash64(key))


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """Place every row by its key: (key, size, text_crc32, law, shard, slot, grown_shard).

    The law is ``key``: the key and the shard count alone decide, and with one
    shard more a row stays or goes to the new shard (``grown_shard``). ``size``
    is the UTF-8 length plus ``overhead``. ``slot`` numbers the rows of a shard
    without gaps. Defined cases: a null text counts as empty (crc 0); null keys
    share a shard; rows with equal keys share a shard and have slots of their
    own; an empty table gives no rows; other columns are not read.
    """
    row = docs.select(
        F.col(key).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = settle(row.select("*", jump(F.col("doc_id"), shards).alias("shard"), jump(F.col("doc_id"), shards + 1).alias("grown_shard")))
    out = numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"], placed.count(), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard")
