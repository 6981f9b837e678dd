"""Shards by jump consistent hashing of a stable key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgrid.llm.common import running, text_bytes
from snapgrid.session import stage_table

#: Multiplier of the generator, and bytes that a row takes beside its text.
MULTIPLIER, ROW_BYTES = 2862933555777941757, 16


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; one more shard takes keys only into itself."""
    keys = keys.astype(np.uint64)
    shard, ahead = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.float64)
    open_ = np.arange(len(keys))
    while len(open_):
        shard[open_] = ahead[open_].astype(np.int64)
        keys[open_] = keys[open_] * np.uint64(MULTIPLIER) + np.uint64(1)
        draw = (keys[open_] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[open_] = np.floor((shard[open_] + 1) * (float(1 << 31) / draw))
        open_ = open_[ahead[open_] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a long column; a missing key counts as 0."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return jump(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def assign(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", bucket_rows: int = 20_000) -> DataFrame:
    """``key``, size, text_crc32, shard, grown_shard and slot of every row.

    Only the key and the number of shards decide. grown_shard is the shard if there were
    one more. Slots count a shard's rows from 0 without a gap, in an order by key hash,
    key, checksum and size; equal rows are told apart by slot alone. A null text has no
    bytes and the checksum of an empty one; rows with equal keys share a shard. The text
    is read once and never shuffled.
    """
    slim = docs.select(
        F.col(key),
        (text_bytes(text) + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        F.xxhash64(key).alias("h"),
    )
    total = docs.select(key).count()
    buckets = max(1, min(65_536, total // bucket_rows))
    dealt = slim.withColumns({"shard": shard_of(F.col(key), shards), "grown_shard": shard_of(F.col(key), shards + 1)})
    # A key that repeats without end is dealt on by checksum.
    bucket = F.shiftrightunsigned(F.shiftrightunsigned("h", 48) * buckets, 16) * 16 + F.col("text_crc32") % 16
    dealt = stage_table(dealt, "shards")
    return running(dealt, "shard", ["h", key, "text_crc32", "size"], F.lit(1), bucket, "slot").drop("h")
