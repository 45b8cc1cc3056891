"""Sharding by jump consistent hashing: no ring table, the least possible movement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.llm._common import cut, ranked, spread
from arrayloom.llm._words import mix

SHARDS = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key among ``shards``.

    Each key walks its own pseudo-random sequence of ever larger shard numbers and
    stays at the last one below ``shards``; with one more shard, a key either stays
    or jumps into the new one.
    """
    state = mix(keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    at = np.zeros(len(keys), dtype=np.int64)
    live = np.arange(len(keys))
    ahead = np.zeros(len(keys), dtype=np.int64)
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = ((at[live] + 1) * (2147483648.0 / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a long key, as a column; a null key counts as 0."""

    @F.pandas_udf("int")
    def pick(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return pick(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Columns key, size, text_crc32, law, shard, slot and grown_shard, a row per row.

    ``law`` is ``key``: the key and the number of shards alone decide, so repeated
    rows share a shard.  ``slot`` is the gapless rank in the shard by key, then by
    checksum and size, so ties are repeated rows only.  A null text has size 1 and
    checksum 0, a null key is placed as key 0 (and stays null); no rows give no rows.
    A long text counts whole.  The texts themselves are not shuffled, and other columns
    than key and text are not read.
    """
    rows = spread(docs).select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")).alias("_key"),
    )
    rows = rows.withColumn("shard", shard_of(F.col("_key"), shards)).withColumn("grown_shard", shard_of(F.col("_key"), shards + 1))
    rows = cut(rows)  # narrow, so that texts are read once
    out = ranked(rows, "shard", "_key", "slot", ["text_crc32", "size"])
    return out.select(key, "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
