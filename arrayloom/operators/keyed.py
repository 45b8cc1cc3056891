"""Keyed operators over ordinary tables: map, filter, join, group, reduce, sort."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partitions that a grid of pairs of blocks is dealt over at most.
MOST_PARTS = 2000
#: Rows and columns of a pair of blocks that are formed at once.
TILE = 500


def map_rows(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in columns.items()])


def flat_map(df: DataFrame, sequence: Column, name: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.explode(sequence).alias(name))


def map_blocks(df: DataFrame, f, schema: str) -> DataFrame:
    """f over batches of each partition, as pandas frames."""
    return df.mapInPandas(f, schema)


def map_blocks_indexed(df: DataFrame, block: Column, f, schema: str) -> DataFrame:
    """f(block, rows) over each logical block, whatever the physical partitions."""
    return df.withColumn("block", block).groupBy("block").applyInPandas(lambda key, rows: f(key[0], rows), schema)


def reduce_by_key(df: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    return df.groupBy(key).agg(*[c.alias(n) for n, c in aggregates.items()])


def salted_sum(df: DataFrame, key: str, value: Column, salts: int = 16) -> DataFrame:
    """A sum by key in two exchanges, so that no key's rows meet in one task at first."""
    part = df.groupBy(key, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("_salt")).agg(F.sum(value).alias("_s"))
    return part.groupBy(key).agg(F.sum("_s").alias("total"))


def group_by_key(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Each key's values as a sorted array; for keys of bounded groups."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))


def sort_by_key(df: DataFrame, *keys) -> DataFrame:
    return df.orderBy(*keys)


def join_by_key(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(K, V) with (K, W) to (K, V, W), inner; the planner picks the way by size."""
    return a.join(b, key)


def all_pairs(points: DataFrame, force, block_rows: int = 2000) -> DataFrame:
    """out[i] = sum over all j but i of force(x, xj, mj), by a grid of blocks of rows and of columns.

    ``points`` carry (i, x, m); ``force`` takes numpy arrays that fit together and returns
    the force of each pair, which is null where one of the three is.  A group holds a pair
    of blocks of about ``block_rows`` rows and forms it in tiles; partial sums are added by
    i.  The grid is dealt by exchange over as many partitions as it has pairs, up to
    MOST_PARTS, so that neither the planner's estimate nor the files of the input set the
    number of tasks.  The all-pairs problem is quadratic by its definition.
    """
    points = points.where("i is not null").select("i", F.col("x").cast("double").alias("x"), F.col("m").cast("double").alias("m"))
    blocks = max(1, -(-points.count() // block_rows))
    parts = min(blocks * blocks, MOST_PARTS)
    own, every = F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = points.select("i", "x", own.alias("_r"), every.alias("_c")).repartition(parts, "_r", "_c")
    # names of its own: Spark takes columns that both sides share for the left ones, and may drop them here
    right = points.select(F.col("i").alias("j"), F.col("x").alias("xj"), F.col("m").alias("mj"), own.alias("_c")).withColumn("_r", every).repartition(parts, "_r", "_c")
    tile = TILE

    def doubles(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        return column.is_valid().to_numpy(), column.fill_null(0.0).to_numpy()

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not (len(a) and len(b)):  # an empty side comes without columns
            return pa.table({"i": (a["i"] if len(a) else b["j"]).slice(0, 0), "v": pa.array([], pa.float64())})
        (has, x), (has_j, xj), (has_m, mj) = doubles(a["x"]), doubles(b["xj"]), doubles(b["mj"])
        met, used, total = (np.zeros(len(a), t) for t in (np.int64, np.int64, np.float64))
        known = has_j & has_m
        i, j = a["i"].to_numpy(), b["j"].to_numpy()
        for low in range(0, len(a), tile):
            rows = slice(low, low + tile)
            for start in range(0, len(b), tile):
                cols = slice(start, start + tile)
                with np.errstate(all="ignore"):
                    each = force(x[rows, None], xj[None, cols], mj[None, cols])
                take = known[cols]
                if key[0].as_py() == key[1].as_py():  # equal indices are in blocks of one number only
                    other = i[rows, None] != j[None, cols]
                    met[rows] += other.sum(1)
                    other &= take
                    used[rows] += other.sum(1)
                    total[rows] += np.where(other, each, 0.0).sum(1)
                else:
                    met[rows] += len(take)
                    used[rows] += take.sum()
                    total[rows] += (each if take.all() else np.where(take, each, 0.0)).sum(1)
        out = pa.table({"i": a["i"], "v": pa.array(total, mask=~(has & (used > 0)))})
        return out.filter(pa.array(met > 0))

    keys = ["_r", "_c"]
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"i {points.schema['i'].dataType.simpleString()}, v double")
    return sums.groupBy("i").agg(F.sum("v").alias("v"))
