"""Distributions: owner tables of blocks, and their transforms.

A table of blocks is (p, first, size) with a row per block.  It is as small as the
number of processes, a setting of the driver, so window functions over it are cheap;
only :func:`overlapping` and :func:`owner` know tables that grow with the array.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrayloom.functions import index as ix
from arrayloom.operators.sets import CHUNK


def blocks(spark: SparkSession, bounds: list[int]) -> DataFrame:
    rows = [(p, a, b - a) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
    return spark.createDataFrame(rows, "p long, first long, size long")


def orthogonal(spark: SparkSession, n: int, p: int) -> DataFrame:
    return blocks(spark, ix.split_points(n, p))


def from_sizes(sizes: DataFrame) -> DataFrame:
    """Blocks from local sizes (p, size), packed back to back in process order."""
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long")).select("p", "first", "size")


def overlapping(array: DataFrame, step: int, size: int) -> DataFrame:
    """Blocks of ``size`` from every ``step``-th index on, up to the last index of the array."""
    last = array.agg(F.max("i").alias("_last")).where("_last >= 0")
    starts = last.select(F.explode(F.sequence(F.lit(0).cast("long"), ix.floor_div(F.col("_last"), step * CHUNK))).alias("_chunk"), "_last")
    p = F.explode(F.sequence(F.col("_chunk") * CHUNK, F.least(F.col("_chunk") * CHUNK + (CHUNK - 1), ix.floor_div(F.col("_last"), step))))
    return starts.select(p.alias("p")).select("p", (F.col("p") * step).alias("first"), F.lit(size).cast("long").alias("size"))


def owner(array: DataFrame, table: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Add p, the first block that holds each index; blocks may overlap.

    Indices that no block holds are left out.  The table may be as long as the array:
    blocks are cut at chunks of indices, whole chunks meet the array by chunk and the
    rest by index, so nothing is broadcast and no block is tried against all indices.
    """
    ends = table.where("size > 0").select("p", "first", (F.col("first") + F.col("size") - 1).alias("last"))
    cuts = ends.select("p", "first", "last", F.explode(F.sequence(ix.floor_div(F.col("first"), chunk), ix.floor_div(F.col("last"), chunk))).alias("_chunk"))
    low, high = F.greatest("first", F.col("_chunk") * chunk), F.least("last", F.col("_chunk") * chunk + (chunk - 1))
    cuts = cuts.select("p", "_chunk", low.alias("low"), high.alias("high")).withColumn("_all", F.col("high") - F.col("low") + 1 == chunk)
    whole = cuts.where("_all").groupBy("_chunk").agg(F.min("p").alias("_whole"))
    part = cuts.where("not _all").select("p", F.explode(F.sequence("low", "high")).alias("i")).groupBy("i").agg(F.min("p").alias("_part"))
    rows = array.withColumn("_chunk", ix.floor_div(F.col("i"), chunk)).join(whole, "_chunk", "left").join(part, "i", "left")
    return rows.select(*array.columns, F.least("_whole", "_part").alias("p")).where("p IS NOT NULL")


def from_lists(array: DataFrame, lists: DataFrame) -> DataFrame:
    """Add p to (i, ...), the least block whose explicit list (p, i) holds the index."""
    return array.join(lists.groupBy("i").agg(F.min("p").alias("p")), "i")


def from_function(spark: SparkSession, blocks_: int, size: int, f) -> DataFrame:
    """Owners (p, i) with i = f(p, k) for k below ``size``; blocks may overlap."""
    rows = spark.range(blocks_).select(F.col("id").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))).alias("_k"))
    return rows.select("p", f(F.col("p"), F.col("_k")).cast("long").alias("i")).distinct()


def operate(owners: DataFrame, f) -> DataFrame:
    """Each block's indices under an index map: rows (p, i, ...) with i = f(i)."""
    return owners.withColumn("i", f(F.col("i")))


def operate_blocks(owners: DataFrame, f, n: int) -> DataFrame:
    """Each block's indices under a map to several, clipped to [0, n): distinct rows (p, i)."""
    rows = owners.select("p", F.explode(f(F.col("i"))).alias("i")).where((F.col("i") >= 0) & (F.col("i") < n))
    return rows.distinct()


def operate_base(indices: DataFrame, f, n: int, p: int) -> DataFrame:
    """The whole range under a map into [0, n), split anew into ``p`` even blocks: rows (p, i)."""
    base = indices.select(f(F.col("i")).alias("i")).distinct()
    return base.select(ix.block(F.col("i"), n, p).alias("p"), "i")


def sigma(owners: DataFrame, f) -> DataFrame:
    """A distribution from a distribution by a function from frame to frame; doubles are dropped."""
    return f(owners).select("p", "i").distinct()


def over_decompose(array: DataFrame, n: int, processes: int, domains: int) -> DataFrame:
    """Add domain and p: ``domains`` even blocks for each of ``processes``."""
    domain = ix.block(F.col("i"), n, processes * domains)
    return array.withColumn("domain", domain).withColumn("p", ix.floor_div(domain, domains))


def rebound(array: DataFrame, bounds: list[int]) -> DataFrame:
    """Add p, the block of each index for the inner ``bounds`` of blocks, a setting of the driver."""
    block = F.lit(0)
    for b in bounds:
        block = block + (F.col("i") >= b).cast("int")
    return array.withColumn("p", block.cast("long"))


def smooth_table(table: DataFrame) -> DataFrame:
    """(p, load): three-point averages of the loads of neighbouring blocks; at the ends, of two."""
    order = Window.orderBy("p")
    return table.select("p", F.avg("load").over(order.rowsBetween(-1, 1)).alias("load"))


def task_graph(spark: SparkSession, blocks_: int, steps: int) -> DataFrame:
    """(step, p, needs): a stencil's tasks, leveled by step, and how many tasks each waits for."""
    rows = spark.range(steps * blocks_).select(ix.floor_div(F.col("id"), blocks_).alias("step"), F.pmod(F.col("id"), F.lit(blocks_)).alias("p"))
    inner = 3 - (F.col("p") == 0).cast("int") - (F.col("p") == blocks_ - 1).cast("int")
    return rows.select("step", "p", F.when(F.col("step") == 0, 0).otherwise(inner).alias("needs"))


def avoidance_cost(blocks_: int, size: int, steps: int, halo: int) -> dict[str, int]:
    """Messages and points of a 1-D stencil with messages every ``halo`` steps, against every step."""
    rounds = -(-steps // halo)
    per_round = [min(halo, steps - r * halo) for r in range(rounds)]
    more = sum(2 * (blocks_ - 1) * sum(range(h)) for h in per_round)
    return {"messages": 2 * (blocks_ - 1) * rounds, "plain": 2 * (blocks_ - 1) * steps, "points": blocks_ * size * steps + more, "plain_points": blocks_ * size * steps}


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (p, i) of the indices that a process has in either of two distributions."""
    return a.select("p", "i").union(b.select("p", "i")).distinct()


def extend(owners: DataFrame, p: int, more: DataFrame) -> DataFrame:
    """Rows (p, i) with the indices of ``more`` added to the block of one process."""
    return union(owners, more.select(F.lit(p).cast("long").alias("p"), "i"))


def infer_type(owners: DataFrame) -> DataFrame:
    """One row, kind: contiguous, blocked or general, from rows (p, i)."""
    parts = owners.groupBy("p").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("n"))
    prior = F.lag("last").over(Window.orderBy("p"))
    parts = parts.withColumn("whole", F.col("last") - F.col("first") + 1 == F.col("n")).withColumn("next", F.coalesce(prior + 1 == F.col("first"), F.lit(True)))
    got = parts.agg(F.min("whole").alias("w"), F.min("next").alias("x"))
    return got.select(F.when(F.col("w") & F.col("x"), "contiguous").when(F.col("w"), "blocked").otherwise("general").alias("kind"))


def stretch(sizes: list[int], total: int) -> list[int]:
    """Sizes rescaled to an exact total, none below one.

    What rounding leaves over is dealt evenly; what is missing comes off the largest.
    """
    have, n = sum(sizes), len(sizes)
    out = [max(1, s * total // have) for s in sizes]
    rest = total - sum(out)
    if rest > 0:
        out = [s + (k + 1) * rest // n - k * rest // n for k, s in enumerate(out)]
    while rest < 0:
        out[out.index(max(out))] -= 1
        rest += 1
    return out


def smooth(sizes: list[float], work: list[float]) -> list[float]:
    """Three-point averages of the load of neighbours; at the ends, of two."""
    load = [s * w for s, w in zip(sizes, work, strict=True)]
    return [sum(part) / len(part) for k in range(len(load)) for part in [load[max(0, k - 1) : k + 2]]]


def adjacency(shape: list[int]) -> np.ndarray:
    """The incidence matrix of a process grid: a row per neighbouring pair, +1 and -1."""
    grid, rows = np.arange(int(np.prod(shape))).reshape(shape), []
    for axis in range(len(shape)):
        a, b = np.moveaxis(grid, axis, 0)[:-1].ravel(), np.moveaxis(grid, axis, 0)[1:].ravel()
        for x, y in zip(a, b, strict=True):
            row = np.zeros(grid.size)
            row[x], row[y] = 1.0, -1.0
            rows.append(row)
    return np.array(rows).reshape(-1, grid.size)


def diffuse(sizes: list[int], load: list[float]) -> list[int]:
    """Sizes after moving each border by half the least-squares flow of load.

    The flows T over neighbouring pairs solve A'T = load - mean; a border moves by T/2
    over the load per element of the giving side, and every block keeps an element.
    """
    n, mean = len(sizes), sum(load) / len(sizes)
    if n == 1:
        return list(sizes)
    flow = np.linalg.lstsq(adjacency([n]).T, np.array(load) - mean, rcond=None)[0]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    for k, t in enumerate(flow):
        giver = k if t > 0 else k + 1
        bounds[k + 1] -= int(round(t / 2 / max(load[giver] / sizes[giver], 1e-12)))
    for k in range(1, n):
        bounds[k] = min(max(bounds[k], bounds[k - 1] + 1), bounds[-1] - (n - k))
    return np.diff(bounds).astype(int).tolist()


def balance(sizes: list[int], work, steps: int) -> list[list[int]]:
    """The sizes after each of ``steps`` rounds; ``work(step, first, size)`` is a load."""
    out = [list(sizes)]
    for step in range(steps):
        firsts = np.concatenate(([0], np.cumsum(out[-1])[:-1])).tolist()
        out.append(diffuse(out[-1], [work(step, a, s) for a, s in zip(firsts, out[-1], strict=True)]))
    return out
