"""Sparse matrices as rows (i, j, v)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.plans.sizes import small

#: Copies of a vector that is too large for a broadcast.
SALTS = 8


def build(entries: DataFrame) -> DataFrame:
    """Entries from anywhere, those of one place added."""
    return entries.groupBy("i", "j").agg(F.sum("v").alias("v"))


def row_sums(a: DataFrame) -> DataFrame:
    return a.groupBy("i").agg(F.sum("v").alias("v"))


def columns(a: DataFrame) -> DataFrame:
    """The inputs that a product needs."""
    return a.select("j").distinct()


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def repeat(a: DataFrame, times: int) -> DataFrame:
    """``a`` added ``times`` times to nothing, place by place.

    ``a`` has one entry a place (see :func:`build`), as have its transposes; so each sum
    is formed in the row of its entry, and nothing is exchanged.
    """
    return a.withColumn("v", reduce(lambda total, v: total + v, [F.col("v")] * times))


def multiply(a: DataFrame, x: DataFrame) -> DataFrame:
    """out[i] = sum of a[i,j] * x[j]; rows without entries are absent.

    A small vector goes to the entries, so that only partial sums are exchanged.  A
    larger one is copied SALTS times and a column's entries are dealt over the copies by
    their row, so that a full column is no single task's; the same deal serves each
    product of an iteration.  The copies are merged with the entries by exchange: the
    planner's estimate knows nothing of the copies and would broadcast them.
    """
    right = x.select(F.col("i").alias("j"), F.col("v").alias("_x"))
    if small(right):
        both = a.join(F.broadcast(right), "j")
    else:
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = a.withColumn("_salt", F.pmod(F.xxhash64("i"), F.lit(SALTS)).cast("int")).join(right.hint("merge"), ["j", "_salt"])
    return both.groupBy("i").agg(F.sum(F.col("v") * F.col("_x")).alias("v"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The matrix product."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("_j"), F.col("v").alias("_v"))
    both = a.withColumnRenamed("j", "k").join(right, "k")
    return both.groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("v") * F.col("_v")).alias("v"))
