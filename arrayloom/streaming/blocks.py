"""Block reductions of an array that arrives as a stream of rows (i, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.functions.index import floor_div


def running_norms(stream: DataFrame, block_size: int) -> DataFrame:
    """(p, total, norm_squared, n) by block of neighbours; state is a row per block."""
    v = F.col("v")
    return stream.groupBy(floor_div(F.col("i"), block_size).alias("p")).agg(F.sum(v).alias("total"), F.sum(v * v).alias("norm_squared"), F.count(F.lit(1)).alias("n"))
