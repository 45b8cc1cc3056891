"""Transfers between the elements and nodes of a structured mesh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.functions.index import floor_div


def element_to_local(x: DataFrame, coords: list[str]) -> DataFrame:
    """Each element on its 2^d local nodes."""
    for c in coords:
        x = x.withColumn(c, F.explode(F.array(2 * F.col(c), 2 * F.col(c) + 1)))
    return x


def local_to_global(x: DataFrame, coords: list[str]) -> DataFrame:
    """Local nodes 2i-1 and 2i add up in global node i, in every dimension."""
    return x.groupBy(*[floor_div(F.col(c) + 1, 2).alias(c) for c in coords]).agg(F.sum("v").alias("v"))


def global_to_local(x: DataFrame, coords: list[str], elements: list[int]) -> DataFrame:
    """Global node i on local nodes 2i-1 and 2i, as far as elements have them."""
    for c, n in zip(coords, elements, strict=True):
        x = x.withColumn(c, F.explode(F.array(2 * F.col(c) - 1, 2 * F.col(c)))).where((F.col(c) >= 0) & (F.col(c) < 2 * n))
    return x


def local_to_element(x: DataFrame, coords: list[str]) -> DataFrame:
    """The mean of the local nodes of each element."""
    return x.groupBy(*[floor_div(F.col(c), 2).alias(c) for c in coords]).agg(F.avg("v").alias("v"))


def exchange(x: DataFrame, coords: list[str], elements: list[int]) -> DataFrame:
    """Elements to nodes and back: all four transfers in a row."""
    nodes = local_to_global(element_to_local(x, coords), coords)
    return local_to_element(global_to_local(nodes, coords, elements), coords)


def element_to_pairs(x: DataFrame) -> DataFrame:
    """In one dimension with two components a node: element e on its local entries 4e to 4e+3."""
    return x.select(F.explode(F.array(*[4 * F.col("i") + k for k in range(4)])).alias("i"), "v")


def pairs_to_global(x: DataFrame) -> DataFrame:
    """Local entries two apart add up: entries 4e-2+m and 4e+m are component m of node e, at 2e+m."""
    i = F.col("i")
    node = floor_div(i, 4) + (F.pmod(i, F.lit(4)) >= 2).cast("long")
    return x.groupBy((2 * node + F.pmod(i, F.lit(2))).alias("i")).agg(F.sum("v").alias("v"))


def global_to_element(x: DataFrame, elements: int) -> DataFrame:
    """Element e is the sum of the global entries 2e to 2e+3 of its two nodes."""
    node = floor_div(F.col("i"), 2)
    rows = x.select(F.explode(F.array(node - 1, node)).alias("i"), "v").where((F.col("i") >= 0) & (F.col("i") < elements))
    return rows.groupBy("i").agg(F.sum("v").alias("v"))


def fourth_order(x: DataFrame, elements: int) -> DataFrame:
    """The element to node to element pipeline of one dimension."""
    return global_to_element(pairs_to_global(element_to_pairs(x)), elements)
