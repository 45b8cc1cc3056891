"""Index sets: DataFrames of distinct indices, and their algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.functions.index import floor_div

#: Indices of so many neighbours are numbered or summed in one task.
CHUNK = 1 << 16


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b.select(a.columns)).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(a.columns), a.columns, "left_semi").distinct()


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(a.columns), a.columns, "left_anti").distinct()


def relation(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: has_intersect, disjoint, contains (b in a) and equals."""
    both = a.distinct().withColumn("_a", F.lit(1)).join(b.select(a.columns).distinct().withColumn("_b", F.lit(1)), a.columns, "full")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    got = both.agg(count(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("ab"), count(F.col("_b").isNull()).alias("a"), count(F.col("_a").isNull()).alias("b"))
    return got.select((F.col("ab") > 0).alias("has_intersect"), (F.col("ab") == 0).alias("disjoint"), (F.col("b") == 0).alias("contains"), ((F.col("a") == 0) & (F.col("b") == 0)).alias("equals"))


def split(a: DataFrame, cut: int) -> tuple[DataFrame, DataFrame]:
    return a.where(F.col("i") < cut), a.where(F.col("i") >= cut)


def truncate(a: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    a = a if low is None else a.where(F.col("i") >= low)
    return a if high is None else a.where(F.col("i") <= high)


def _before(totals: DataFrame, value: str, name: str, f=F.sum) -> DataFrame:
    """Add ``name``, f over ``value`` of all chunks before each; null before the first.

    Chunks are grouped again, and only the totals of groups stand in one task: a row
    for each 2**32 indices of a dense set.
    """
    group = floor_div(F.col("_chunk"), CHUNK)
    rows = totals.withColumn("_group", group)
    above = rows.groupBy("_group").agg(f(value).alias("_all"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    above = above.select("_group", f("_all").over(earlier(Window.orderBy("_group"))).alias("_up"))
    rows = rows.withColumn("_in", f(value).over(earlier(Window.partitionBy("_group").orderBy("_chunk")))).join(above, "_group")
    both = F.array(F.col("_up"), F.col("_in"))
    joined = F.coalesce(F.col("_up") + F.col("_in"), "_up", "_in") if f is F.sum else F.array_max(both)
    return rows.withColumn(name, joined).drop("_group", "_in", "_up")


def _chunks(a: DataFrame, chunk: int) -> DataFrame:
    return a.withColumn("_chunk", floor_div(F.col("i"), chunk))


def rank(a: DataFrame, name: str = "rank", chunk: int = CHUNK) -> DataFrame:
    """Add each index's place in its set, counted from 0.

    Indices are numbered inside chunks of neighbours; the counts of earlier chunks, a
    table ``chunk`` times smaller than the range of indices, are added by a join.
    """
    rows = _chunks(a, chunk)
    counts = _before(rows.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n")), "_n", "_before").select("_chunk", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_chunk").orderBy("i")
    rows = rows.withColumn("_row", F.row_number().over(inside) - 1)
    return rows.join(counts, "_chunk").withColumn(name, F.col("_before") + F.col("_row")).drop("_chunk", "_row", "_before")


def ith(a: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """The index at place ``k``: only the chunk that holds it is numbered."""
    rows = _chunks(a, chunk)
    counts = _before(rows.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n")), "_n", "_before").withColumn("_before", F.coalesce("_before", F.lit(0)))
    here = counts.where((F.col("_before") <= k) & (F.col("_before") + F.col("_n") > k)).select("_chunk", "_before")
    rows = rows.join(F.broadcast(here), "_chunk")  # one row, or none
    return rows.withColumn("_row", F.row_number().over(Window.partitionBy("_chunk").orderBy("i")) - 1 + F.col("_before")).where(F.col("_row") == k).select("i")


def prefix_sum(a: DataFrame, value: str = "v", name: str = "prefix", chunk: int = CHUNK) -> DataFrame:
    """Add the running sum by index, by the same levels as :func:`rank`."""
    rows = _chunks(a, chunk)
    sums = _before(rows.groupBy("_chunk").agg(F.sum(value).alias("_s")), "_s", "_before").select("_chunk", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_row", F.sum(value).over(inside))
    return rows.join(sums, "_chunk").withColumn(name, F.col("_before") + F.col("_row")).drop("_chunk", "_row", "_before")


def previous(a: DataFrame, name: str = "previous", chunk: int = CHUNK) -> DataFrame:
    """Add the next smaller index of the set, null at the first."""
    rows = _chunks(a, chunk)
    last = _before(rows.groupBy("_chunk").agg(F.max("i").alias("_m")), "_m", "_last", F.max).select("_chunk", "_last")
    rows = rows.withColumn(name, F.lag("i").over(Window.partitionBy("_chunk").orderBy("i"))).join(last, "_chunk")
    return rows.withColumn(name, F.coalesce(name, "_last")).drop("_chunk", "_last")


def relativize(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(i, local): each index of ``inner`` in the numbering of ``outer``."""
    return rank(outer, "local").join(inner.select("i"), "i", "left_semi")


def pieces(a: DataFrame) -> DataFrame:
    """(first, last, size): the contiguous pieces of a set.

    Index less place is the same all through a piece, and grows from piece to piece.
    """
    rows = rank(a.select("i").distinct(), "k").groupBy((F.col("i") - F.col("k")).alias("g"))
    return rows.agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("size")).drop("g")


def over_simplify(a: DataFrame, gap: int) -> DataFrame:
    """(first, last, size): pieces that take in gaps of at most ``gap`` missing indices.

    The ranges may hold more than the set; size counts the indices of the set.
    """
    rows = previous(a.select("i").distinct())
    new = F.coalesce((F.col("i") - F.col("previous") > gap + 1).cast("long"), F.lit(0).cast("long"))
    rows = prefix_sum(rows.select("i", new.alias("v")), "v", "g").groupBy("g")
    return rows.agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("size")).drop("g")


def strided(a: DataFrame, stride: int) -> DataFrame:
    """One row: first, last, volume, outer_volume and whether the set is one strided range."""
    i = F.col("i")
    got = a.agg(F.min(i).alias("first"), F.max(i).alias("last"), F.countDistinct(i).alias("volume"), F.countDistinct(F.pmod(i, F.lit(stride).cast("long"))).alias("_m"))
    return got.select("first", "last", "volume", (F.col("last") - F.col("first") + 1).alias("outer_volume"), ((F.col("last") - F.col("first") == (F.col("volume") - 1) * stride) & (F.col("_m") == 1)).alias("is_strided"))


def expand(ranges: DataFrame) -> DataFrame:
    """The indices of rows (first, last, stride)."""
    return ranges.select(F.explode(F.sequence("first", "last", "stride")).alias("i"))


def bounding_box(a: DataFrame, coords: list[str]) -> DataFrame:
    return a.agg(*[f(c).alias(f"{n}_{c}") for c in coords for n, f in (("lo", F.min), ("hi", F.max))])
