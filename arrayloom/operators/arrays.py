"""Pointwise operators, reductions and neighbour access on arrays (i, v)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.functions.index import floor_div
from arrayloom.plans.sizes import near

CHUNK = 1 << 16


def pointwise(x: DataFrame, f) -> DataFrame:
    """f over the value column; a user's local function as an expression."""
    return x.withColumn("v", f(F.col("v")))


def with_scalar(x: DataFrame, s: DataFrame, **columns) -> DataFrame:
    """The index and named columns f(value, scalar) for a replicated scalar, a frame of one row and column."""
    both = x.crossJoin(F.broadcast(s.select(F.col(s.columns[0]).alias("_s")).limit(1)))
    return both.select(*[c for c in x.columns if c != "v"], *[f(F.col("v"), F.col("_s")).alias(name) for name, f in columns.items()])


def scalar_op(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """f of two replicated scalars, frames of one row and column, as a column v."""
    left, right = a.select(F.col(a.columns[0]).alias("_a")).limit(1), b.select(F.col(b.columns[0]).alias("_b")).limit(1)
    return left.crossJoin(F.broadcast(right)).select(f(F.col("_a"), F.col("_b")).alias("v"))


def set_values(x: DataFrame, values: DataFrame) -> DataFrame:
    """``x`` with the values of (i, v) in place of its own; other indices of ``values`` do nothing."""
    new = near(values.groupBy("i").agg(F.max("v").alias("_new")))
    return x.join(new, "i", "left").withColumn("v", F.coalesce("_new", "v")).drop("_new")


def trace(x: DataFrame) -> DataFrame:
    """The element of the least index, in one row."""
    return x.agg(F.min("i").alias("i"), F.min_by("v", "i").alias("v"))


def gather(x: DataFrame, block: Column, value: Column) -> DataFrame:
    """(p, value, all): one value per block by a user's aggregate, and those of all blocks, in order, with each.

    There are as many rows as blocks, a number that the driver sets.
    """
    own = x.groupBy(block.alias("p")).agg(value.alias("value"))
    every = own.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "value"))), lambda e: e["value"]).alias("all"))
    return own.crossJoin(F.broadcast(every))


def redundant_tree(sums: DataFrame, levels: int) -> DataFrame:
    """(p, l0, l1, ...): sums over blocks 2^k (p div 2^k) and on, held by every one of these blocks.

    Each level is made from the one before: a block adds its own half and that of its
    partner.  There are as many rows as blocks, a number that the driver sets.
    """
    out = sums.select("p", F.col("v").alias("l0"))
    for k in range(levels):
        pair = Window.partitionBy(floor_div(F.col("p"), 2 ** (k + 1)))
        half = F.when(F.pmod(F.col("p"), F.lit(2**k)) == 0, F.col(f"l{k}"))
        out = out.withColumn(f"l{k + 1}", F.sum(half).over(pair))
    return out


def combine(x: DataFrame, y: DataFrame, f, keys: list[str] | None = None) -> DataFrame:
    """f(x, y) element by element, by an equi-join on the index."""
    keys = keys or [c for c in x.columns if c != "v"]
    return x.join(y.select(*keys, F.col("v").alias("_w")), keys).withColumn("v", f(F.col("v"), F.col("_w"))).drop("_w")


def outer_product(x: DataFrame, r: DataFrame, f) -> DataFrame:
    """(i, k, v): f of every element with every entry (k, v) of a replicated vector.

    The vector is broadcast if it is small; else the planner pairs partitions.
    """
    return x.crossJoin(near(r.select("k", F.col("v").alias("_w")))).select("i", "k", f(F.col("v"), F.col("_w")).alias("v"))


def norms(x: DataFrame, by: Column | None = None) -> DataFrame:
    """total, root, norm_squared, norm, least, most and n, overall or by block."""
    v = F.col("v")
    grouped = x.groupBy(by.alias("p")) if by is not None else x.groupBy()
    got = grouped.agg(F.sum(v).alias("total"), F.sum(v * v).alias("norm_squared"), F.min(v).alias("least"), F.max(v).alias("most"), F.count(F.lit(1)).alias("n"))
    return got.withColumn("norm", F.sqrt("norm_squared")).withColumn("root", F.when(F.col("total") >= 0, F.sqrt("total")))


def inner_product(x: DataFrame, y: DataFrame, by=None) -> DataFrame:
    both = combine(x, y, lambda a, b: a * b)
    return both.agg(F.sum("v").alias("dot")) if by is None else both.groupBy(by.alias("p")).agg(F.sum("v").alias("dot"))


def tree_sum(x: DataFrame, fan: int, levels: int) -> DataFrame:
    """A sum by groups of ``fan`` neighbours, again and again, then of what is left."""
    for _ in range(levels):
        x = x.groupBy(floor_div(F.col("i"), fan).alias("i")).agg(F.sum("v").alias("v"))
    return x.agg(F.sum("v").alias("total"))


def coarsen(x: DataFrame) -> DataFrame:
    """out[i] = in[2i] + in[2i+1]."""
    return x.groupBy(floor_div(F.col("i"), 2).alias("i")).agg(F.sum("v").alias("v"))


def halve(x: DataFrame) -> list[DataFrame]:
    """The levels of a sum by pairs of neighbours: the array, then halves until one row is left."""
    last = x.agg(F.max("i")).first()[0] or 0
    levels = [x]
    while last > 0:
        levels.append(coarsen(levels[-1]))
        last //= 2
    return levels


def prolong(x: DataFrame) -> DataFrame:
    """out[i] = in[i div 2]."""
    return x.select(F.explode(F.array(2 * F.col("i"), 2 * F.col("i") + 1)).alias("i"), "v")


def centre_of_mass(x: DataFrame) -> DataFrame:
    """Pairs of (i, m, c): the mass m1+m2, the centre sqrt(m x1^2 x2^2 / (m1 x2^2 + m2 x1^2))."""
    pick = lambda c, k: F.max(F.when(F.pmod(F.col("i"), F.lit(2)) == k, F.col(c)))
    got = x.groupBy(floor_div(F.col("i"), 2).alias("i")).agg(pick("m", 0).alias("m1"), pick("m", 1).alias("m2"), pick("c", 0).alias("x1"), pick("c", 1).alias("x2"))
    m = F.col("m1") + F.col("m2")
    a, b = F.col("x1") * F.col("x1"), F.col("x2") * F.col("x2")
    return got.select("i", m.alias("m"), F.sqrt(m * a * b / (F.col("m1") * b + F.col("m2") * a)).alias("c"))


def with_halo(x: DataFrame, radius: int, chunk: int = CHUNK, wrap: int | None = None) -> DataFrame:
    """Rows with _chunk and _own: each chunk of neighbours and ``radius`` more at its sides.

    One exchange of little more than the rows themselves serves any stencil.  With
    ``wrap``, the size of the array, the ends are neighbours: their rows come again
    beyond the other end.
    """
    i = F.col("i")
    x = x.withColumn("_true", F.lit(True))
    if wrap is not None:
        ghosts = [F.when(i < radius, i + wrap), F.when(i >= wrap - radius, i - wrap)]
        x = x.withColumn("_at", F.explode(F.array_compact(F.array(i, *ghosts)))).withColumn("_true", F.col("_at") == i).withColumn("i", F.col("_at")).drop("_at")
    near_ = F.array_distinct(F.array(floor_div(i - radius, chunk), floor_div(i, chunk), floor_div(i + radius, chunk)))
    x = x.withColumn("_home", floor_div(i, chunk)).withColumn("_chunk", F.explode(near_))
    return x.withColumn("_own", (F.col("_home") == F.col("_chunk")) & F.col("_true")).drop("_home", "_true")


def stencil(x: DataFrame, weights: dict[int, float], chunk: int = CHUNK, wrap: int | None = None) -> DataFrame:
    """out[i] = sum of weight * in[i+offset]; missing neighbours count as 0, or wrap around."""
    radius = max(map(abs, weights))
    order = Window.partitionBy("_chunk").orderBy("i")
    part = lambda k: F.coalesce(F.first("v").over(order.rangeBetween(k, k)), F.lit(0.0))
    value = reduce(lambda a, b: a + b, [(F.col("v") if k == 0 else part(k)) * F.lit(w) for k, w in sorted(weights.items(), key=lambda kw: (abs(kw[0]), kw[0]))])
    out = with_halo(x, radius, chunk, wrap).withColumn("_new", value).where("_own")
    return out.select("i", F.col("_new").alias("v"))


def neighbours(x: DataFrame, chunk: int = CHUNK, **offsets: int) -> DataFrame:
    """The index, the value and a named column in[i+offset] for each offset, null where there is none."""
    order = Window.partitionBy("_chunk").orderBy("i")
    halo = with_halo(x, max(map(abs, offsets.values())), chunk)
    got = halo.withColumns({name: F.first("v").over(order.rangeBetween(k, k)) for name, k in offsets.items()})
    return got.where("_own").select("i", "v", *offsets)


def stencil_nd(x: DataFrame, coords: list[str], weights: dict[tuple[int, ...], float], shape: list[int], tile: int = 256) -> DataFrame:
    """The d-dimensional stencil, for the rows that are there; missing neighbours count as 0.

    Tiles carry a halo, so one exchange of little more than the rows serves all
    neighbours.  In a tile with its halo a neighbour is a fixed distance away along the
    row-major order, and no row of the tile itself reaches around a border.
    """
    radius = max(abs(k) for off in weights for k in off)
    tiles = {c: f"_t{k}" for k, c in enumerate(coords)}
    for c, n in zip(coords, shape, strict=True):
        reach = F.array_distinct(F.array(*[floor_div(F.col(c) + k, tile) for k in (-radius, 0, radius)]))
        inside = [F.when((t >= 0) & (t <= (n - 1) // tile), t) for t in (F.get(reach, F.lit(k)) for k in range(3))]
        x = x.withColumn(tiles[c], F.explode(F.array_compact(F.array(*inside))))
    wide = tile + 2 * radius
    place = reduce(lambda at, c: at * wide + (F.col(c) - F.col(tiles[c]) * tile + radius), coords, F.lit(0).cast("long"))
    own = reduce(lambda a, b: a & b, [floor_div(F.col(c), tile) == F.col(tiles[c]) for c in coords])
    order = Window.partitionBy(*tiles.values()).orderBy("_place")
    away = {off: reduce(lambda at, k: at * wide + k, off, 0) for off in weights}
    part = lambda off: F.col("v") if not any(off) else F.coalesce(F.first("v").over(order.rangeBetween(away[off], away[off])), F.lit(0.0))
    value = reduce(lambda a, b: a + b, [part(off) * F.lit(float(w)) for off, w in weights.items()])
    return x.withColumn("_place", place).withColumn("_new", value).where(own).select(*coords, F.col("_new").alias("v"))


def s_steps(x: DataFrame, weights: dict[int, float], steps: int, chunk: int = CHUNK) -> DataFrame:
    """``steps`` stencil steps for one exchange: chunks carry a halo of all steps.

    Halo values beyond a chunk are recomputed, not fetched again.
    """
    import numpy as np
    import pandas as pd

    radius = max(map(abs, weights))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        i, v, own = rows["i"].to_numpy(), rows["v"].to_numpy(), rows["_own"].to_numpy()
        for _ in range(steps):
            new = np.zeros_like(v)
            for k, w in sorted(weights.items(), key=lambda kw: (abs(kw[0]), kw[0])):
                shifted = np.zeros_like(v)
                if k >= 0:
                    shifted[: len(v) - k] = v[k:]
                else:
                    shifted[-k:] = v[:k]
                new = new + shifted * w
            v = new
        return pd.DataFrame({"i": i[own], "v": v[own]})

    return with_halo(x, radius * steps, chunk).groupBy("_chunk").applyInPandas(run, "i long, v double")
