"""Queries over the array operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.functions import index as ix
from arrayloom.operators import arrays as ar
from arrayloom.operators import cluster, distribution, keyed, mesh, sets, solvers, sparse
from arrayloom.plans.lineage import cut
from arrayloom.plans.ship import ship
from arrayloom.plans.sizes import near
from arrayloom.sources import arrays as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}

P = 8
GRID = 20


def I() -> Column:  # noqa: E743
    return F.col("i")


def V() -> Column:
    return F.col("v")


# Named parts of the SQL texts.
CTE = {
    "o": "o AS (SELECT o_orderkey AS i, o_totalprice AS v FROM orders)",
    "n": "n AS (SELECT count(*) AS n FROM orders)",
    "c": "c AS (SELECT c_custkey AS i, c_acctbal AS v FROM customer)",
    "g": f"g AS (SELECT p_partkey // {GRID} AS i0, p_partkey % {GRID} AS i1, p_retailprice AS v FROM part)",
    "a": "a AS (SELECT l_orderkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)",
    "x": "x AS (SELECT p_partkey AS i, p_retailprice AS v FROM part)",
    "e": "e AS (SELECT event_id AS i, value AS v FROM events)",
    "s": "s AS (SELECT DISTINCT o_custkey AS i FROM orders)",
    "t": "t AS (SELECT c_custkey AS i FROM customer WHERE c_custkey % 3 = 0)",
}


def query(covers: str, sql: str, *ctes: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], COVERS[f.__name__] = f, covers
        if sql:
            SQL[f.__name__] = (f"WITH {', '.join(CTE[c] for c in ctes)} " if ctes else "") + sql
        return f

    return add


def orders(spark: SparkSession, d: str) -> DataFrame:
    return src.origin(src.table(spark, d, "orders"), "o_orderkey", "o_totalprice")


def customers(spark: SparkSession, d: str) -> DataFrame:
    return src.origin(src.table(spark, d, "customer"), "c_custkey", "c_acctbal")


def events(spark: SparkSession, d: str) -> DataFrame:
    return src.origin(src.table(spark, d, "events"), "event_id", "value")


def parts(spark: SparkSession, d: str) -> DataFrame:
    return src.origin(src.table(spark, d, "part"), "p_partkey", "p_retailprice")


def grid(spark: SparkSession, d: str) -> tuple[DataFrame, list[int]]:
    x = parts(spark, d)
    return x.select(ix.floor_div(I(), GRID).alias("i0"), F.pmod(I(), F.lit(GRID)).alias("i1"), "v"), [x.count() // GRID, GRID]


def matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = src.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    return sparse.build(rows)


def used(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "orders").select(F.col("o_custkey").alias("i")).distinct()


def thirds(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "customer").select(F.col("c_custkey").alias("i")).where("i % 3 = 0")


def r4(c: Column | str) -> Column:
    return F.round(c, 4)


# Index maps.


@query("1-5,9-12,16,199", "SELECT i, (i + 3) % n AS right_mod, (i - 3 + n) % n AS left_mod, least(i + 3, n - 1) AS right_bump, greatest(i - 3, 0) AS left_bump, 2 * i AS twice, CASE WHEN i >= 3 THEN i - 3 ELSE -1 END AS inverse, i + 100 AS rebased FROM o, n", "o", "n")
def index_maps(spark, d):
    o = orders(spark, d)
    n = o.count()
    return o.select("i", ix.shift_mod(I(), 3, n).alias("right_mod"), ix.shift_mod(I(), -3, n).alias("left_mod"), ix.shift_bump(I(), 3, n).alias("right_bump"), ix.shift_bump(I(), -3, n).alias("left_bump"), (2 * I()).alias("twice"), F.coalesce(ix.inverse_shift(I(), 3, n), F.lit(-1)).alias("inverse"), ix.shift_to(I(), 0, 100).alias("rebased"))


@query("13,14", "SELECT i, CASE WHEN i + 3 < n THEN i + 3 ELSE -1 END AS inverse_left, CASE WHEN i - 3 >= 0 THEN i - 3 ELSE -1 END AS inverse_right FROM o, n", "o", "n")
def index_inverse(spark, d):
    o = orders(spark, d)
    n = o.count()
    return o.select("i", *[F.coalesce(ix.inverse_shift(I(), k, n), F.lit(-1)).alias(c) for k, c in ((-3, "inverse_left"), (3, "inverse_right"))])


@query("5,18,19", "SELECT c.i, c.i * 3 + k AS j FROM c, range(3) AS r(k)", "c")
def index_base_multiply(spark, d):
    return customers(spark, d).select("i", F.explode(ix.spread(I(), 3)).alias("j"))


@query("6,20", "SELECT DISTINCT i // 7 AS i FROM c", "c")
def index_divide(spark, d):
    return customers(spark, d).select(ix.floor_div(I(), 7).alias("i")).distinct()


@query("7", "SELECT c_nationkey AS k, min(c_custkey) // 4 AS first, (max(c_custkey) + 1) // 4 - 1 AS last, 1::BIGINT AS stride FROM customer GROUP BY 1")
def index_contiguous_divide(spark, d):
    ranges = src.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_custkey").alias("f"), F.max("c_custkey").alias("l"))
    return ranges.select("k", ix.contiguous_divide(F.col("f"), F.col("l"), F.lit(1).cast("long"), 4).alias("r")).select("k", "r.*")


@query("8,202", "SELECT i, (i * i + 1) % 97 AS j FROM c", "c")
def index_function(spark, d):
    return customers(spark, d).select("i", F.pmod(I() * I() + 1, F.lit(97)).alias("j"))


@query("15-17", "SELECT i0, i1, i0 + d0 AS j0, i1 + d1 AS j1 FROM g, (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) AS m(d0, d1)", "g")
def index_stencil(spark, d):
    g, _ = grid(spark, d)
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))])
    return g.select("i0", "i1", F.explode(moves).alias("m")).select("i0", "i1", (F.col("i0") + F.col("m.a")).alias("j0"), (F.col("i1") + F.col("m.b")).alias("j1"))


@query("21-24,29", f"SELECT i0, i1, i0 + i1 AS plus, i0 - i1 AS minus, i0 * i1 AS times, i0 // (i1 + 1) AS quotient, i0 % (i1 + 1) AS remainder, -i0 AS negative, least(i0, i1) AS low, greatest(i0, i1) AS high, i0 < i1 AS less, (i0 + 1) * (i1 + 1) AS span, i0 * {GRID} + i1 AS linear, (i0 = 0 OR i1 = 0 OR i1 = {GRID - 1} OR i0 = (SELECT max(i0) FROM g)) AS face FROM g", "g")
def coordinates(spark, d):
    g, shape = grid(spark, d)
    a, b = F.col("i0"), F.col("i1")
    return g.select("i0", "i1", (a + b).alias("plus"), (a - b).alias("minus"), (a * b).alias("times"), ix.floor_div(a, b + 1).alias("quotient"), F.pmod(a, b + 1).alias("remainder"), (-a).alias("negative"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), (a < b).alias("less"), ix.span([a + 1, b + 1]).alias("span"), ix.linear([a, b], shape).alias("linear"), ix.on_face([a, b], shape).alias("face"))


@query("24", "SELECT i, i // 60 AS i0, (i // 12) % 5 AS i1, i % 12 AS i2 FROM o", "o")
def delinearize(spark, d):
    return orders(spark, d).select("i", *[c.alias(f"i{k}") for k, c in enumerate(ix.delinear(I(), [1, 5, 12]))])


@query("27,36", "SELECT i FROM c WHERE i IN (1, 5, 9, 1000000)", "c")
def coordinate_set(spark, d):
    wanted = spark.createDataFrame([(1,), (5,), (5,), (9,), (1_000_000,)], "i long").dropDuplicates()
    return customers(spark, d).select("i").join(F.broadcast(wanted), "i", "left_semi")


@query("28", "SELECT count(*) FILTER (next < v) AS falls, count(*) FILTER (next = v) AS ties, count(*) FILTER (next <= v) = 0 AS is_sorted FROM (SELECT i, v, lead(v) OVER (ORDER BY i) AS next FROM (SELECT o_orderkey AS i, o_custkey::DOUBLE AS v FROM orders))")
def require_sorted(spark, d):
    x = ar.neighbours(src.origin(src.table(spark, d, "orders"), "o_orderkey", "o_custkey"), next=1)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    return x.agg(count(F.col("next") < V()).alias("falls"), count(F.col("next") == V()).alias("ties"), (count(F.col("next") <= V()) == 0).alias("is_sorted"))


PRIMES = "[2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47]"


@query("26", f"WITH RECURSIVE g AS (SELECT p, p AS rest, 50 AS f, 1 AS a, 1 AS b FROM (SELECT DISTINCT p_size AS p FROM part) UNION ALL SELECT p, CASE WHEN hit THEN rest // f ELSE rest END, CASE WHEN hit THEN f ELSE f - 1 END, CASE WHEN hit AND a <= b THEN a * f ELSE a END, CASE WHEN hit AND a > b THEN b * f ELSE b END FROM (SELECT *, list_contains({PRIMES}, f) AND rest % f = 0 AS hit FROM g WHERE rest > 1)) SELECT p, greatest(a, b) AS a, least(a, b) AS b FROM g WHERE rest = 1")
def process_grids(spark, d):
    """Grids for the process numbers 1 to 50, as far as the table has them as sizes."""
    sizes = src.table(spark, d, "part").select(F.col("p_size").alias("p")).where("p between 1 and 50").distinct()
    grids = spark.createDataFrame([(p, *ix.process_grid(p, 2)) for p in range(1, 51)], "p int, a int, b int")
    return sizes.join(F.broadcast(grids), "p")


# Index sets.


@query("30,43,52", "SELECT i FROM s UNION SELECT i FROM t", "s", "t")
def set_union(spark, d):
    return sets.union(used(spark, d), thirds(spark, d))


@query("31", "SELECT i FROM s INTERSECT SELECT i FROM t", "s", "t")
def set_intersect(spark, d):
    return sets.intersect(used(spark, d), thirds(spark, d))


@query("33", "SELECT i FROM s EXCEPT SELECT i FROM t", "s", "t")
def set_minus(spark, d):
    return sets.minus(used(spark, d), thirds(spark, d))


@query("32,34,35,37", "SELECT (SELECT count(*) FROM s JOIN t USING (i)) > 0 AS has_intersect, (SELECT count(*) FROM s JOIN t USING (i)) = 0 AS disjoint, (SELECT count(*) FROM (SELECT i FROM t EXCEPT SELECT i FROM s)) = 0 AS contains, (SELECT count(*) FROM (SELECT i FROM t EXCEPT SELECT i FROM s)) = 0 AND (SELECT count(*) FROM (SELECT i FROM s EXCEPT SELECT i FROM t)) = 0 AS equals", "s", "t")
def set_relations(spark, d):
    return sets.relation(used(spark, d), thirds(spark, d))


@query("38,39,40", "SELECT i, i < 50 AS low FROM (SELECT i + 2 AS i FROM t) WHERE i >= 10 AND i <= 99", "t")
def set_split_truncate(spark, d):
    low, high = sets.split(sets.truncate(thirds(spark, d).select((I() + 2).alias("i")), 10, 99), 50)
    return low.withColumn("low", F.lit(True)).union(high.withColumn("low", F.lit(False)))


@query("41", "SELECT i + 1000 AS i FROM t", "t")
def set_translate(spark, d):
    return thirds(spark, d).select((I() + 1000).alias("i"))


@query("42,49", "SELECT i, local FROM (SELECT i, row_number() OVER (ORDER BY i) - 1 AS local FROM s) WHERE i IN (SELECT i FROM t)", "s", "t")
def set_relativize(spark, d):
    return sets.relativize(thirds(spark, d), used(spark, d))


@query("44", "SELECT min(i) AS first, max(i) AS last, count(*) AS size FROM (SELECT i, i - row_number() OVER (ORDER BY i) AS g FROM s) GROUP BY g", "s")
def set_pieces(spark, d):
    return sets.pieces(used(spark, d))


@query("44", "SELECT min(i) AS first, max(i) AS last, count(*) AS size FROM (SELECT i, sum(new) OVER (ORDER BY i) AS g FROM (SELECT i, CASE WHEN i - lag(i) OVER (ORDER BY i) > 3 THEN 1 ELSE 0 END AS new FROM (SELECT DISTINCT l_orderkey AS i FROM lineitem WHERE l_quantity < 4))) GROUP BY g")
def set_over_simplify(spark, d):
    """Ranges that take in gaps of up to two missing indices."""
    rows = src.table(spark, d, "lineitem").where("l_quantity < 4").select(F.col("l_orderkey").alias("i"))
    return sets.over_simplify(rows, 2)


@query("45,47,48,54", "SELECT min(i) AS first, max(i) AS last, count(*) AS volume, max(i) - min(i) + 1 AS outer_volume, max(i) - min(i) = (count(*) - 1) * 3 AS is_strided FROM t", "t")
def set_strided(spark, d):
    return sets.strided(thirds(spark, d), 3)


@query("46,51", "SELECT unnest(range(c_nationkey * 100, c_nationkey * 100 + 10, 3)) AS i FROM (SELECT DISTINCT c_nationkey FROM customer)")
def set_expand(spark, d):
    ranges = src.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k")).distinct()
    return sets.expand(ranges.select((F.col("k") * 100).alias("first"), (F.col("k") * 100 + 9).alias("last"), F.lit(3).cast("long").alias("stride")))


@query("50", "SELECT i FROM (SELECT i, row_number() OVER (ORDER BY i) - 1 AS k FROM s) WHERE k = (SELECT count(*) // 2 FROM t)", "s", "t")
def set_ith(spark, d):
    return sets.ith(used(spark, d), thirds(spark, d).count() // 2)


@query("53", "SELECT i0, i1 FROM g WHERE i0 < 6 INTERSECT SELECT i0, i1 FROM g WHERE i1 >= 4 EXCEPT SELECT i0, i1 FROM g WHERE i0 = i1", "g")
def set_bricks(spark, d):
    g, _ = grid(spark, d)
    g = g.select("i0", "i1")
    return sets.minus(sets.intersect(g.where("i0 < 6"), g.where("i1 >= 4")), g.where("i0 = i1"))


@query("54", "SELECT min(i0) AS lo_i0, max(i0) AS hi_i0, min(i1) AS lo_i1, max(i1) AS hi_i1 FROM g WHERE v > 990", "g")
def set_bounding_box(spark, d):
    g, _ = grid(spark, d)
    return sets.bounding_box(g.where("v > 990"), ["i0", "i1"])


# Distributions.

BLOCK = f"((i + 1) * {P} - 1) // n"


@query("25,55,81", f"SELECT {BLOCK} AS p, min(i) AS first, max(i) AS last, count(*) AS size FROM o, n GROUP BY 1", "o", "n")
def blocks_orthogonal(spark, d):
    o = orders(spark, d)
    return o.groupBy(ix.block(I(), o.count(), P).alias("p")).agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("size"))


@query("57,60", "SELECT CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END AS p, count(*) AS size FROM o, n GROUP BY 1", "o", "n")
def blocks_first_larger(spark, d):
    o = orders(spark, d)
    return o.groupBy(ix.block_first_larger(I(), o.count(), 7).alias("p")).agg(F.count(F.lit(1)).alias("size"))


@query("58,61,62", "SELECT i, i // 100 AS uniform, i % 8 AS cyclic, (i // 5) % 8 AS block_cyclic FROM o", "o")
def blocks_cyclic(spark, d):
    return orders(spark, d).select("i", ix.floor_div(I(), 100).alias("uniform"), ix.cyclic(I(), 8).alias("cyclic"), ix.block_cyclic(I(), 5, 8).alias("block_cyclic"))


@query("59,75", "SELECT c_nationkey AS p, (sum(size) OVER (ORDER BY c_nationkey) - size)::BIGINT AS first, size FROM (SELECT c_nationkey, count(*) AS size FROM customer GROUP BY 1)")
def blocks_from_sizes(spark, d):
    sizes = src.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("p")).agg(F.count(F.lit(1)).alias("size"))
    return distribution.from_sizes(sizes)


@query("63,64,80", "SELECT i, min(p) AS p FROM c, range(400) AS r(p) WHERE i >= 3 * p AND i < 3 * p + 5 GROUP BY i", "c")
def blocks_first_owner(spark, d):
    table = spark.range(400).select(F.col("id").alias("p"), (3 * F.col("id")).alias("first"), F.lit(5).cast("long").alias("size"))
    return distribution.owner(customers(spark, d).select("i"), table)


@query("63,64,80", "SELECT i, min(p) AS p FROM c, (SELECT unnest(range((SELECT max(i) // 3 + 1 FROM c))) AS p) WHERE i >= 3 * p AND i < 3 * p + 5 GROUP BY i", "c")
def blocks_first_owner_all(spark, d):
    """As blocks_first_owner, whose SQL has 400 blocks at any size, with blocks up to the last index."""
    c = customers(spark, d).select("i")
    return distribution.owner(c, distribution.overlapping(c, 3, 5))


@query("77,78", f"SELECT {BLOCK} AS p, i FROM o, n UNION SELECT i % {P} AS p, i FROM o UNION SELECT 0 AS p, i FROM t", "o", "n", "t")
def blocks_union_extend(spark, d):
    """Blocks and cycles of one array united by process, block 0 extended by a set."""
    o = orders(spark, d).select("i")
    both = distribution.union(o.withColumn("p", ix.block(I(), o.count(), P)), o.withColumn("p", ix.cyclic(I(), P)))
    return distribution.extend(both, 0, thirds(spark, d))


@query("63", "SELECT i, v, p FROM c JOIN (SELECT o_custkey AS i, min(o_orderkey % 8) AS p FROM orders GROUP BY 1) USING (i)", "c")
def blocks_from_lists(spark, d):
    """Explicit lists: a block has the customers of its orders, the least block owns."""
    lists = src.table(spark, d, "orders").select(F.pmod("o_orderkey", F.lit(8)).alias("p"), F.col("o_custkey").alias("i"))
    return distribution.from_lists(customers(spark, d), lists)


@query("64,80", "SELECT i, min(p) AS p FROM (SELECT p, 3 * (p // 2) + k AS i FROM (SELECT unnest(range((SELECT 2 * (count(*) // 3) FROM c))) AS p), range(3) AS r(k)) GROUP BY i", "c")
def blocks_from_function(spark, d):
    """f(p, k) = 3 (p div 2) + k: blocks in equal pairs, of which the first owns."""
    blocks = 2 * (customers(spark, d).count() // 3)
    owners = distribution.from_function(spark, blocks, 3, lambda p, k: 3 * ix.floor_div(p, 2) + k)
    return owners.groupBy("i").agg(F.min("p").alias("p"))


@query("65", "SELECT CASE WHEN v < 0 THEN 0 WHEN v >= 10000 THEN 11 ELSE floor(v / 1000)::BIGINT + 1 END::BIGINT AS bin, count(*) AS size FROM c GROUP BY 1", "c")
def blocks_by_value(spark, d):
    return customers(spark, d).groupBy(F.width_bucket("v", F.lit(0.0), F.lit(10000.0), F.lit(10)).alias("bin")).agg(F.count(F.lit(1)).alias("size"))


@query("66", f"SELECT {BLOCK} AS p, round(max(v) - min(v), 4) AS spread, count(*) AS size FROM o, n GROUP BY 1", "o", "n")
def scalar_by_block(spark, d):
    """A scalar distribution: one value a block."""
    o = orders(spark, d)
    return o.groupBy(ix.block(I(), o.count(), P).alias("p")).agg(r4(F.max("v") - F.min("v")).alias("spread"), F.count(F.lit(1)).alias("size"))


LIST = "(SELECT array_to_string(list({0} ORDER BY p), ',') FROM b)"


@query("67,130,139", f", b AS (SELECT {BLOCK} AS p, (max(v) * 100)::BIGINT AS value FROM o, n GROUP BY 1) SELECT p, value, {LIST.format('value')} AS all FROM b", "o", "n")
def gather_by_block(spark, d):
    """One value per block by a user's aggregate, gathered in block order on every block."""
    o = orders(spark, d)
    got = ar.gather(o, ix.block(I(), o.count(), P), F.round(F.max("v") * 100).cast("long"))
    return got.withColumn("all", F.array_join(F.col("all").cast("array<string>"), ","))


@query("131", f", b AS (SELECT {BLOCK} AS p, (max(v) * 100)::BIGINT - (min(v) * 100)::BIGINT + count(*) AS value FROM o, n GROUP BY 1) SELECT p, value, {LIST.format('value')} AS all FROM b", "o", "n")
def gather_statistics(spark, d):
    """The same with another function of the block, over several aggregates."""
    o = orders(spark, d)
    cents = lambda c: F.round(c * 100).cast("long")
    got = ar.gather(o, ix.block(I(), o.count(), P), cents(F.max("v")) - cents(F.min("v")) + F.count(F.lit(1)))
    return got.withColumn("all", F.array_join(F.col("all").cast("array<string>"), ","))


@query("69", f", b AS (SELECT {BLOCK} AS p, min(i) AS first, max(i) AS last FROM o, n GROUP BY 1) SELECT p, first, last, {LIST.format('first')} AS firsts, (SELECT max(last) FROM b) AS top FROM b", "o", "n")
def blocks_from_local(spark, d):
    """Each block's own structure, gathered into the table of all blocks."""
    o = orders(spark, d)
    got = ar.gather(o, ix.block(I(), o.count(), P), F.struct(F.min("i").alias("first"), F.max("i").alias("last")))
    return got.select("p", "value.first", "value.last", F.array_join(F.col("all.first").cast("array<string>"), ",").alias("firsts"), F.array_max("all.last").alias("top"))


@query("68", f"SELECT i, v FROM o, n WHERE {BLOCK} IN (1, 4)", "o", "n")
def masked_distribution(spark, d):
    o = orders(spark, d)
    return o.where(ix.block(I(), o.count(), P).isin(1, 4))


@query("73", f"SELECT i // 2 AS i, (i // 2) * {P} // (n // 2 + 1) AS p, v FROM o, n WHERE i % 2 = 0 AND i // 2 < n // 3", "o", "n")
def redistribute(spark, d):
    """Halved indices, truncated at a third of the array."""
    o = orders(spark, d)
    n = o.count()
    halves = sets.truncate(distribution.operate(o.where("i % 2 = 0"), lambda i: ix.floor_div(i, 2)), high=n // 3 - 1)
    return halves.select("i", ix.floor_div(I() * P, n // 2 + 1).alias("p"), "v")


@query("70", f"SELECT {BLOCK} AS p, (i + 3) % n AS i FROM o, n", "o", "n")
def operate_shift(spark, d):
    """Every block's indices under one index map."""
    o = orders(spark, d).select("i")
    n = o.count()
    return distribution.operate(o.select(ix.block(I(), n, P).alias("p"), "i"), lambda i: ix.shift_mod(i, 3, n))


@query("71", f"SELECT DISTINCT {BLOCK} AS p, i + k AS i FROM o, n, (VALUES (-1), (0), (1)) AS m(k) WHERE i + k >= 0 AND i + k < n", "o", "n")
def operate_blocks(spark, d):
    """What each block needs for a three-point rule: its own indices and their neighbours."""
    o = orders(spark, d).select("i")
    n = o.count()
    return distribution.operate_blocks(o.select(ix.block(I(), n, P).alias("p"), "i"), lambda i: F.array(i - 1, i, i + 1), n)


@query("72", f"SELECT ((i + 1) * {P} - 1) // n AS p, i FROM (SELECT DISTINCT i // 2 AS i FROM o), (SELECT (count(*) + 1) // 2 AS n FROM orders)", "o")
def operate_base(spark, d):
    """The whole range halved, then split anew."""
    o = orders(spark, d).select("i")
    return distribution.operate_base(o, lambda i: ix.floor_div(i, 2), -(-o.count() // 2), P)


@query("74", f"SELECT min({BLOCK}) AS p, i // 2 AS i FROM o, n GROUP BY 2", "o", "n")
def distribution_sigma(spark, d):
    """A coarser distribution from a finer: half an index belongs to the first block that has a part."""
    o = orders(spark, d).select("i")
    fine = o.select(ix.block(I(), o.count(), P).alias("p"), "i")
    return distribution.sigma(fine, lambda x: x.groupBy(ix.floor_div(I(), 2).alias("i")).agg(F.min("p").alias("p")))


@query("116", f"SELECT (i + 3) % n AS i, {BLOCK} AS p, v FROM o, n", "o", "n")
def object_operate(spark, d):
    """A new distribution by a shift, the data copied as they are."""
    o = orders(spark, d)
    n = o.count()
    return distribution.operate(o.withColumn("p", ix.block(I(), n, P)), lambda i: ix.shift_mod(i, 3, n)).select("i", "p", "v")


@query("70,116", f"SELECT i // 2 AS i, (i // 2) * {P} // (n // 2 + 1) AS p, v FROM o, n WHERE i % 2 = 0", "o", "n")
def redistribute_all(spark, d):
    """As redistribute, without truncation."""
    o = orders(spark, d)
    n = o.count()
    halves = distribution.operate(o.where("i % 2 = 0"), lambda i: ix.floor_div(i, 2))
    return halves.select("i", ix.floor_div(I() * P, n // 2 + 1).alias("p"), "v")


@query("86", f"SELECT domain, domain // 4 AS p, count(*) AS size, round(sum(v), 2) AS total FROM (SELECT ((i + 1) * {4 * P} - 1) // n AS domain, v FROM o, n) GROUP BY 1, 2", "o", "n")
def over_decompose(spark, d):
    """Four domains a process, each reduced for itself."""
    o = orders(spark, d)
    return distribution.over_decompose(o, o.count(), P, 4).groupBy("domain", "p").agg(F.count(F.lit(1)).alias("size"), F.round(F.sum("v"), 2).alias("total"))


@query("76", "WITH b AS (SELECT c_nationkey AS p, count(*) AS s FROM customer GROUP BY 1), t AS (SELECT count(*) AS total FROM orders), m AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS k, greatest(1, s * total // (SELECT sum(s) FROM b)) AS s FROM b, t), e AS (SELECT total - (SELECT sum(s) FROM m) AS e, (SELECT count(*) FROM m) AS n FROM t) SELECT p, (s + (k + 1) * e // n - k * e // n)::BIGINT AS size FROM m, e")
def stretch_blocks(spark, d):
    """The customers of each nation, as block sizes, stretched to the number of orders."""
    sizes = src.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("p")).agg(F.count(F.lit(1)).alias("s")).orderBy("p").limit(1000).collect()
    out = distribution.stretch([r["s"] for r in sizes], orders(spark, d).count())
    return spark.createDataFrame([(r["p"], x) for r, x in zip(sizes, out, strict=True)], "p int, size long")


@query("79", f"SELECT b AS p, b * n // {P} AS bound FROM n, range({P + 1}) AS r(b)", "n")
def partitioning_points(spark, d):
    n = orders(spark, d).count()
    return spark.createDataFrame(list(enumerate(ix.split_points(n, P))), "p long, bound long")


KIND = "CASE WHEN bool_and(last - first + 1 = n AND coalesce(before + 1 = first, true)) THEN 'contiguous' WHEN bool_and(last - first + 1 = n) THEN 'blocked' ELSE 'general' END"
PARTS = "(SELECT *, lag(last) OVER (ORDER BY p) AS before FROM (SELECT p, min(i) AS first, max(i) AS last, count(*) AS n FROM ({0}) GROUP BY p))"


@query("82", f"SELECT (SELECT {KIND} FROM {PARTS.format(f'SELECT {BLOCK} AS p, i FROM o, n')}) AS of_blocks, (SELECT {KIND} FROM {PARTS.format(f'SELECT i % {P} AS p, i FROM o')}) AS of_cycles, (SELECT {KIND} FROM {PARTS.format(f'SELECT {P} - {BLOCK} AS p, i FROM o, n')}) AS of_turned", "o", "n")
def infer_types(spark, d):
    o = orders(spark, d).select("i")
    n = o.count()
    kinds = {"of_blocks": ix.block(I(), n, P), "of_cycles": ix.cyclic(I(), P), "of_turned": P - ix.block(I(), n, P)}
    a, b, c = [distribution.infer_type(o.withColumn("p", p)).select(F.col("kind").alias(name)) for name, p in kinds.items()]
    return a.crossJoin(b).crossJoin(c)


@query("83", f"SELECT p, round((l + coalesce(a, 0) + coalesce(b, 0)) / (1 + (a IS NOT NULL)::INT + (b IS NOT NULL)::INT), 4) AS load FROM (SELECT p, l, lag(l) OVER (ORDER BY p) AS a, lead(l) OVER (ORDER BY p) AS b FROM (SELECT {BLOCK} AS p, sum(v) AS l FROM o, n GROUP BY 1))", "o", "n")
def smooth_load(spark, d):
    o = orders(spark, d)
    load = o.groupBy(ix.block(I(), o.count(), P).alias("p")).agg(F.sum("v").alias("load"))
    return distribution.smooth_table(load).select("p", r4("load").alias("load"))


@query("84,85,184,211", f""", b AS (SELECT {BLOCK} AS p, count(*) AS size, sum(w) AS l FROM (SELECT i, v * (1 + 3.0 * i / (SELECT n FROM n)) AS w FROM o), n GROUP BY 1),
f AS (SELECT p, l / size AS own, lead(l / size) OVER (ORDER BY p) AS next, sum(l - mean) OVER (ORDER BY p) AS t, sum(size) OVER (ORDER BY p) AS bound FROM (SELECT *, avg(l) OVER () AS mean FROM b)),
g AS (SELECT bound - round_even(t / 2 / (CASE WHEN t > 0 THEN own ELSE next END), 0)::BIGINT AS bound FROM f WHERE p < {P - 1})
SELECT p, count(*) AS size, round(sum(v), 2) AS total FROM (SELECT (SELECT count(*) FROM g WHERE g.bound <= o.i) AS p, v FROM o) GROUP BY 1""", "o", "n")
def balance_load(spark, d):
    """Measure the work of blocks, move their borders by diffusion, and deal the array anew."""
    o = orders(spark, d)
    n = o.count()
    work = o.groupBy(ix.block(I(), n, P).alias("p")).agg(F.count(F.lit(1)).alias("size"), F.sum(V() * (1 + 3.0 * I() / n)).alias("l"))
    table = work.orderBy("p").limit(P).collect()
    sizes = distribution.diffuse([r["size"] for r in table], [r["l"] for r in table])
    bounds = [sum(sizes[: k + 1]) for k in range(len(sizes) - 1)]
    return distribution.rebound(o, bounds).groupBy("p").agg(F.count(F.lit(1)).alias("size"), F.round(F.sum("v"), 2).alias("total"))


@query("184,211", "")
def balance_rounds(spark, d):
    """Block sizes over four rounds of diffusion of a load that moves on."""
    n = orders(spark, d).count()
    step = lambda k, a, s: s + 1000.0 * max(0, min(a + s, (k + 2) * n // 8) - max(a, (k + 1) * n // 8)) / (n / 8)
    rows = distribution.balance([n // P] * (P - 1) + [n - n // P * (P - 1)], step, 4)
    return spark.createDataFrame([(k, p, s) for k, sizes in enumerate(rows) for p, s in enumerate(sizes)], "step int, p int, size int")


@query("85", "WITH s AS (SELECT (SELECT count(*) FROM region) AS r, (SELECT count(*) // 5 FROM nation) AS c), g AS (SELECT i, j, r, c FROM s, range(100) AS a(i), range(100) AS b(j) WHERE i < r AND j < c) SELECT i * c + j AS a, (i + 1) * c + j AS b FROM g WHERE i + 1 < r UNION ALL SELECT i * c + j, i * c + j + 1 FROM g WHERE j + 1 < c")
def grid_adjacency(spark, d):
    """The neighbouring pairs of a two-dimensional process grid, from its incidence matrix."""
    shape = [src.table(spark, d, "region").count(), src.table(spark, d, "nation").count() // 5]
    rows = [(int(r.argmax()), int(r.argmin())) for r in distribution.adjacency(shape)]
    return spark.createDataFrame(rows, "a long, b long")


@query("209", f"SELECT s AS step, p, CASE WHEN s = 0 THEN 0 ELSE 3 - (p = 0)::INT - (p = n - 1)::INT END AS needs FROM range(5) AS r(s), (SELECT DISTINCT c_nationkey::BIGINT AS p FROM customer), (SELECT count(DISTINCT c_nationkey) AS n FROM customer)")
def task_levels(spark, d):
    """The tasks of five stencil steps over a block for each nation, leveled by step."""
    return distribution.task_graph(spark, src.table(spark, d, "customer").agg(F.countDistinct("c_nationkey")).first()[0], 5)


@query("56,103", "SELECT i, v, n_nationkey, n_name FROM (SELECT c_custkey AS i, c_acctbal AS v, c_nationkey FROM customer) JOIN nation ON n_nationkey = c_nationkey")
def replicated(spark, d):
    """A whole table replicated to every block, after a check of its size, and read by key."""
    rows = src.table(spark, d, "customer").select(F.col("c_custkey").alias("i"), F.col("c_acctbal").alias("v"), F.col("c_nationkey").alias("n_nationkey"))
    return rows.join(near(src.table(spark, d, "nation").select("n_nationkey", "n_name")), "n_nationkey").select("i", "v", "n_nationkey", "n_name")


# Sources.


@query("87,102", "SELECT i, v FROM o", "o")
def copy(spark, d):
    return orders(spark, d)


@query("88,115,152", "SELECT i, v FROM e", "e")
def no_fill(spark, d):
    """The fill, the preconditioner and the diffusion step that leave an array as it is."""
    return src.no_fill(events(spark, d))


@query("101", "SELECT i, CASE WHEN i % 50 = 0 AND i IN (SELECT i FROM c) THEN 0 - i::DOUBLE ELSE v END AS v FROM o", "o", "c")
def set_values(spark, d):
    """Values set from outside at some indices, then read."""
    values = customers(spark, d).where("i % 50 = 0").select("i", (-I()).cast("double").alias("v"))
    return ar.set_values(orders(spark, d), values)


@query("117", "SELECT i, 4.25::DOUBLE AS v FROM o", "o")
def set_constant(spark, d):
    return src.constant(orders(spark, d), 4.25)


@query("98", "SELECT i, v FROM o WHERE i = (SELECT min(i) FROM o)", "o")
def trace(spark, d):
    return ar.trace(orders(spark, d))


@query("89,90,92-94,198,203", f"SELECT i, 3.5 AS constant, CASE WHEN i = 7 THEN 1.0 ELSE 0.0 END AS delta, i::DOUBLE AS filled, {BLOCK} AS p, ({BLOCK}) + 0.5 AS gen FROM o, n", "o", "n")
def generated(spark, d):
    """An array by rules, as long as the table."""
    n = orders(spark, d).count()
    p = ix.block(I(), n, P)
    return src.generate(spark, n, 3.5).withColumnRenamed("v", "constant").select("i", "constant", F.when(I() == 7, 1.0).otherwise(0.0).alias("delta"), I().cast("double").alias("filled"), p.alias("p"), (p + 0.5).alias("gen"))


@query("91", f"SELECT i, ({BLOCK})::DOUBLE AS v FROM o, n", "o", "n")
def process_ids(spark, d):
    return src.process_fill(spark, orders(spark, d).count(), P)


@query("93", "SELECT i // 30 AS i0, (i // 6) % 5 AS i1, i % 6 AS i2, i::DOUBLE AS v FROM (SELECT unnest(range((SELECT 30 * count(*) FROM customer))) AS i)")
def linear_fill_3d(spark, d):
    return src.linear_fill(spark, [customers(spark, d).count(), 5, 6])


@query("97,208", "SELECT i, round(1 + sqrt(n) * exp(0 - pow((i - 100) / 10.0, 2)), 6) AS v FROM o, n", "o", "n")
def moving_weights(spark, d):
    o = orders(spark, d)
    return o.select("i", F.round(src.moving_weight(I(), o.count(), 100.0), 6).alias("v"))


@query("95", "")
def random_coordinates(spark, d):
    return src.random_coordinates(spark, orders(spark, d).count())


@query("96,208", "SELECT s_suppkey AS k, s_suppkey / n::DOUBLE AS c0, s_suppkey / n::DOUBLE AS c1 FROM supplier, (SELECT count(*) AS n FROM supplier)")
def initial_centres(spark, d):
    return src.initial_centres(spark, src.table(spark, d, "supplier").count())


@query("208", "SELECT i, (i % 25) / 25.0::DOUBLE AS c0, (i % 25) / 25.0::DOUBLE AS c1 FROM c", "c")
def predictable_points(spark, d):
    return src.predictable_points(spark, customers(spark, d).count(), 25)


@query("99,100", "")
def plan_summary(spark, d):
    """Operators, exchanges, broadcasts and scans of a sparse product's plan."""
    from arrayloom.plans.graph import summary

    plan = sparse.multiply(matrix(spark, d), parts(spark, d))
    return spark.createDataFrame(sorted(summary(plan).items()), "what string, n int")


# Pointwise.


@query("104,106,107,114,119", "SELECT i, round(v * 2.5, 6) AS scaled, v * 2 AS twice, v / 3 AS divided, sqrt(v) AS root, round(ln(v + 1) * 2, 6) AS own FROM o", "o")
def pointwise(spark, d):
    own = lambda v: F.round(F.log(v + 1) * 2, 6)
    return orders(spark, d).select("i", F.round(V() * 2.5, 6).alias("scaled"), (V() * 2).alias("twice"), (V() / 3).alias("divided"), F.sqrt("v").alias("root"), own(V()).alias("own"))


@query("105,108", "SELECT o.i, round(o.v * m.s, 4) AS times, round(o.v / m.s, 8) AS over FROM o, (SELECT max(v) AS s FROM c) AS m", "o", "c")
def scalar_object(spark, d):
    top = customers(spark, d).agg(F.max("v").alias("s"))
    return ar.with_scalar(orders(spark, d), top, times=lambda v, s: r4(v * s), over=lambda v, s: F.round(v / s, 8))


@query("113", "SELECT round((SELECT sum(v) FROM o) / (SELECT max(v) FROM c), 4) AS v", "o", "c")
def scalar_quotient(spark, d):
    """Two replicated scalars, one over the other."""
    return ar.scalar_op(orders(spark, d).agg(F.sum("v")), customers(spark, d).agg(F.max("v")), lambda a, b: r4(a / b))


@query("109-112", "SELECT c.i, round(c.v + x.v, 4) AS total, round(2 * c.v + x.v, 4) AS axpy, round(2 * c.v - 3 * x.v, 4) AS axbyz FROM c JOIN x USING (i)", "c", "x")
def vector_sums(spark, d):
    a, b = customers(spark, d), parts(spark, d)
    both = a.withColumnRenamed("v", "x").join(b.withColumnRenamed("v", "y"), "i")
    x, y = F.col("x"), F.col("y")
    return both.select("i", r4(x + y).alias("total"), r4(2 * x + y).alias("axpy"), r4(2 * x - 3 * y).alias("axbyz"))


@query("118", "SELECT c.i, k, round(c.v * (k + 1), 4) AS v FROM c, range(4) AS r(k)", "c")
def outer_products(spark, d):
    r = spark.range(4).select(F.col("id").alias("k"), (F.col("id") + 1).cast("double").alias("v"))
    return ar.outer_product(customers(spark, d), r, lambda v, w: r4(v * w))


# Reductions.


@query("120,121,125,127,128,137,138", "SELECT round(sum(v), 2) AS total, round(sum(v * v) / 1e6, 2) AS norm_squared, round(min(v), 4) AS least, round(max(v), 4) AS most, count(*) AS n, round(sqrt(sum(v * v)), 4) AS norm, round(sqrt(sum(v)), 4) AS root FROM o", "o")
def norms(spark, d):
    x = ar.norms(orders(spark, d))
    return x.select(F.round("total", 2).alias("total"), F.round(F.col("norm_squared") / 1e6, 2).alias("norm_squared"), r4("least").alias("least"), r4("most").alias("most"), "n", r4("norm").alias("norm"), r4("root").alias("root"))


@query("136", "SELECT bool_and(v >= 0) AS all_positive, bool_and(v >= 1000) AS all_large, count(*) FILTER (v < 0) AS negative, round(sum(v), 2) AS total FROM c", "c")
def all_reduce(spark, d):
    """Reductions to every block: logical and, whole numbers, and doubles without loss."""
    return customers(spark, d).agg(F.bool_and(V() >= 0).alias("all_positive"), F.bool_and(V() >= 1000).alias("all_large"), F.count_if(V() < 0).alias("negative"), F.round(F.sum("v"), 2).alias("total"))


@query("122,123", f"SELECT {BLOCK} AS p, round(sum(v * v) / 1e6, 3) AS norm_squared, round(sqrt(sum(v * v)), 4) AS norm FROM o, n GROUP BY 1", "o", "n")
def local_norms(spark, d):
    o = orders(spark, d)
    x = ar.norms(o, ix.block(I(), o.count(), P))
    return x.select("p", F.round(F.col("norm_squared") / 1e6, 3).alias("norm_squared"), r4("norm").alias("norm"))


@query("126,129", "SELECT round(sum(c.v * x.v), 2) AS dot FROM c JOIN x USING (i)", "c", "x")
def inner_products(spark, d):
    return ar.inner_product(customers(spark, d), parts(spark, d)).select(F.round("dot", 2).alias("dot"))


@query("124", "SELECT c.i // 200 AS p, round(sum(c.v * x.v), 2) AS dot FROM c JOIN x USING (i) GROUP BY 1", "c", "x")
def local_inner_products(spark, d):
    return ar.inner_product(customers(spark, d), parts(spark, d), ix.floor_div(I(), 200)).select("p", F.round("dot", 2).alias("dot"))


@query("132-135", "SELECT s AS flat, s AS grouped, s AS halved FROM (SELECT round(sum(v), 2) AS s FROM o)", "o")
def reduction_strategies(spark, d):
    o = orders(spark, d)
    n = max(2, o.count())
    two = lambda c: F.round("total", 2).alias(c)
    flat = o.agg(F.sum("v").alias("total")).select(two("flat"))
    grouped, halved = ar.tree_sum(o, max(2, int(n**0.5)), 1).select(two("grouped")), ar.halve(o)[-1].agg(F.sum("v").alias("total")).select(two("halved"))
    return flat.crossJoin(grouped).crossJoin(halved)


@query("205", f", b AS (SELECT {BLOCK} AS p, sum(round(v * 100)::BIGINT)::BIGINT AS l0 FROM o, n GROUP BY 1) SELECT p, l0, (sum(l0) OVER (PARTITION BY p // 2))::BIGINT AS l1, (sum(l0) OVER (PARTITION BY p // 4))::BIGINT AS l2, (sum(l0) OVER ())::BIGINT AS l3 FROM b", "o", "n")
def redundant_tree(spark, d):
    """Sums of 1, 2, 4 and 8 blocks, each held by all the blocks that it sums."""
    o = orders(spark, d)
    sums = o.groupBy(ix.block(I(), o.count(), P).alias("p")).agg(F.sum(F.round(V() * 100).cast("long")).alias("v"))
    return ar.redundant_tree(sums, 3)


@query("140", "SELECT j AS p, count(*) AS senders FROM a GROUP BY 1", "a")
def reduce_scatter(spark, d):
    return matrix(spark, d).groupBy(F.col("j").alias("p")).agg(F.count(F.lit(1)).alias("senders"))


@query("141", "SELECT i, sum(round(v * 100)::BIGINT) OVER (ORDER BY i)::BIGINT AS prefix FROM o", "o")
def prefix_sums(spark, d):
    cents = orders(spark, d).select("i", F.round(V() * 100).cast("long").alias("v"))
    return sets.prefix_sum(cents).select("i", "prefix")


@query("142", "SELECT i // 2 AS i, round(sum(v), 4) AS v FROM o GROUP BY 1", "o")
def coarsen(spark, d):
    return ar.coarsen(orders(spark, d)).select("i", r4("v").alias("v"))


@query("143,144", "SELECT i, round(m, 4) AS m, round(sqrt(m * a * b / (m1 * b + m2 * a)), 6) AS c FROM (SELECT i // 2 AS i, max(v) FILTER (i % 2 = 0) AS m1, max(v) FILTER (i % 2 = 1) AS m2, max(v) FILTER (i % 2 = 0) + max(v) FILTER (i % 2 = 1) AS m, (max(w) FILTER (i % 2 = 0)) ** 2 AS a, (max(w) FILTER (i % 2 = 1)) ** 2 AS b FROM (SELECT p_partkey AS i, p_retailprice AS v, p_size + 1.0::DOUBLE AS w FROM part) GROUP BY 1)")
def centres_of_mass(spark, d):
    p = src.table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("m"), (F.col("p_size") + 1.0).alias("c"))
    return ar.centre_of_mass(p).select("i", r4("m").alias("m"), F.round("c", 6).alias("c"))


@query("145", "SELECT 2 * c.i + k AS i, v FROM c, range(2) AS r(k)", "c")
def prolong(spark, d):
    return ar.prolong(customers(spark, d))


@query("146", "SELECT i, round(coalesce(v, 0) + coalesce(w, 0), 4) AS v FROM (SELECT 2 * c.i + k AS i, v FROM c, range(2) AS r(k)) FULL JOIN (SELECT a.i, sum(a.v * x.v) AS w FROM a JOIN x ON a.j = x.i GROUP BY 1) USING (i)", "c", "a", "x")
def sideways_down(spark, d):
    cousin = sparse.multiply(matrix(spark, d), parts(spark, d)).withColumnRenamed("v", "w")
    return ar.prolong(customers(spark, d)).join(cousin, "i", "full").select("i", r4(F.coalesce("v", F.lit(0.0)) + F.coalesce("w", F.lit(0.0))).alias("v"))


MASS = "SELECT i // 2 AS i, m1 + m2 AS m, sqrt((m1 + m2) * a * b / (m1 * b + m2 * a)) AS c FROM (SELECT i, max(m) FILTER (i % 2 = 0) OVER w AS m1, max(m) FILTER (i % 2 = 1) OVER w AS m2, (max(c) FILTER (i % 2 = 0) OVER w) ** 2 AS a, (max(c) FILTER (i % 2 = 1) OVER w) ** 2 AS b FROM {0} WINDOW w AS (PARTITION BY i // 2)) WHERE i % 2 = 0"


@query("182", f"WITH x AS (SELECT p_partkey AS i, p_retailprice AS m, p_size + 1.0::DOUBLE AS c FROM part), y AS ({MASS.format('x')}), z AS ({MASS.format('y')}) SELECT 4 * i + k AS i, round(m, 4) AS m, round(c, 6) AS c FROM z, range(4) AS r(k)")
def tree_up_down(spark, d):
    """Two levels of centres of mass up, then down to the leaves."""
    x = src.table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("m"), (F.col("p_size") + 1.0).alias("c"))
    top = ar.centre_of_mass(ar.centre_of_mass(x)).select("i", F.struct("m", "c").alias("v"))
    return ar.prolong(ar.prolong(top)).select("i", r4("v.m").alias("m"), F.round("v.c", 6).alias("c"))


# Neighbours.

LAGS = "(SELECT i, v, lag(v) OVER (ORDER BY i) AS a, lead(v) OVER (ORDER BY i) AS b FROM {0})"


@query("147,148", f"SELECT i, a AS right_shift, b AS left_shift FROM {LAGS.format('e')}", "e")
def shifts(spark, d):
    return ar.neighbours(events(spark, d), right_shift=-1, left_shift=1).drop("v")


@query("149-151,206", f"SELECT i, round(2 * v - coalesce(a, 0) - coalesce(b, 0), 6) AS v, round((2 * v - coalesce(a, 0) - coalesce(b, 0)) / 6, 6) AS damped FROM {LAGS.format('e')}", "e")
def central_difference(spark, d):
    out = ar.stencil(events(spark, d), {0: 2.0, -1: -1.0, 1: -1.0})
    return out.select("i", F.round("v", 6).alias("v"), F.round(V() / 6, 6).alias("damped"))


@query("154,156,203", f"SELECT i, round(v + coalesce(a, 0) + coalesce(b, 0), 6) AS v FROM {LAGS.format('e')}", "e")
def three_point_sum(spark, d):
    return ar.stencil(events(spark, d), {0: 1.0, -1: 1.0, 1: 1.0}).select("i", F.round("v", 6).alias("v"))


@query("155,200", "SELECT e.i, round(e.v + l.v + r.v, 6) AS v FROM e, (SELECT count(*) AS n FROM events), e AS l, e AS r WHERE l.i = (e.i + n - 1) % n AND r.i = (e.i + 1) % n", "e")
def three_point_modulo(spark, d):
    e = events(spark, d)
    return ar.stencil(e, {0: 1.0, -1: 1.0, 1: 1.0}, wrap=e.count()).select("i", F.round("v", 6).alias("v"))


@query("153", "SELECT g.i0, g.i1, round(4 * g.v - coalesce(sum(h.v), 0), 4) AS v FROM g LEFT JOIN g AS h ON abs(h.i0 - g.i0) + abs(h.i1 - g.i1) = 1 GROUP BY g.i0, g.i1, g.v", "g")
def central_difference_2d(spark, d):
    g, shape = grid(spark, d)
    cross = {(0, 0): 4.0, (-1, 0): -1.0, (1, 0): -1.0, (0, -1): -1.0, (0, 1): -1.0}
    return ar.stencil_nd(g, ["i0", "i1"], cross, shape).select("i0", "i1", r4("v").alias("v"))


NINE = {(a, b): 8.0 if a == b == 0 else -1.0 for a in (-1, 0, 1) for b in (-1, 0, 1)}


@query("157", "SELECT g.i0, g.i1, round(9 * g.v - sum(h.v), 4) AS v FROM g JOIN g AS h ON abs(h.i0 - g.i0) <= 1 AND abs(h.i1 - g.i1) <= 1 GROUP BY g.i0, g.i1, g.v", "g")
def bilinear_laplacian(spark, d):
    g, shape = grid(spark, d)
    return ar.stencil_nd(g, ["i0", "i1"], NINE, shape).select("i0", "i1", r4("v").alias("v"))


STEP = "SELECT g.i0, g.i1, 9 * g.v - sum(h.v) AS v FROM {0} AS g JOIN {0} AS h ON abs(h.i0 - g.i0) <= 1 AND abs(h.i1 - g.i1) <= 1 GROUP BY g.i0, g.i1, g.v"


@query("181", f", k AS ({STEP.format('g')}), l AS ({STEP.format('k')}) SELECT i0, i1, round(v, 3) AS v FROM l", "g")
def grid_evolution(spark, d):
    g, shape = grid(spark, d)
    for _ in range(2):
        g = ar.stencil_nd(g, ["i0", "i1"], NINE, shape)
    return g.select("i0", "i1", F.round("v", 3).alias("v"))


@query("212", f", m AS (SELECT max(i0) AS m0 FROM g), u AS (SELECT i0, i1, v, least(i0, i1, m0 - i0, {GRID - 1} - i1) AS deep FROM g, m) SELECT i0, i1, round(CASE WHEN deep >= 1 THEN s ELSE v END, 4) AS one, round(CASE WHEN deep >= 3 THEN s ELSE v END, 4) AS three FROM (SELECT a.i0, a.i1, a.v, a.deep, (a.v + coalesce(sum(b.v), 0)) / 5 AS s FROM u AS a LEFT JOIN u AS b ON abs(a.i0 - b.i0) + abs(a.i1 - b.i1) = 1 GROUP BY a.i0, a.i1, a.v, a.deep)", "g")
def five_point_borders(spark, d):
    """Two independent five-point updates of one grid, with borders of one and of three cells left alone."""
    g, shape = grid(spark, d)
    cross = {(0, 0): 0.2, (-1, 0): 0.2, (1, 0): 0.2, (0, -1): 0.2, (0, 1): 0.2}
    a, b = F.col("i0"), F.col("i1")
    deep = F.least(a, b, shape[0] - 1 - a, shape[1] - 1 - b)
    both = g.join(ar.stencil_nd(g, ["i0", "i1"], cross, shape).withColumnRenamed("v", "s"), ["i0", "i1"])
    return both.select("i0", "i1", *[r4(F.when(deep >= k, F.col("s")).otherwise(F.col("v"))).alias(name) for k, name in ((1, "one"), (3, "three"))])


# Mesh.


@query("160", "SELECT 2 * i0 + a AS i0, 2 * i1 + b AS i1, v FROM g, range(2) AS r(a), range(2) AS s(b)", "g")
def element_to_local(spark, d):
    return mesh.element_to_local(grid(spark, d)[0], ["i0", "i1"])


@query("161", "SELECT (i0 + 1) // 2 AS i0, (i1 + 1) // 2 AS i1, round(sum(v), 4) AS v FROM g GROUP BY 1, 2", "g")
def local_to_global(spark, d):
    return mesh.local_to_global(grid(spark, d)[0], ["i0", "i1"]).select("i0", "i1", r4("v").alias("v"))


@query("161", "SELECT 2 * (i // 4 + (i % 4 >= 2)::INT) + i % 2 AS i, round(sum(v), 4) AS v FROM o GROUP BY 1", "o")
def pairs_to_global(spark, d):
    """The rule of one dimension: local entries two apart add up."""
    return mesh.pairs_to_global(orders(spark, d)).select("i", r4("v").alias("v"))


@query("162", "SELECT l0 AS i0, l1 AS i1, v FROM (SELECT 2 * i0 - 1 + a AS l0, 2 * i1 - 1 + b AS l1, v FROM g, range(2) AS r(a), range(2) AS s(b)), (SELECT max(i0) AS m0, max(i1) AS m1 FROM g) WHERE l0 >= 0 AND l1 >= 0 AND l0 < 2 * m0 AND l1 < 2 * m1", "g")
def global_to_local(spark, d):
    g, shape = grid(spark, d)
    return mesh.global_to_local(g, ["i0", "i1"], [n - 1 for n in shape])


@query("163", "SELECT i0 // 2 AS i0, i1 // 2 AS i1, round(avg(v), 4) AS v FROM g GROUP BY 1, 2", "g")
def local_to_element(spark, d):
    return mesh.local_to_element(grid(spark, d)[0], ["i0", "i1"]).select("i0", "i1", r4("v").alias("v"))


@query("158", f"SELECT i, round(4 * v + 2 * coalesce(a, 0) + 2 * coalesce(b, 0), 4) AS v FROM {LAGS.format('e')}", "e")
def fourth_order(spark, d):
    """Elements to local entries, to nodes, and back to elements."""
    e = events(spark, d)
    return mesh.fourth_order(e, e.count()).select("i", r4("v").alias("v"))


@query("185", ", m AS (SELECT max(i0) AS m0, max(i1) AS m1 FROM g), l AS (SELECT 2 * i0 + a AS i0, 2 * i1 + b AS i1, v FROM g, range(2) AS r(a), range(2) AS s(b)), q AS (SELECT (i0 + 1) // 2 AS i0, (i1 + 1) // 2 AS i1, sum(v) AS v FROM l GROUP BY 1, 2) SELECT (2 * i0 - 1 + a) // 2 AS i0, (2 * i1 - 1 + b) // 2 AS i1, round(avg(v), 4) AS v FROM q, range(2) AS r(a), range(2) AS s(b), m WHERE 2 * i0 - 1 + a >= 0 AND 2 * i1 - 1 + b >= 0 AND 2 * i0 - 1 + a < 2 * m0 + 2 AND 2 * i1 - 1 + b < 2 * m1 + 2 GROUP BY 1, 2", "g")
def mesh_exchange(spark, d):
    g, shape = grid(spark, d)
    return mesh.exchange(g, ["i0", "i1"], shape).select("i0", "i1", r4("v").alias("v"))


# Sparse matrices.


@query("164,207", "SELECT i, v FROM (SELECT i, sum(v) AS v FROM a GROUP BY 1)", "a")
def sparse_row_sums(spark, d):
    return sparse.row_sums(matrix(spark, d))


@query("165,166", "SELECT a.i, round(sum(a.v * x.v), 4) AS v FROM a JOIN x ON a.j = x.i GROUP BY 1", "a", "x")
def sparse_multiply(spark, d):
    return sparse.multiply(matrix(spark, d), parts(spark, d)).select("i", r4("v").alias("v"))


@query("167", "SELECT DISTINCT j FROM a WHERE i < (SELECT count(*) // 10 FROM orders)", "a")
def sparse_columns(spark, d):
    return sparse.columns(matrix(spark, d).where(I() < orders(spark, d).count() // 10))


@query("167", "SELECT DISTINCT j FROM a", "a")
def sparse_columns_all(spark, d):
    """The columns of the whole matrix; sparse_columns has those of wanted rows."""
    return sparse.columns(matrix(spark, d))


@query("168", "SELECT j AS i, i AS j, v FROM a", "a")
def sparse_transpose(spark, d):
    return sparse.transpose(matrix(spark, d))


@query("169,206", "SELECT i, j, v FROM (SELECT i, i + d AS j, b.v, n FROM c, (SELECT count(*) AS n FROM c), (VALUES (-1, -1.0), (0, 2.0), (1, -1.0)) AS b(d, v)) WHERE j >= 0 AND j < n", "c")
def toeplitz(spark, d):
    return src.toeplitz(spark, customers(spark, d).count())


@query("169", "SELECT i, j, v, up FROM (SELECT i, i + d AS j, b.v, up, n FROM c, (SELECT count(*) AS n FROM c), (VALUES (0, 2.0, true), (1, -1.0, true), (0, 2.0, false), (-1, -1.0, false)) AS b(d, v, up)) WHERE j >= 0 AND j < n", "c")
def bidiagonals(spark, d):
    n = customers(spark, d).count()
    up, low = src.banded(spark, n, {0: 2.0, 1: -1.0}), src.banded(spark, n, {0: 2.0, -1: -1.0})
    return up.withColumn("up", F.lit(True)).union(low.withColumn("up", F.lit(False)))


@query("170", "SELECT i0 AS i, i1 AS j, 2 * (i1 * n + i0)::DOUBLE AS v FROM (SELECT a.s_suppkey AS i0, b.s_suppkey AS i1 FROM supplier AS a, supplier AS b), (SELECT count(*) AS n FROM supplier)")
def dense_transpose(spark, d):
    """A dense matrix of row-major numbers, its transpose added twice."""
    n = src.table(spark, d, "supplier").count()
    a = src.linear_fill(spark, [n, n]).select(F.col("i0").alias("i"), F.col("i1").alias("j"), "v")
    return sparse.repeat(sparse.transpose(a), 2)


@query("165,168", "SELECT b.j AS i, round(sum(b.v * a.v), 4) AS v FROM a JOIN a AS b USING (i) WHERE a.j = 1 GROUP BY 1", "a")
def normal_column(spark, d):
    """A column of the product of the transpose and the matrix itself."""
    a = matrix(spark, d)
    one = a.where("j = 1").select("i", F.lit(0).cast("long").alias("j"), "v")
    return sparse.product(sparse.transpose(a), one).select("i", r4("v").alias("v"))


@query("159", f"SELECT i, round(n.v + w.v, 4) AS v FROM (SELECT i, 2 * y.v - coalesce(y.a, 0) - coalesce(y.b, 0) AS v FROM (SELECT i, v, lag(v) OVER (ORDER BY i) AS a, lead(v) OVER (ORDER BY i) AS b FROM (SELECT i, 2 * v - coalesce(a, 0) - coalesce(b, 0) AS v FROM {LAGS.format('c')})) AS y) AS n JOIN (SELECT c.i, sum(d.v) AS v FROM c JOIN c AS d ON abs(c.i - d.i) <= 2 GROUP BY 1) AS w USING (i)", "c")
def narrow_and_wide(spark, d):
    x = customers(spark, d)
    n = x.count()
    narrow = src.toeplitz(spark, n)
    wide = src.banded(spark, n, {k: 1.0 for k in range(-2, 3)})
    return ar.combine(sparse.multiply(narrow, sparse.multiply(narrow, x)), sparse.multiply(wide, x), lambda a, b: r4(a + b))


# Clusters.

CENTRES = "k AS (SELECT label::BIGINT AS k, list(embedding ORDER BY vec_id)[1] AS c FROM embeddings GROUP BY 1)"
DIST = "sqrt(list_sum([(p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE) for p in list_zip(embedding, c)]))"


def points(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = src.table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("long").alias("label"))
    centres = e.groupBy(F.col("label").alias("k")).agg(F.min_by("x", "i").alias("c"))
    return e.select("i", "x"), cut(centres)


@query("171", f"WITH {CENTRES} SELECT vec_id AS i, k, round({DIST}, 6) AS d FROM embeddings, k")
def kmeans_distances(spark, d):
    return cluster.distances(*points(spark, d)).select("i", "k", F.round("d", 6).alias("d"))


@query("172", f"WITH {CENTRES}, d AS (SELECT vec_id AS i, k, {DIST} AS d FROM embeddings, k) SELECT i, k, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, k) AS r FROM d) WHERE r = 1")
def kmeans_assign(spark, d):
    return cluster.assign(*points(spark, d)).select("i", "k", F.round("d", 6).alias("d"))


@query("173", f"WITH {CENTRES}, d AS (SELECT vec_id AS i, k, {DIST} AS d FROM embeddings, k), b AS (SELECT i, k FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, k) AS r FROM d) WHERE r = 1) SELECT b.i, k.k, CASE WHEN b.k = k.k THEN 1 ELSE -1 END AS flag FROM b, k")
def kmeans_mask(spark, d):
    p, c = points(spark, d)
    return cluster.mask(cluster.assign(p, c), c)


MEANS = f"WITH {CENTRES}, d AS (SELECT vec_id AS i, k, embedding, {DIST} AS d FROM embeddings, k), b AS (SELECT i, k, embedding FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, k) AS r FROM d) WHERE r = 1), f AS (SELECT k, unnest(range(64)) AS c, unnest(embedding) AS v FROM b)"


@query("174,175,204", MEANS + " SELECT k, c, count(*) AS n, round(sum(v::DOUBLE), 6) AS s FROM f GROUP BY 1, 2")
def kmeans_masked_sum(spark, d):
    p, c = points(spark, d)
    return cluster.masked_sum(cluster.assign(p, c)).select("k", F.col("c").cast("long").alias("c"), "n", F.round("s", 6).alias("s"))


@query("174", MEANS + " SELECT k, c, round(avg(v::DOUBLE), 6) AS m FROM f GROUP BY 1, 2")
def kmeans_centres(spark, d):
    p, c = points(spark, d)
    return cluster.new_centres(cluster.assign(p, c)).select("k", F.posexplode("c").alias("c", "m")).select("k", F.col("c").cast("long").alias("c"), F.round("m", 6).alias("m"))


ROUNDS = 3
ROUND = ", ".join(
    f"a{r} AS (SELECT vec_id AS i, k, {DIST} AS d FROM embeddings, k{r}), b{r} AS (SELECT i, k FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, k) AS n FROM a{r}) WHERE n = 1), "
    f"k{r + 1} AS (SELECT k, list(m ORDER BY c) AS c FROM (SELECT k, c, avg(v::DOUBLE) AS m FROM (SELECT k, unnest(range(64)) AS c, unnest(embedding) AS v FROM b{r} JOIN embeddings ON vec_id = i) GROUP BY 1, 2) GROUP BY 1)"
    for r in range(ROUNDS)
)


@query("171-175", f"WITH {CENTRES.replace('k AS', 'k0 AS', 1)}, {ROUND} SELECT k, c, round(m, 5) AS m FROM (SELECT k, unnest(range(64)) AS c, unnest(c) AS m FROM k{ROUNDS})")
def kmeans_rounds(spark, d):
    p, c = points(spark, d)
    return cluster.kmeans(p, c, ROUNDS).select("k", F.posexplode("c").alias("c", "m")).select("k", F.col("c").cast("long").alias("c"), F.round("m", 5).alias("m"))


@query("201", "SELECT c, round(sum(v::DOUBLE), 6) AS v FROM (SELECT unnest(range(64)) AS c, unnest(embedding) AS v FROM embeddings) GROUP BY 1")
def component_sums(spark, d):
    e = src.table(spark, d, "embeddings").select(F.posexplode("embedding").alias("c", "v"))
    return e.groupBy(F.col("c").cast("long").alias("c")).agg(F.round(F.sum(F.col("v").cast("double")), 6).alias("v"))


@query("183", "WITH p AS (SELECT s_suppkey AS i, s_acctbal AS x, s_nationkey + 1.0 AS m FROM supplier) SELECT a.i, round(sum(b.m / (1 + abs(a.x - b.x))), 6) AS v FROM p AS a JOIN p AS b ON a.i <> b.i GROUP BY 1")
def all_pairs(spark, d):
    p = src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") + 1.0).alias("m"))
    out = keyed.all_pairs(p, lambda x, xj, mj: mj / (1 + np.abs(x - xj)))
    return out.select("i", F.round("v", 6).alias("v"))


# Iterations.


TRI = "SELECT i, {0} AS v FROM (SELECT x.i, x.v, lag(x.v) OVER (ORDER BY x.i) AS a, lead(x.v) OVER (ORDER BY x.i) AS b, 2 + c.v / 10000 AS w FROM {1} AS x JOIN c USING (i))"
APPLY = "w * v - coalesce(a, 0) - coalesce(b, 0)"
POWER = ", ".join(f"y{k} AS ({TRI.format(APPLY, f'x{k}')}), x{k + 1} AS (SELECT i, v / sqrt((SELECT sum(v * v) FROM y{k})) AS v FROM y{k})" for k in range(4))


def banded_customers(spark: SparkSession, d: str) -> DataFrame:
    """A symmetric matrix of three diagonals, the middle one from the table."""
    c = customers(spark, d)
    middle = c.select("i", I().alias("j"), (2 + V() / 10000).alias("v"))
    sides = src.banded(spark, c.count(), {-1: -1.0, 1: -1.0})
    return sparse.build(middle.union(sides))


@query("176", f", x0 AS (SELECT i, 1.0::DOUBLE AS v FROM c), {POWER} SELECT i, round(v, 8) AS v, round(sqrt((SELECT sum(v * v) FROM y3)), 6) AS norm FROM x4", "c")
def power_method(spark, d):
    """Four steps on a matrix from the table: the vector and the last norm."""
    a = cut(banded_customers(spark, d))
    x, norms_ = solvers.power_method(a, src.generate(spark, customers(spark, d).count(), 1.0), 4)
    return x.select("i", F.round("v", 8).alias("v"), F.lit(round(norms_[-1], 6)).alias("norm"))


def tilted(spark: SparkSession, d: str):
    """(apply, b, customers): a positive definite operator and its value at the balances over 1000."""
    c = customers(spark, d)
    n = c.count()
    diagonal = 4 + F.pmod(I(), F.lit(7)).cast("double")
    sides = {-1: -1.0, 1: -1.0}

    def apply(x: DataFrame) -> DataFrame:
        near_ = ar.neighbours(x, a=-1, b=1)
        zero = lambda name: F.coalesce(name, F.lit(0.0))
        return near_.select("i", (diagonal * V() + sides[-1] * zero("a") + sides[1] * zero("b")).alias("v"))

    return apply, apply(c.select("i", (V() / 1000).alias("v"))), diagonal, n


SOLUTION = "SELECT i, round(v / 1000, 6) AS v FROM c"


@query("177", SOLUTION, "c")
def conjugate_gradients(spark, d):
    """A system whose solution is known from the table, by conjugate gradients without a preconditioner."""
    apply, b, _, _ = tilted(spark, d)
    x, _ = solvers.conjugate_gradients(apply, b, 30, 1e-11)
    return x.select("i", F.round("v", 6).alias("v"))


@query("115,177", SOLUTION, "c")
def preconditioned_gradients(spark, d):
    """The same preconditioned by the diagonal."""
    apply, b, diagonal, _ = tilted(spark, d)
    x, _ = solvers.conjugate_gradients(apply, b, 30, 1e-11, precondition=lambda r: r / diagonal)
    return x.select("i", F.round("v", 6).alias("v"))


@query("178", SOLUTION, "c")
def fused_gradients(spark, d):
    """The same by other recurrences, with one reduction a step."""
    apply, b, _, _ = tilted(spark, d)
    x, _ = solvers.fused_conjugate_gradients(apply, b, 30, 1e-11)
    return x.select("i", F.round("v", 6).alias("v"))


@query("179", "WITH RECURSIVE x AS (SELECT 0 AS k, c_custkey AS i, CASE WHEN c_custkey = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM customer UNION ALL SELECT k + 1, i, 2 * v / 6 - coalesce(lag(v) OVER (ORDER BY i), 0) / 6 - coalesce(lead(v) OVER (ORDER BY i), 0) / 6 FROM x WHERE k < 4) SELECT i, round(v, 9) + 0.0 AS v FROM x WHERE k = 4")
def heat(spark, d):
    return solvers.heat(src.delta(spark, customers(spark, d).count()), 4).select("i", (F.round("v", 9) + 0.0).alias("v"))


@query("180,210", "WITH RECURSIVE x AS (SELECT 0 AS k, event_id AS i, value AS v FROM events UNION ALL SELECT k + 1, i, 2 * v - coalesce(lag(v) OVER (ORDER BY i), 0) - coalesce(lead(v) OVER (ORDER BY i), 0) FROM x WHERE k < 3) SELECT i, round(v, 5) AS v FROM x WHERE k = 3")
def s_step_halo(spark, d):
    ship(spark)
    return ar.s_steps(events(spark, d), {0: 2.0, -1: -1.0, 1: -1.0}, 3, chunk=2048).select("i", F.round("v", 5).alias("v"))


# Keyed operators.


@query("186", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def map_rows(spark, d):
    x = src.table(spark, d, "lineitem")
    return keyed.map_rows(x, l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber"), net=r4(F.col("l_extendedprice") * (1 - F.col("l_discount"))))


@query("187", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
def flat_map(spark, d):
    return keyed.flat_map(src.table(spark, d, "part"), F.split("p_type", " "), "word", ["p_partkey"])


@query("188", "SELECT c_custkey, round(c_acctbal * 1.1, 4) AS v FROM customer")
def map_blocks(spark, d):
    ship(spark)

    def raise_(batches):
        for x in batches:
            yield x.assign(v=(x["c_acctbal"] * 1.1).round(4))[["c_custkey", "v"]]

    return keyed.map_blocks(src.table(spark, d, "customer").select("c_custkey", "c_acctbal"), raise_, "c_custkey long, v double")


@query("189", "SELECT c_custkey // 100 AS block, count(*) AS n, round(max(c_acctbal), 4) AS most FROM customer GROUP BY 1")
def map_blocks_indexed(spark, d):
    ship(spark)
    import pandas as pd

    f = lambda p, x: pd.DataFrame({"block": [p], "n": [len(x)], "most": [round(x["c_acctbal"].max(), 4)]})
    return keyed.map_blocks_indexed(src.table(spark, d, "customer").select("c_custkey", "c_acctbal"), ix.floor_div(F.col("c_custkey"), 100), f, "block long, n long, most double")


@query("190", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10 AND l_shipdate >= TIMESTAMP '1995-01-01'")
def filter_rows(spark, d):
    x = src.table(spark, d, "lineitem")
    return x.where((F.col("l_quantity") < 10) & (F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp"))).select("l_orderkey", "l_linenumber")


@query("191", "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_rows(spark, d):
    return src.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")).unionByName(src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))


@query("192", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersection(spark, d):
    return src.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(src.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("193", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, d):
    return src.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("194", "SELECT conv_id, array_to_string(list(role ORDER BY turn), ',') AS roles FROM conversations GROUP BY 1")
def group_by_key(spark, d):
    x = src.table(spark, d, "conversations").select("conv_id", F.struct("turn", "role").alias("r"))
    return keyed.group_by_key(x, "conv_id", "r", "all").select("conv_id", F.array_join(F.col("all.role"), ",").alias("roles"))


@query("195", "SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1")
def reduce_by_key(spark, d):
    return keyed.reduce_by_key(src.table(spark, d, "lineitem"), "l_suppkey", n=F.count(F.lit(1)), quantity=F.sum("l_quantity"), revenue=F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2))


@query("195", "SELECT l_returnflag, sum(l_quantity) AS total FROM lineitem GROUP BY 1")
def reduce_by_key_salted(spark, d):
    return keyed.salted_sum(src.table(spark, d, "lineitem"), "l_returnflag", F.col("l_quantity"))


@query("196", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sort_by_key(spark, d):
    return keyed.sort_by_key(src.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey")


@query("197", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_by_key(spark, d):
    o = src.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice")
    c = src.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    joined = keyed.join_by_key(o, c, "k")
    nation = src.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    named = keyed.join_by_key(joined, nation, "c_nationkey")
    return named.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
