"""Every catalog query against its SQL on the smallest tables."""

import duckdb
import pytest

from arrayloom.plans import catalog
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda x: round(float(x), 6) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted((tuple(plain(r[k]) for k in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, sql, name):
    got = catalog.QUERIES[name](spark, SMALL)
    want = sql.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_inventory_is_covered():
    numbers = set()
    for text in catalog.COVERS.values():
        for part in text.split(","):
            low, _, high = part.partition("-")
            numbers |= set(range(int(low), int(high or low) + 1))
    assert set(range(1, 213)) == numbers
    assert not set(catalog.QUERIES) - set(catalog.COVERS)


def test_balance_keeps_the_total():
    from arrayloom.operators.distribution import balance, stretch

    rounds = balance([25] * 4, lambda step, first, size: size * (1 + first), 5)
    assert all(sum(r) == 100 and min(r) >= 1 for r in rounds)
    assert sum(stretch([10, 18, 26], 37)) == 37


def test_every_index_has_an_owner(spark):
    folder = "/root/testdata/sf0.01"  # 1500 customers, beyond the 1202 indices of 400 blocks
    got = {r["i"]: r["p"] for r in catalog.QUERIES["blocks_first_owner_all"](spark, folder).collect()}
    wanted = [r["i"] for r in catalog.customers(spark, folder).select("i").collect()]
    assert max(wanted) > 1202
    assert got == {i: max(0, -(-(i - 4) // 3)) for i in wanted}


def test_every_column_and_every_half_is_there(spark):
    folder = "/root/testdata/sf0.01"  # 15,000 orders: 7500 halves, beyond the 1000 of redistribute
    columns = {r["j"] for r in catalog.QUERIES["sparse_columns_all"](spark, folder).collect()}
    assert columns == {r[0] for r in spark.read.parquet(f"{folder}/lineitem.parquet").select("l_partkey").distinct().collect()}
    halves = sorted(r["i"] for r in catalog.QUERIES["redistribute_all"](spark, folder).collect())
    keys = [r["i"] for r in catalog.orders(spark, folder).select("i").collect()]
    assert len(halves) > 1000 and halves == sorted(i // 2 for i in keys if i % 2 == 0)


def test_owner_of_overlapping_blocks(spark):
    from arrayloom.operators.distribution import owner

    blocks = [(0, 5, 3), (1, 2, 30), (2, 0, 0), (3, 0, 64), (4, 70, 1)]
    table = spark.createDataFrame(blocks, "p long, first long, size long")
    got = {r["i"]: r["p"] for r in owner(spark.range(80).withColumnRenamed("id", "i"), table, 8).collect()}
    held = {i: [p for p, a, n in blocks if a <= i < a + n] for i in range(80)}
    assert got == {i: min(ps) for i, ps in held.items() if ps}


def test_union_and_extension_by_process(spark):
    from arrayloom.operators.distribution import extend, union

    a, b = (spark.createDataFrame(r, "p long, i long") for r in ([(0, 1), (1, 2)], [(0, 1), (0, 2)]))
    got = extend(union(a, b), 1, spark.range(2, 4).withColumnRenamed("id", "i"))
    assert sorted(map(tuple, got.collect())) == [(0, 1), (0, 2), (1, 2), (1, 3)]


@pytest.mark.parametrize("n", [1, 2, 37])
def test_halves_until_one(spark, n):
    from arrayloom.operators.arrays import halve

    levels = halve(spark.range(n).selectExpr("id AS i", "cast(id AS double) AS v"))
    assert len(levels) == (n - 1).bit_length() + 1
    assert [tuple(r) for r in levels[-1].collect()] == [(0, n * (n - 1) / 2)]


def test_reduction_query_halves_until_one(spark, monkeypatch):
    called = []
    coarsen = catalog.ar.coarsen
    monkeypatch.setattr(catalog.ar, "coarsen", lambda x: called.append(1) or coarsen(x))
    last = catalog.orders(spark, SMALL).agg({"i": "max"}).first()[0]
    catalog.QUERIES["reduction_strategies"](spark, SMALL)
    assert len(called) == last.bit_length()


def test_random_coordinates(spark):
    from arrayloom.sources.arrays import random_coordinates

    one = sorted(map(tuple, random_coordinates(spark, 1000).collect()))
    assert one == sorted(map(tuple, random_coordinates(spark, 1000).repartition(3).collect()))
    for k in (1, 2):
        c = [r[k] for r in one]
        assert len(set(c)) == 1000 and 0 <= min(c) and max(c) < 1 and abs(sum(c) / 1000 - 0.5) < 0.05


def numbered(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, v double")


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_levels_of_index_sets(spark, monkeypatch, chunk):
    """Places, running sums and gaps over several levels of chunks."""
    from arrayloom.operators import sets

    monkeypatch.setattr(sets, "CHUNK", 2)
    have = sorted({k * k % 211 for k in range(40)} | {500, 501, -7})
    frame = spark.createDataFrame([(i, i + 1) for i in have], "i long, v long")
    assert sorted((r["i"], r["rank"]) for r in sets.rank(frame, chunk=chunk).collect()) == [(i, k) for k, i in enumerate(have)]
    assert sorted((r["i"], r["prefix"]) for r in sets.prefix_sum(frame, chunk=chunk).collect()) == [(i, sum(x + 1 for x in have[: k + 1])) for k, i in enumerate(have)]
    assert sorted((r["i"], r["previous"]) for r in sets.previous(frame, chunk=chunk).collect()) == list(zip(have, [None, *have], strict=False))
    for k in (0, 5, len(have) - 1):
        assert [r["i"] for r in sets.ith(frame, k, chunk).collect()] == [have[k]]
    assert sets.ith(frame, len(have), chunk).count() == 0
    for gap in (0, 2):
        want, run = [], [have[0]]
        for i in have[1:]:
            if i - run[-1] > gap + 1:
                want.append((run[0], run[-1], len(run)))
                run = []
            run.append(i)
        want.append((run[0], run[-1], len(run)))
        got = sets.over_simplify(frame, gap) if gap else sets.pieces(frame)
        assert sorted(tuple(r[c] for c in ("first", "last", "size")) for r in got.collect()) == want


def test_stencils_over_small_tiles_and_around_the_ends(spark):
    import numpy as np

    from arrayloom.operators import arrays

    rng = np.random.default_rng(1)
    a = rng.integers(0, 9, (7, 11, 5)).astype(float)
    weights = {(0, 0, 0): 2.0, (-1, 0, 0): 1.0, (0, 2, 0): -3.0, (1, -1, 1): 0.5}
    want = np.zeros_like(a)
    for at in np.ndindex(a.shape):
        for off, w in weights.items():
            to = tuple(np.add(at, off))
            if all(0 <= x < n for x, n in zip(to, a.shape, strict=True)):
                want[at] += w * a[to]
    rows = spark.createDataFrame([(*map(int, at), float(a[at])) for at in np.ndindex(a.shape)], "i0 long, i1 long, i2 long, v double")
    for tile in (2, 4, 256):
        got = arrays.stencil_nd(rows, ["i0", "i1", "i2"], weights, list(a.shape), tile).collect()
        assert {(r["i0"], r["i1"], r["i2"]): r["v"] for r in got} == {tuple(map(int, at)): want[at] for at in np.ndindex(a.shape)}
    x = rng.integers(0, 9, 13).astype(float)
    for chunk in (3, 100):
        got = {r["i"]: r["v"] for r in arrays.stencil(numbered(spark, x), {0: 1.0, -2: 10.0, 1: 100.0}, chunk, wrap=13).collect()}
        assert got == {i: x[i] + 10 * x[(i - 2) % 13] + 100 * x[(i + 1) % 13] for i in range(13)}


def test_products_with_a_vector_beyond_a_broadcast(spark, monkeypatch):
    from arrayloom.operators import sparse

    a = spark.createDataFrame([(i, 0 if i % 2 else i % 5, float(i)) for i in range(60)], "i long, j long, v double")
    x = numbered(spark, [3, 1, 4, 1, 5])
    want = sorted(map(tuple, sparse.multiply(a, x).collect()))
    monkeypatch.setattr(sparse, "small", lambda df: False)
    assert sorted(map(tuple, sparse.multiply(a, x).collect())) == want and len(want) == 60


def test_copies_of_a_vector_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(catalog.sparse, "small", lambda df: False)
    out = catalog.QUERIES["sparse_multiply"](spark, SMALL)
    assert out.count() > 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_all_pairs_of_many_small_blocks(spark, sql, monkeypatch):
    import numpy as np

    from arrayloom.operators import keyed

    bodies = [(k, None if k % 7 == 3 else float(k * k % 11), None if k % 5 == 4 else k / 2) for k in range(40)]
    bodies += [(3, 2.0, 1.0), (None, 1.0, 1.0), (41, float("inf"), 2.0), (42, float("inf"), 3.0)]
    frame = spark.createDataFrame(bodies, "i long, x double, m double").coalesce(1)
    sql.execute("CREATE OR REPLACE TEMP TABLE bodies (i BIGINT, x DOUBLE, m DOUBLE)")
    sql.executemany("INSERT INTO bodies VALUES (?, ?, ?)", bodies)
    want = sql.sql("SELECT a.i, sum(b.m / (1 + abs(a.x - b.x))) AS v FROM bodies AS a JOIN bodies AS b ON a.i <> b.i GROUP BY 1")
    want = repr(rows(want.columns, want.fetchall()))  # nan is not equal to nan
    force = lambda x, xj, mj: mj / (1 + np.abs(x - xj))
    for block_rows, tile in ((6, 2), (1000, 500)):
        monkeypatch.setattr(keyed, "TILE", tile)
        out = keyed.all_pairs(frame, force, block_rows)
        assert repr(rows(out.columns, out.collect())) == want
    assert keyed.all_pairs(frame.where("i = 3"), force).count() == keyed.all_pairs(frame.limit(0), force).count() == 0


def test_all_pairs_are_dealt_by_their_blocks(spark):
    """One file of points makes a task for each pair of blocks, and no copies are broadcast."""
    from arrayloom.operators import keyed

    frame = spark.range(40).selectExpr("id AS i", "cast(id AS double) AS x", "1.0D AS m").coalesce(1)
    plan = keyed.all_pairs(frame, lambda x, xj, mj: mj + 0 * (x - xj), 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 16), REPARTITION_BY_NUM") == 2 and "BroadcastExchange" not in plan


def test_dense_transpose_exchanges_nothing(spark, monkeypatch):
    monkeypatch.setattr(catalog.src, "SLICE", 30)
    out = catalog.QUERIES["dense_transpose"](spark, SMALL)  # 10 suppliers
    assert sorted(map(tuple, out.select("i", "j", "v").collect())) == [(i, j, 2.0 * (10 * j + i)) for i in range(10) for j in range(10)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and catalog.src.linear_fill(spark, [10, 20]).rdd.getNumPartitions() == 7


def test_sideways_down_with_a_long_vector(spark, sql, monkeypatch):
    monkeypatch.setattr(catalog.sparse, "small", lambda df: False)
    out, want = catalog.QUERIES["sideways_down"](spark, SMALL), sql.sql(catalog.SQL["sideways_down"])
    assert rows(out.columns, out.collect()) == rows(want.columns, want.fetchall())
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_clusters_in_several_turns(spark):
    import numpy as np

    from arrayloom.operators import cluster

    rng = np.random.default_rng(2)
    p, c = rng.integers(0, 6, (90, 3)).astype(float), rng.integers(0, 6, (20, 3)).astype(float)
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "i long, x array<double>")
    centres = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(c)], "k long, c array<double>")
    far = np.sqrt(((p[:, None] - c[None]) ** 2).sum(2))
    for most in (3, 100):
        assert {r["i"]: (r["k"], r["d"]) for r in cluster.assign(points, centres, most).collect()} == {i: (int(row.argmin()), row.min()) for i, row in enumerate(far)}
        assert {(r["i"], r["k"]): r["d"] for r in cluster.distances(points, centres, most).collect()} == {(i, k): far[i, k] for i in range(90) for k in range(20)}
    assert cluster.assign(points.limit(0), centres).count() == 0


def test_avoidance_trades_points_for_messages():
    from arrayloom.operators.distribution import avoidance_cost

    assert avoidance_cost(4, 100, 6, 1) == {"messages": 36, "plain": 36, "points": 2400, "plain_points": 2400}
    assert avoidance_cost(4, 100, 6, 3) == {"messages": 12, "plain": 36, "points": 2400 + 2 * 2 * 3 * (0 + 1 + 2), "plain_points": 2400}


def test_plan_as_a_graph(spark):
    from arrayloom.plans.graph import dot, nodes

    df = spark.range(10).groupBy((catalog.F.col("id") % 3).alias("k")).count()
    text, n = dot(df), len(nodes(df))
    assert text.startswith("digraph plan {") and text.count("label=") == n and text.count("->") == n - 1 and "Exchange" in text


def test_stream(spark, tmp_path):
    from arrayloom.streaming.blocks import running_norms

    spark.range(40).selectExpr("id AS i", "cast(1 AS double) AS v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i long, v double").parquet(str(tmp_path / "in"))
    query = running_norms(stream, 10).writeStream.outputMode("complete").format("memory").queryName("blocks").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in spark.table("blocks").collect()) == [(p, 10.0, 10.0, 10) for p in range(4)]
