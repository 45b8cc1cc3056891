"""Exact top-k by inner product: queries and data in cover trees, traversed together.

The trees' upper levels are tables: rows go to the nearest of some sampled centres, and
each cell, or part of a large one, is a block with its centre and covering radius.  Each
query block first visits its nearest data block, which gives every query a kth score;
then it visits those data blocks alone whose bound reaches the worst of these.  In a
pair of blocks, a dual search goes down both trees in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.llm._common import arrow_map, bounded, cut, spread

LEAF = 48
DATA_BLOCK = 8192
QUERY_BLOCK = 2048
#: Centres at most; larger cells are blocks in parts.
CENTRES = 4096
_NONE = np.iinfo(np.int64).min


class Node:
    """A cover-tree node: a centre, its covering radius, and children or rows."""

    __slots__ = ("centre", "radius", "norm", "kids", "rows")

    def __init__(self, centre: np.ndarray, radius: float, kids: list["Node"], rows: np.ndarray) -> None:
        self.centre, self.radius, self.kids, self.rows = centre, radius, kids, rows
        self.norm = float(np.sqrt(centre @ centre))


def cover_tree(points: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Node:
    """The cover tree of ``points[rows]``; built level by level, without recursion.

    The children of a node are a greedy net of its points at half its radius: every
    point goes to the first centre within that distance, and centres lie further
    apart than it.
    """
    root = _node(points, rows)
    todo = [root]
    while todo:
        node = todo.pop()
        if len(node.rows) <= leaf or node.radius == 0.0:
            continue
        own, reach = points[node.rows], 0.5 * node.radius
        free = np.ones(len(own), dtype=bool)
        first = int(np.argmin(((own - node.centre) ** 2).sum(1)))
        kids = []
        while free.any():
            at = first if free[first] else int(np.argmax(free))
            near = free & (((own - own[at]) ** 2).sum(1) <= reach * reach)
            near[at] = True
            kids.append(node.rows[near])
            free &= ~near
            if len(kids) >= 4 * leaf and free.any():  # points far apart: the others share leaves
                kids += np.array_split(node.rows[free], max(1, -(-int(free.sum()) // leaf)))
                break
        if len(kids) == 1:
            continue
        single = [k for k in kids if len(k) <= leaf // 8]
        if len(single) > 1:  # small nets of neighbours share a node, at a wider radius
            kids = [k for k in kids if len(k) > leaf // 8]
            kids += np.array_split(np.concatenate(single), -(-sum(map(len, single)) // leaf))
        if len(kids) == 1:
            continue
        node.kids = [_node(points, k) for k in kids]
        node.rows = np.zeros(0, dtype=np.int64)
        todo += node.kids
    return root


def _node(points: np.ndarray, rows: np.ndarray) -> Node:
    own = points[rows]
    mean = own.mean(0)
    centre = own[int(np.argmin(((own - mean) ** 2).sum(1)))]
    return Node(centre, float(np.sqrt(((own - centre) ** 2).sum(1).max())), [], rows)


def dual_search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``k`` best (score, row of data); absent ones have row -1.

    A pair of nodes is dropped when even its best possible score, from centres and
    covering radii, is below the worst kth score of the query node.  Ties go to the
    smaller id, so a bound equal to that score is kept.  ``floor`` is a kth score that
    each query has elsewhere; worse rows need not be found.
    """
    floor = np.full(len(queries), _NONE, dtype=np.int64) if floor is None else floor
    best = np.full((len(queries), k), _NONE, dtype=np.int64)
    rows = np.full((len(queries), k), -1, dtype=np.int64)
    if not len(queries) or not len(data):
        return best, rows
    exact = float(np.abs(queries).max() or 1) * float(np.abs(data).max() or 1) * queries.shape[1] < 2**52
    q_exact, d_exact = (queries, data) if exact else (queries.astype(np.int64), data.astype(np.int64))
    order = np.argsort(data_ids, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    slack = 1.0 + 1e-9

    def bound(a: Node, b: Node) -> float:
        top = float(a.centre @ b.centre)
        return top + (a.norm * b.radius + b.norm * a.radius + a.radius * b.radius) * slack + 1e-9 * abs(top)

    q_root, d_root = cover_tree(queries, np.arange(len(queries))), cover_tree(data, np.arange(len(data)))
    todo = [(bound(q_root, d_root), q_root, d_root)]
    worst: dict[int, np.ndarray] = {}

    def rows_below(a: Node) -> np.ndarray:
        if id(a) not in worst:
            worst[id(a)] = a.rows if not a.kids else np.concatenate([rows_below(x) for x in a.kids])
        return worst[id(a)]

    while todo:
        top, a, b = todo.pop()
        if top < np.maximum(best[rows_below(a), -1], floor[rows_below(a)]).min():
            continue
        if a.kids and (not b.kids or a.radius >= b.radius):
            pairs = [(bound(x, b), x, b) for x in a.kids]
        elif b.kids:
            pairs = [(bound(a, x), a, x) for x in b.kids]
        else:
            q, d = a.rows, b.rows
            score = q_exact[q] @ d_exact[d].T
            score = np.rint(score).astype(np.int64) if exact else score
            score[query_ids[q][:, None] == data_ids[d][None, :]] = _NONE
            use = (score >= np.maximum(best[q, -1], floor[q])[:, None]).any(1)
            if use.any():
                _merge(best, rows, q[use], score[use], d, place, k)
            continue
        todo += sorted(pairs, key=lambda x: x[0])  # the most promising pair is next
    return best, rows


def _merge(best: np.ndarray, rows: np.ndarray, q: np.ndarray, score: np.ndarray, d: np.ndarray, place: np.ndarray, k: int) -> None:
    all_score = np.concatenate([best[q], score], axis=1)
    all_rows = np.concatenate([rows[q], np.broadcast_to(d, score.shape)], axis=1)
    all_rows[all_score == _NONE] = -1
    rank = np.where(all_rows >= 0, place[all_rows], np.iinfo(np.int64).max)
    pick = np.lexsort((rank, -np.where(all_score == _NONE, _NONE + 1, all_score)), axis=1)[:, :k]
    best[q] = np.take_along_axis(all_score, pick, 1)
    rows[q] = np.take_along_axis(all_rows, pick, 1)


def _by_length(ids: pa.Array, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of the rows of each length."""
    sizes = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, np.int64)
    for length in np.unique(sizes):
        at = np.flatnonzero(sizes == length)
        yield at, np.ascontiguousarray(column.take(pa.array(at)).flatten().to_numpy().reshape(-1, length))


def _centres(rows: DataFrame, n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the numbers and vectors of at most ``n`` rows, picked by a hash, as centres."""
    table = rows.orderBy(F.xxhash64("id", "v"), "id").limit(n).select("id", "v").toArrow()
    out, first = {}, 0
    if table.num_rows:
        for _, vectors in _by_length(table.column("id").combine_chunks(), table.column("v").combine_chunks()):
            vectors = np.unique(vectors, axis=0)
            out[vectors.shape[1]] = np.arange(first, first + len(vectors)), vectors
            first += len(vectors)
    return out


def _blocks(rows: DataFrame, centres: dict[int, tuple[np.ndarray, np.ndarray]], block: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with cell and part, and a table (cell, part, length, radius) of all blocks.

    A row of a length without a centre is in the cell -length, whose centre is 0.
    """
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
            for at, vectors in _by_length(batch.column(0), batch.column(1)):
                numbers, heads = own.get(vectors.shape[1], (np.array([-vectors.shape[1]]), np.zeros((1, vectors.shape[1]))))
                half, step = (heads**2).sum(1) / 2, max(1, (1 << 20) // len(heads))
                for k in range(0, len(at), step):
                    part = vectors[k : k + step]
                    near = (half - part @ heads.T).argmin(1)
                    cell[at[k : k + step]] = numbers[near]
                    far[at[k : k + step]] = np.sqrt(((part - heads[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(far)], names=["id", "v", "cell", "far"])

    dealt = cut(arrow_map(rows.select("id", "v"), run, "id long, v array<double>, cell long, far double"))
    parts = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    dealt = dealt.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int"))  # a row per centre or length
    dealt = cut(dealt.select("id", "v", "cell", "part", "far"))
    return dealt.drop("far"), cut(dealt.groupBy("cell", "part").agg(F.first(F.size("v")).alias("length"), F.max("far").alias("radius")))


def _centre_of(centres: dict[int, tuple[np.ndarray, np.ndarray]], length: int, cell: np.ndarray) -> np.ndarray:
    numbers, heads = centres.get(length, (np.array([-length]), np.zeros((1, length))))
    return heads[np.searchsorted(numbers, cell)]


def _pairs(asked: DataFrame, data: DataFrame, q_centres: dict, d_centres: dict) -> DataFrame:
    """(cell, part, d_cell, d_part) for query blocks ``asked`` with a column least: the data
    blocks whose bound reaches ``least``, or the nearest one alone where it is null.

    The data blocks' table, a narrow row for each block of vectors, goes to all tasks.
    """
    table = data.orderBy("length", "cell", "part").toArrow()
    blocks = tuple(table.column(c).to_numpy() for c in ("cell", "part", "length", "radius"))
    shared = asked.sparkSession.sparkContext.broadcast((blocks, q_centres, d_centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (cell, part, length, radius), own, other = shared.value
        heads, norms = {}, {}
        for size in np.unique(length):
            heads[size] = _centre_of(other, int(size), cell[length == size])
            norms[size] = np.sqrt((heads[size] ** 2).sum(1))
        for batch in batches:
            for row in batch.to_pylist():
                size = row["length"]
                if size not in heads:
                    continue
                at = np.flatnonzero(length == size)
                centre = _centre_of(own, size, np.array([row["cell"]]))[0]
                top = heads[size] @ centre
                if row["least"] is None:
                    use = at[[int(np.argmax(top))]]
                else:
                    wide = float(np.sqrt(centre @ centre)) * radius[at] + norms[size] * row["radius"] + radius[at] * row["radius"]
                    use = at[top + wide * (1 + 1e-9) + 1e-9 * np.abs(top) >= row["least"]]
                n = len(use)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["cell"])), pa.array(np.full(n, row["part"], dtype=np.int32)), pa.array(cell[use]), pa.array(part[use].astype(np.int32))], names=["cell", "part", "d_cell", "d_part"])

    return arrow_map(asked.select("cell", "part", "length", "radius", "least"), run, "cell long, part int, d_cell long, d_part int")


def _search(asked: DataFrame, data: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, place, vec_id, score): the best of each pair of blocks; place is the query's."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {"query_id": [], "place": [], "vec_id": [], "score": []}
        a_ids, b_ids, place, floor = left.column("id").to_numpy(), right.column("id").to_numpy(), left.column("place").to_numpy(), left.column("floor").to_numpy()
        b_parts = {v.shape[1]: (at, v) for at, v in _by_length(right.column("id"), right.column("v").combine_chunks())} if right.num_rows else {}
        for a_at, a in _by_length(left.column("id"), left.column("v").combine_chunks()) if left.num_rows else ():
            if a.shape[1] in b_parts:
                b_at, b = b_parts[a.shape[1]]
                best, rows = dual_search(a, a_ids[a_at], b, b_ids[b_at], k, floor[a_at])
                has = rows >= 0
                for name, own in (("query_id", a_ids), ("place", place)):
                    out[name].append(np.repeat(own[a_at], k).reshape(-1, k)[has])
                out["vec_id"].append(b_ids[b_at][rows[has]])
                out["score"].append(best[has])
        return pa.table({c: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for c, x in out.items()})

    keys = ["cell", "part", "d_cell", "d_part"]
    left = asked.join(pairs, ["cell", "part"]).groupBy(*keys)
    right = data.withColumnsRenamed({"cell": "d_cell", "part": "d_part"}).join(pairs, ["d_cell", "d_part"]).groupBy(*keys)
    return cut(left.cogroup(right).applyInArrow(search, "query_id long, place long, vec_id long, score long"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best rows for each query.

    Components become floor(scale * x), as doubles; the score is their integer
    inner product; ties go to the smaller id; a query's own id is no candidate.
    Null ids, null or empty vectors and vectors with a null, NaN or infinite
    component take no part; vectors of unlike length are never compared.  Repeated
    candidates count as rows of their own, repeated queries once; a query id with
    several vectors gets the best rows over all of them.  No rows give no rows; other
    columns are not read.

    No pair of blocks is visited whose bound shows that it holds no better row.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    usable = lambda df: df.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), finite.alias("ok")).where("id is not null and v is not null and ok and size(v) > 0").drop("ok")
    data, asked = usable(spread(vectors)), cut(usable(queries).dropDuplicates(["id", "v"]))
    n, m = data.count(), asked.count()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if n <= data_block and m <= query_block:  # one block each: both trees begin at their roots
        root = {"cell": F.lit(0).cast("long"), "part": F.lit(0)}
        pairs = data.sparkSession.range(1).select(*[c.alias(f"{side}{name}") for side in ("", "d_") for name, c in root.items()])
        whole = asked.withColumns(root | {"place": F.xxhash64("id", "v"), "floor": F.lit(_NONE)})
        return best(_search(whole, data.withColumns(root), pairs, k).drop("place"))
    d_centres = _centres(data, max(1, min(CENTRES, -(-n // data_block))))
    q_centres = _centres(asked, max(1, min(CENTRES, -(-m // query_block))))
    data, d_blocks = _blocks(data, d_centres, data_block)
    asked, q_blocks = _blocks(asked, q_centres, query_block)
    asked = asked.withColumn("place", F.xxhash64("id", "v"))

    seeds = cut(_pairs(q_blocks.withColumn("least", F.lit(None).cast("double")), d_blocks, q_centres, d_centres))
    first = _search(asked.withColumn("floor", F.lit(_NONE)), data, seeds, k)
    kth = first.groupBy("place").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(_NONE)).alias("floor"))
    asked = asked.join(bounded(kth), "place", "left").withColumn("floor", F.coalesce("floor", F.lit(_NONE)))
    worst = asked.groupBy("cell", "part").agg(F.min("floor").cast("double").alias("least"))
    more = cut(_pairs(q_blocks.join(worst, ["cell", "part"]), d_blocks, q_centres, d_centres).join(seeds, ["cell", "part", "d_cell", "d_part"], "left_anti"))
    return best((first.union(_search(asked, data, more, k)) if more.limit(1).count() else first).drop("place"))
