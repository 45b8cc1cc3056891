"""k-means steps over points (i, x) and centres (k, c), both arrays of coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.plans.lineage import cut

#: Centres that are broadcast at once; more of them are taken in turns.
MOST_CENTRES = 10_000


def _turns(centres: DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k, matrix) of at most ``most`` centres at a time, by a hash of k; each in order of k."""
    blocks = max(1, -(-centres.count() // most))
    for b in range(blocks):
        own = centres if blocks == 1 else centres.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b)
        table = own.select(F.col("k").cast("long"), F.col("c").cast("array<double>")).orderBy("k").toArrow()
        if table.num_rows:
            yield table.column("k").to_numpy(), np.array(table.column("c").to_pylist(), dtype=np.float64)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The distances of all rows of ``x`` to all of ``c``."""
    return np.stack([np.sqrt(((x - row) ** 2).sum(1)) for row in c], axis=1)


def distances(points: DataFrame, centres: DataFrame, most: int = MOST_CENTRES) -> DataFrame:
    """(i, k, d): the Euclidean distance of every point to every centre.

    Centres go to the points in turns of bounded size; points are not exchanged.
    """
    out = None
    for k, c in _turns(centres, most):
        shared = points.sparkSession.sparkContext.broadcast((k, c))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            k, c = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    d = _far(_vectors(part.column(1), c.shape[1]), c)
                    who = pa.array(np.repeat(np.arange(len(d)), len(k)))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(who), pa.array(np.tile(k, len(d))), pa.array(d.ravel())], names=["i", "k", "d"])

        got = points.select("i", "x").mapInArrow(run, "i long, k long, d double")
        out = got if out is None else out.union(got)
    return points.sparkSession.createDataFrame([], "i long, k long, d double") if out is None else out


def assign(points: DataFrame, centres: DataFrame, most: int = MOST_CENTRES) -> DataFrame:
    """(i, k, d, x): each point's nearest centre; ties go to the least k.

    With more centres than one turn takes, each turn keeps its best and passes it on.
    """
    out = points.select("i", F.lit(None).cast("long").alias("k"), F.lit(None).cast("double").alias("d"), F.col("x").cast("array<double>").alias("x"))
    for k, c in _turns(centres, most):
        shared = points.sparkSession.sparkContext.broadcast((k, c))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            k, c = shared.value
            for batch in batches:
                had = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                had_k = batch.column(1).fill_null(np.iinfo(np.int64).max).to_numpy()
                far = np.concatenate([np.stack([(d := _far(_vectors(part.column(3), c.shape[1]), c)).min(1), k[d.argmin(1)]], axis=1) for at in range(0, batch.num_rows, 1024) for part in [batch.slice(at, 1024)]]) if batch.num_rows else np.zeros((0, 2))
                d, own = far[:, 0], far[:, 1].astype(np.int64)
                better = np.isnan(had) | (d < had) | ((d == had) & (own < had_k))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(better, own, had_k)), pa.array(np.where(better, d, had)), batch.column(3)], names=["i", "k", "d", "x"])

        out = out.mapInArrow(run, "i long, k long, d double, x array<double>")
    return out


def mask(assigned: DataFrame, centres: DataFrame) -> DataFrame:
    """(i, k, flag): +1 for a point's own cluster, else -1.

    It has a row per point and centre by its definition; coordinates stay in ``assigned``.
    """
    every = centres.agg(F.array_sort(F.collect_list("k")).alias("_all"))
    rows = assigned.select("i", F.col("k").alias("own")).crossJoin(F.broadcast(every))
    return rows.select("i", F.explode("_all").alias("k"), "own").select("i", "k", F.when(F.col("k") == F.col("own"), 1).otherwise(-1).alias("flag"))


def masked_sum(assigned: DataFrame) -> DataFrame:
    """(k, c, n, s): count and coordinate sums over the rows whose mask is positive, by position.

    Those are the rows assigned to k, so the mask is not written out.  Each batch is
    summed before anything is exchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                width = len(batch.column(1)[0])
                names, own = np.unique(batch.column(0).to_numpy(), return_inverse=True)
                sums = np.zeros((len(names), width))
                np.add.at(sums, own, _vectors(batch.column(1), width))
                counts = np.bincount(own, minlength=len(names))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, width)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(names))), pa.array(np.repeat(counts, width)), pa.array(sums.ravel())], names=["k", "c", "n", "s"])

    parts = assigned.where("k is not null").select("k", "x").mapInArrow(run, "k long, c int, n long, s double")
    return parts.groupBy("k", "c").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def new_centres(assigned: DataFrame) -> DataFrame:
    """(k, c): the mean of each cluster's points."""
    means = masked_sum(assigned).select("k", "c", (F.col("s") / F.col("n")).alias("m"))
    return means.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("c", "m"))).alias("a")).select("k", F.col("a.m").alias("c"))


def kmeans(points: DataFrame, centres: DataFrame, steps: int) -> DataFrame:
    """Centres after ``steps`` rounds; a cluster without points keeps its centre."""
    for _ in range(steps):
        new = new_centres(assign(points, centres)).withColumnRenamed("c", "m")
        centres = cut(centres.join(new, "k", "left").select("k", F.coalesce("m", "c").alias("c")))
    return centres
