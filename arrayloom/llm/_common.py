"""Helpers shared by the operators: session folders, bounded broadcasts, joins by hot keys, ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arrayloom.plans.lineage import cut, shared_folder

__all__ = ["arrow_map", "bounded", "cut", "fresh", "hot_join", "hot_keys", "lookup", "ranked", "salted_join", "sample", "schema_of", "shared_folder", "small", "spread"]

#: Largest number of narrow rows (a few longs each) that may be broadcast.
BROADCAST_ROWS = 500_000
#: A key is hot if it holds more than this share of all rows; so fewer than so many are.
HOT = 1000
#: Tables of narrow rows up to this size are broadcast whole rather than searched for hot keys.
NEAR_ROWS = 50_000
#: Tables up to this size are dealt over all cores if their files would not be.
SPREAD_BYTES = 1 << 30
#: Bytes of an Arrow batch on its way to or from Python; a longer row is a batch by itself.
BATCH_BYTES = "4m"


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names`` with as many underscores before them as keep them off ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def schema_of(df: DataFrame, *more: str) -> str:
    """The DDL schema of ``df`` and then of ``more``."""
    return ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields), *more])


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes, whatever the length of the rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it is a small table in fewer files than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    query = df._jdf.queryExecution()
    if int(str(query.optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES or len(df._jdf.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows; counts no further than that."""
    return df.limit(most + 1).count() <= most


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its checked size allows one, else as it is."""
    return F.broadcast(df) if small(df, most) else df


def hot_join(left: DataFrame, right: DataFrame, on: list[str], n: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has a row per key and in ``n`` how many rows the key has.

    A small ``right`` is broadcast whole.  Of a larger one, keys with more than one in HOT of the rows are fewer than HOT, so their rows of
    ``right`` are broadcast and the left rows stay where they are; only the other keys
    are exchanged.  No task gathers the rows of a hot key.  Both sides are read twice
    and should be tables.  ``how`` is inner or left.
    """
    if small(right, NEAR_ROWS):
        return left.join(F.broadcast(right), on, how)
    total = right.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * HOT > F.lit(total)
    hot = right.where(is_hot)
    if not hot.limit(1).count():
        return left.join(right, on, how)
    near = left.join(F.broadcast(hot), on, "inner")
    rest = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(right.where(~is_hot), on, how)
    return near.unionByName(rest)


def hot_keys(rows: DataFrame, on: list[str], copies: str) -> DataFrame:
    """The hot keys of ``rows``, fewer than HOT, each with the number of ``copies`` that spread it."""
    total = max(1, rows.count())
    counts = rows.groupBy(on).agg(F.count(F.lit(1)).alias(copies)).where(F.col(copies) * HOT > F.lit(total))
    return cut(counts.withColumn(copies, F.ceil(F.col(copies) * HOT / F.lit(total)).cast("int")))


def salted_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, copies: str) -> DataFrame:
    """The inner join with a table of unique keys whose rows are wide.

    The right rows of ``hot`` keys, as :func:`hot_keys` gives them, are copied, less than
    2 * HOT times in all, and the left rows are dealt over the copies by a hash.
    """
    salt = fresh([*left.columns, *right.columns, copies], "salt")[0]
    spread, many = F.broadcast(hot), F.coalesce(F.col(copies), F.lit(1))
    keys = left.join(spread, on, "left").withColumn(salt, F.pmod(F.xxhash64(*left.columns), many).cast("int")).drop(copies)
    rows = right.join(spread, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), many - 1))).drop(copies)
    return keys.join(rows, [*on, salt]).drop(salt)


def lookup(left: DataFrame, right: DataFrame, on: list[str], n: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """The left join with a table of unique keys: by broadcast if it is small, else by :func:`hot_join`."""
    if small(right, most):
        return left.join(F.broadcast(right), on, "left")
    return hot_join(left, right, on, n, "left")


def ranked(df: DataFrame, group: str, order: str, name: str, ties: list[str], block_rows: int = 25_000) -> DataFrame:
    """Add ``name``, the gapless rank from 0 of each row in its ``group`` by ``order``, then ``ties``.

    Rows are sorted over all tasks by ranges of (group, order, ties and the place in the
    input), so neither a group nor equal values meet in one task, and a task sorts about
    ``block_rows`` rows however many there are.  Each row knows its place in its range;
    what stands before the range in its group is looked up in a table of a row per range
    and group.  The sorted rows are written once, so that places stay.
    """
    group_, rows_, place, low, base, count = fresh(df.columns, "group", "rows", "place", "low", "base", "count")
    ranges = max(1, -(-df.count() // block_rows))
    keys = [group, order, *ties]
    rows = df.withColumn(place, F.monotonically_increasing_id())
    rows = rows.repartitionByRange(ranges, *keys, place).sortWithinPartitions(*keys, place).drop(place)
    rows = cut(rows.withColumn(place, F.monotonically_increasing_id()))
    part, at = F.shiftright(place, 33), F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(F.col(group).alias(group_), part.alias(rows_)).agg(F.min(at).alias(low), F.count(F.lit(1)).alias(count))
    before = Window.partitionBy(group_).orderBy(rows_).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group_, rows_, (F.coalesce(F.sum(count).over(before), F.lit(0)) - F.col(low)).alias(base))
    joined = rows.withColumn(rows_, part).withColumn(group_, F.col(group)).join(bounded(counts), [group_, rows_])
    return joined.withColumn(name, F.col(base) + at).drop(group_, rows_, base, place)


def sample(df: DataFrame, label: str, key: str, rows: int, most_labels: int) -> DataFrame:
    """At most ``rows`` values of ``key`` of each label, the least by a hash; null labels are out.

    The keys of a label are counted first, by a sketch, and the hash alone thins each label
    to about four times ``rows`` of them.  Rows of one label and key are then merged with partial aggregation, to the
    least of each other column, so the task that picks them sees no more however large
    ``df`` is, and a key that many rows share takes one place.  Only the first
    ``most_labels`` labels in order take part.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.greatest(F.approx_count_distinct(key), F.lit(1)).alias("_n")).orderBy(label).limit(most_labels)
    steps = 1 << 30
    rates = counts.select(F.col(label).alias("_label"), F.least(F.ceil(F.lit(4.0 * rows * steps) / F.col("_n")), F.lit(steps)).cast("long").alias("_rate"))
    at = F.xxhash64(key)
    thin = df.join(F.broadcast(rates), F.col(label) == F.col("_label")).where(F.pmod(at, F.lit(steps)) < F.col("_rate"))
    others = [c for c in df.columns if c not in (label, key)]
    thin = thin.groupBy(label, key).agg(*[F.min(c).alias(c) for c in others]) if others else thin.select(label, key).distinct()
    order = Window.partitionBy(label).orderBy(at, key)
    return thin.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= rows).drop("_k")
