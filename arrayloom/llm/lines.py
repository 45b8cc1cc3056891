"""Line dedup over overlapping windows of three lines, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.llm._common import cut, fresh, hot_join, spread

WINDOW = 3
_FIRST = -(1 << 63)


def _id(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(_FIRST))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(_id, _hash, at): the windows of ``window`` lines that occurred earlier.

    Earlier is by key, then position.  A window is known by two 64-bit hashes of its
    lines.  Each window's first occurrence is found by a pre-aggregated minimum, and
    only windows seen more than once are joined back.  Windows that are hot among these
    are joined by broadcast, so no task gathers their occurrences.
    """
    lines = docs.where(F.col(text).isNotNull()).select(_id(key).alias("_id"), F.xxhash64(text).alias("_hash"), _lines(F.col(text)).alias("l"))
    lines = spread(lines).where(F.size("l") >= window)
    # Each line is hashed twice; a window's hashes are over those of its lines.
    lines = lines.select("_id", "_hash", F.transform("l", lambda x: F.xxhash64(x)).alias("a"), F.transform("l", lambda x: F.xxhash64(F.lit(29), x)).alias("b"), F.transform("l", lambda x: F.trim(x) != "").alias("some"))
    each = F.transform(
        F.sequence(F.lit(0), F.size("a") - window),
        lambda i: F.struct(
            i.alias("at"),
            F.xxhash64(*[F.get("a", i + j) for j in range(window)]).alias("a"),
            F.xxhash64(*[F.get("b", i + j) for j in range(window)]).alias("b"),
            F.array_contains(F.slice("some", i + 1, window), True).alias("some"),
        ),
    )
    windows = lines.select("_id", "_hash", F.explode(each).alias("w")).where("w.some").select("_id", "_hash", "w.at", "w.a", "w.b")
    windows = cut(windows)
    place = F.struct("_id", "_hash", "at")
    first = cut(windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return hot_join(windows, first, ["a", "b"], "n").where(place != F.col("first")).select("_id", "_hash", "at")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages of lines removed; adds n_lines and n_removed.

    A line goes when a window of three consecutive lines over it occurred earlier: in
    a row of a smaller key, or further up in the same row.  Windows are judged on the
    input, and windows of blank lines alone do not count.  What is left is joined by
    newlines.  Rows of the same key and text are judged alike, so neither removes the
    other's lines; a null key is the smallest.  Null texts stay null with no lines;
    an empty text is one line; no row is dropped, even if nothing is left of it; an
    empty table gives none.  Columns named n_lines and n_removed are replaced, others
    kept.  The work is linear in the lines of a text.
    """
    docs = docs.drop("n_lines", "n_removed")
    covered = repeated_windows(docs, key, text, window).groupBy("_id", "_hash").agg(F.collect_set("at").alias("at"))
    id_, hash_, at, row = fresh(docs.columns, "id", "hash", "at", "row")
    covered = covered.select(F.col("_id").alias(id_), F.col("_hash").alias(hash_), F.col("at").alias(at))
    rows = docs.withColumn(id_, _id(key)).withColumn(hash_, F.xxhash64(text)).join(covered, [id_, hash_], "left")
    # The struct holds what is needed more than once, so that a text is split but once.
    parts = F.struct(_lines(F.col(text)).alias("lines"), F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(*[p + j for j in range(window)])))).alias("gone"))

    def apply(x: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(x["lines"]) - 1)
        kept = F.transform(F.array_except(numbers, x["gone"]), lambda i: F.get(x["lines"], i))
        left = F.when(x["gone"].isNotNull(), F.array_join(kept, "\n"))
        return F.struct(F.size(x["lines"]).cast("long").alias("n"), F.coalesce(F.size(x["gone"]), F.lit(0)).cast("long").alias("gone"), left.alias("left"))

    rows = rows.withColumn(row, F.get(F.transform(F.array(parts), apply), F.lit(0)))
    there = F.col(text).isNotNull()
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("n_lines", F.when(there, F.col(row)["n"]).otherwise(zero))
    rows = rows.withColumn("n_removed", F.when(F.col(at).isNotNull(), F.col(row)["gone"]).otherwise(zero))
    rows = rows.withColumn(text, F.when(F.col(at).isNotNull(), F.col(row)["left"]).otherwise(F.col(text)))
    return rows.select(*docs.columns, "n_lines", "n_removed")
