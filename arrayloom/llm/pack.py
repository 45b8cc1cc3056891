"""Packing into optimal length buckets, and token-budget batches inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.llm._common import cut, fresh, ranked, spread

BUCKETS = 16
BUDGET = 65_536


def optimal_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The at most ``buckets`` upper bounds with the least total padding.

    ``lengths`` are distinct and ascending.  cost(i, j) of one bucket for lengths
    i+1..j is L[j]*(C[j]-C[i]) - (S[j]-S[i]), so each layer of the dynamic program is
    a lower envelope of lines, queried at ascending lengths: O(buckets x lengths).
    """
    n = len(lengths)
    if not n:
        return []
    total, tokens = [0] * (n + 1), [0] * (n + 1)
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        total[i + 1], tokens[i + 1] = total[i] + count, tokens[i] + count * length
    best = [0] + [lengths[j - 1] * total[j] - tokens[j] for j in range(1, n + 1)]
    layers: list[list[int]] = [[0] * (n + 1)]
    for k in range(2, min(buckets, n) + 1):
        now, back = list(best), [0] * (n + 1)
        lines: list[tuple[int, int, int]] = []  # (slope, height, i), slopes descending
        at = 0
        for j in range(k, n + 1):
            i = j - 1
            line = (-total[i], best[i] + tokens[i], i)
            while len(lines) >= 2 and _useless(lines[-2], lines[-1], line):
                lines.pop()
            lines.append(line)
            at = min(at, len(lines) - 1)
            x = lengths[j - 1]
            while at + 1 < len(lines) and lines[at + 1][0] * x + lines[at + 1][1] < lines[at][0] * x + lines[at][1]:
                at += 1
            slope, height, i = lines[at]
            now[j], back[j] = slope * x + height + x * total[j] - tokens[j], i
        layers.append(back)
        best = now
    bounds, j = [], n
    for back in reversed(layers):
        bounds.append(lengths[j - 1])
        j = back[j]
        if j == 0:
            break
    return sorted(bounds)


def _useless(a: tuple[int, int, int], b: tuple[int, int, int], c: tuple[int, int, int]) -> bool:
    """Whether line b is nowhere below both a and c, for slopes a > b > c."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def padding(lengths: list[int], counts: list[int], bounds: list[int]) -> int:
    """The padding that ``bounds`` leave."""
    out, at = 0, 0
    for length, count in zip(lengths, counts, strict=True):
        while bounds[at] < length:
            at += 1
        out += count * (bounds[at] - length)
    return out


def word_count(text: Column) -> Column:
    """The words between white space of a text; none for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def bounds_of(lengths: DataFrame, length: str, buckets: int) -> list[int]:
    """The optimal bounds for the global histogram of a column of lengths.

    The histogram has a row per distinct length and is collected whole, so the bounds
    are optimal however many lengths there are.
    """
    histogram = lengths.groupBy(F.col(length).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    got = histogram.orderBy("l").toArrow()
    return optimal_bounds(got.column("l").to_pylist(), got.column("n").to_pylist(), buckets)


def pack(docs: DataFrame, key: str = "doc_id", length: Column | None = None, text: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, keep: list[str] | None = None) -> DataFrame:
    """Add n_tokens, bucket, padded_tokens, batch and slot to every row, and drop others than ``keep``.

    ``length`` counts a row's tokens; by default its words.  ``bucket`` is the index
    of the least bound that holds the row, ``padded_tokens`` that bound.  In a bucket,
    rows in order of key (null first, ties by length) fill batches of as many rows as
    ``budget`` padded tokens allow, one at least: a row longer than the budget is a
    batch by itself, whole.  ``slot`` is the place in the batch; repeated rows have one
    each.  Null and empty texts have length 0 and share the first bucket; with no rows
    there are no batches.  Columns of ``docs`` that bear one of the five added names
    are replaced, all others may be kept.
    """
    new = ["n_tokens", "bucket", "padded_tokens", "batch", "slot"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    count = F.coalesce((word_count(F.col(text)) if length is None else length).cast("long"), F.lit(0).cast("long"))
    order, room, rank = fresh(docs.columns, "key", "room", "rank")
    rows = spread(docs).withColumn("n_tokens", count).select(*keep, "n_tokens", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias(order))
    if text not in keep:
        rows = cut(rows)  # so that words are counted once; texts themselves are not written for that
    bounds = bounds_of(rows, "n_tokens", buckets) or [0]
    table = F.array(*[F.struct(F.lit(b).cast("long").alias("bound"), F.lit(k).alias("bucket"), F.lit(max(1, budget // max(1, b))).cast("long").alias("room")) for k, b in enumerate(bounds)])
    place = F.get(F.filter(table, lambda x: F.col("n_tokens") <= x["bound"]), F.lit(0))
    rows = rows.withColumn(room, place).select(*keep, "n_tokens", order, F.col(room)["bucket"].alias("bucket"), F.col(room)["bound"].alias("padded_tokens"), F.col(room)["room"].alias(room))
    # Ranges of rows that carry their texts are shorter.
    rows = ranked(rows, "bucket", order, rank, ["n_tokens"], 5000 if text in keep else 25_000)
    return rows.select(*keep, "n_tokens", "bucket", "padded_tokens", F.expr(f"{rank} div {room}").alias("batch"), F.expr(f"cast({rank} % {room} as int)").alias("slot"))
