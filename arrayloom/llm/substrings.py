"""Substring dedup by level-wise doubling of repeated word windows.

Levels are window lengths, each at most twice the one before, from a quarter of the
full length or so up to it: 13, 25 and 50 words.  At a level, windows repeated at its
length alone go on to the next; when no candidates survive, the work ends.

A full window that repeats has only repeated parts of any length, so of the parts of a
level's length inside it the one of least hash, its anchor, repeats too; and wherever
the full window stands, it has the same anchor.  So a level counts anchors alone, about
two in (length - part + 2) parts, and keeps the full windows whose anchor starts in
several texts.  The last level compares full windows: runs of neighbouring ones with one
anchor as a whole first, and window by window only where an anchor has several
surroundings.  Longer windows cannot cover other words, so there the doubling ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.llm._common import BROADCAST_ROWS, arrow_map, cut, hot_join, small, spread
from arrayloom.llm._words import chunks, hashes, mix, split, sums, window

WINDOW = 50
#: The least length of a level.
SHORTEST = 8
RANGES = "ranges array<struct<first:int,windows:int>>"


def levels(length: int) -> list[int]:
    """The window lengths before the full one, ascending; each doubles to the next or beyond."""
    out = [-(-length // 2)]
    while -(-out[0] // 2) >= SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out[-2:] if out[0] < length else []


def _runs(words: np.ndarray, texts: np.ndarray, length: int, part: int, alive: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Runs of full windows with one anchor: (text, first window, windows, anchor, run hash).

    ``texts`` are the bounds of the texts in ``words``; no window leaves its text.
    ``alive`` marks the words where full windows that are still candidates start.
    """
    none = np.zeros(0, dtype=np.int64)
    nothing = none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    spread = length - part + 1  # parts in a full window
    n = len(words)
    sizes = np.diff(texts)
    if n < length:
        return nothing
    total = sums(words)
    at = np.arange(n - part + 1)
    low = window(total, at, at + part)
    where = at.astype(np.int32)
    step = 1
    while step < spread:  # the least part from each place on, doubling its reach
        shift = min(step, spread - step)
        a, b = low[: len(low) - shift], low[shift:]
        take = b < a
        where = np.where(take, where[shift:], where[: len(where) - shift])
        low = np.where(take, b, a)
        step += shift
    # Full windows that stay inside their text.
    count = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), count)
    first = np.repeat(texts[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    if alive is not None:
        use = alive[first]
        text, first = text[use], first[use]
    if not len(first):
        return nothing
    owner, anchor = where[first], low[first]
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (text[1:] != text[:-1]) | (first[1:] != first[:-1] + 1)))
    head = np.flatnonzero(new)
    many = np.diff(np.concatenate((head, [len(first)])))
    start = first[head]
    run = window(total, start, start + many - 1 + length)
    run = mix(run ^ mix((owner[head] - start).astype(np.uint64) * np.uint64(1 << 20) + many.astype(np.uint64)))
    return text[head], start - texts[text[head]], many, anchor[head], run


def _hashed(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, data, offsets in chunks(column):
        starts, ends, texts = split(data, offsets)
        yield i, j, hashes(data, starts, ends), texts


class _Lists:
    """The (first, windows) of the list of each row of an Arrow column; none for nulls."""

    def __init__(self, column: pa.Array) -> None:
        ends = np.asarray(column.offsets)
        self.ends = ends - ends[0]
        flat = column.flatten()
        self.first, self.many = (flat.field(k).to_numpy().astype(np.int64) for k in range(2))

    def places(self, i: int, j: int, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of each listed window of rows i to j, whose words begin at ``texts``."""
        lo, hi = self.ends[i], self.ends[j]
        held = np.diff(self.ends[i : j + 1])
        many, row = self.many[lo:hi], np.repeat(np.arange(j - i), held)
        inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        row = np.repeat(row, many)
        return row, texts[row] + np.repeat(self.first[lo:hi], many) + inner


def _keys(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, hash, text): rows of one key are told apart by a hash of their texts."""
    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))


def anchored_runs(rows: DataFrame, length: int, part: int) -> DataFrame:
    """(anchor, run, id, hash, first, windows) of the runs of full windows in (id, hash, text[, ranges]).

    With a column ranges only the windows in it are looked at.
    """
    some = "ranges" in rows.columns

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            lists = _Lists(batch.column(3)) if some else None
            for i, j, words, texts in _hashed(batch.column(2)):
                alive = None
                if lists:
                    alive = np.zeros(len(words) + 1, dtype=bool)
                    alive[lists.places(i, j, texts)[1]] = True
                doc, first, many, anchor, run = _runs(words, texts, length, part, alive)
                at = pa.array(i + doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(run.view(np.int64)), ids.take(at), marks.take(at), pa.array(first.astype(np.int32)), pa.array(many.astype(np.int32))],
                    names=["anchor", "run", "id", "hash", "first", "windows"],
                )

    return arrow_map(rows, find, "anchor long, run long, id long, hash long, first int, windows int")


def _windows(asked: DataFrame, length: int) -> DataFrame:
    """(window, id, hash, first) of the windows that ``asked``, (id, hash, text, ranges), lists."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = _Lists(batch.column(3))
            for i, j, words, texts in _hashed(batch.column(2)):
                row, place = lists.places(i, j, texts)
                found, at = window(sums(words), place, place + length), pa.array(i + row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array((place - texts[row]).astype(np.int32))],
                    names=["window", "id", "hash", "first"],
                )

    return arrow_map(asked, find, "window long, id long, hash long, first int")


def _with_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """``rows`` that have ranges, with them.  Only their texts are exchanged while they are few."""
    ranges = cut(ranges)
    if small(ranges, BROADCAST_ROWS // 5):
        rows = rows.join(F.broadcast(ranges.select("id", "hash")), ["id", "hash"], "left_semi")
    return rows.join(ranges, ["id", "hash"]).select("id", "hash", "text", "ranges")


def _listed(runs: DataFrame) -> DataFrame:
    return runs.groupBy("id", "hash").agg(F.collect_list(F.struct("first", "windows")).alias("ranges"))


def covered_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = WINDOW) -> DataFrame:
    """(id, hash, first, end): ranges of words whose windows also start in a smaller key's text."""
    rows = _keys(docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()), key, text)
    runs = None
    for part in levels(length) or [length]:
        found = cut(anchored_runs(spread(rows) if runs is None else _with_ranges(rows, _listed(runs)), length, part))
        again = found.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("anchor", "n")
        runs = cut(hot_join(found, cut(again), ["anchor"], "n").drop("n"))
        if not runs.limit(1).count():
            break
    # Whole runs: all but those of the first text with a run are covered.
    firsts = cut(runs.groupBy("anchor", "run").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("n")))
    tied = hot_join(runs, firsts, ["anchor", "run"], "n").drop("n")
    whole = tied.where("id > owner").select("id", "hash", "first", (F.col("first") + F.col("windows") + (length - 1)).alias("end"))
    # Single windows: where an anchor has several surroundings, among their first texts.
    several = firsts.groupBy("anchor").agg(F.min("run").alias("lo"), F.max("run").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("anchor", "n")
    open_runs = hot_join(cut(tied.where("id = owner")), cut(several), ["anchor"], "n")
    windows = cut(_windows(_with_ranges(rows, _listed(open_runs)), length))
    owners = cut(windows.groupBy("window").agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("owner < last").drop("last"))
    single = hot_join(windows, owners, ["window"], "n").where("id > owner").select("id", "hash", "first", (F.col("first") + length).alias("end"))
    return whole.union(single)


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = WINDOW, emit_text: bool = True) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256[, kept]): words left after removal, by row.

    Words are runs of bytes other than space and tab to return.  A word goes if a
    window of ``length`` words over it also starts in a row with a smaller key.  Rows
    of one key do not remove each other's words, be their texts equal or not; a null
    key's row keeps all its words and removes none.  Texts shorter than ``length``
    words stay; null and empty texts have no words; an empty table gives none.  A long
    text is one row of work.  ``kept`` joins the words left by single spaces.  No
    other column of ``docs`` is read, so their names do not matter.
    """
    ranges = covered_ranges(docs, key, text, length).groupBy("id", "hash").agg(F.collect_list(F.struct("first", "end")).alias("gone"))
    ranges = cut(ranges)
    rows = _keys(docs, key, text)
    none = F.lit(None).cast("array<struct<first:int,end:int>>")
    if small(ranges):  # only texts that lose words are exchanged
        known = F.broadcast(ranges.select("id", "hash"))
        hit = rows.join(known, ["id", "hash"], "left_semi").join(ranges, ["id", "hash"])
        rows = hit.select("id", "text", "gone").union(rows.join(known, ["id", "hash"], "left_anti").select("id", "text", none))
    else:
        rows = rows.join(ranges, ["id", "hash"], "left").select("id", "text", "gone")
    kind = f"`{key}` long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if emit_text else "")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(2)
            offsets = np.asarray(gone.offsets) - gone.offsets[0].as_py()
            flat = gone.flatten()
            lo, hi = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            n_words, n_removed, digests, left = [], [], [], []
            for i, _, data, at in chunks(batch.column(1)):
                for j in range(len(at) - 1):
                    raw = data[at[j] : at[j + 1]].tobytes()
                    words = raw.split()
                    a, b = offsets[i + j], offsets[i + j + 1]
                    total = len(words)
                    if b > a:
                        cover = np.zeros(total + 1, dtype=np.int64)
                        np.add.at(cover, lo[a:b], 1)
                        np.add.at(cover, hi[a:b], -1)
                        words = [words[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                    kept = b" ".join(words)
                    n_words.append(total)
                    n_removed.append(total - len(words))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if emit_text:
                        left.append(kept.decode())
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = [key, "n_words", "n_removed", "kept_sha256"]
            if emit_text:
                columns, names = [*columns, pa.array(left, pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return arrow_map(rows, keep, kind)
