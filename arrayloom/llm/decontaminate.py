"""Benchmark decontamination with one Aho-Corasick automaton over words.

The benchmark's texts are normalised to words; every window of ten consecutive
words (or a whole shorter text) is a pattern of one automaton, which each worker
builds from the broadcast texts.  A document is normalised byte for byte, so that
offsets in it are offsets in the original, and is scanned once.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.llm._common import arrow_map, schema_of, spread
from arrayloom.llm._words import chunks

WINDOW = 10
#: The largest benchmark, in bytes of its texts, that is broadcast.  A worker's automaton
#: takes some 450 bytes a word, as measured, so about 1.2 GB for this many.
MOST_BYTES = 16 << 20

# Normalisation, byte for byte: A-Z become a-z; 0-9, a-z and all bytes of
# characters from U+0080 stay; all else becomes a space.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def normal_words(text: str | bytes | None) -> list[bytes]:
    """The normalised words of a text; none for a null."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_NORMAL).split()


class Scanner:
    """The automaton over numbered words; ``scan`` gives the hits in one text.

    A pattern's value is its number; lengths and the items of patterns are in arrays,
    those of the many patterns of one item alone as a number only.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        self.length, self.owner = array("i"), array("i")
        self.others: dict[int, set[int]] = {}
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, (_, text) in enumerate(items):
            words = tuple([self.numbers.setdefault(w, len(self.numbers) + 1) for w in normal_words(text)])
            for i in range(max(1, len(words) - window + 1) if words else 0):
                pattern = words[i : i + window]
                at = self.tree.get(pattern, -1)
                if at < 0:
                    self.tree.add_word(pattern, len(self.length))
                    self.length.append(len(pattern))
                    self.owner.append(k)
                elif self.owner[at] != k:
                    self.others.setdefault(at, set()).add(k)
        self.empty = not len(self.length)
        if not self.empty:
            self.tree.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged (first, end) ranges of hit words, and the ids of the items hit."""
        if self.empty:
            return [], set()
        number = self.numbers.get
        text = tuple([number(w, 0) for w in words])
        ranges: list[tuple[int, int]] = []
        owners: set[int] = set()
        for last, at in self.tree.iter(text):
            first = last - self.length[at] + 1
            while ranges and ranges[-1][1] >= first:  # also when a longer pattern ends at the same word
                first = min(first, ranges.pop()[0])
            ranges.append((first, last + 1))
            owners.add(self.owner[at])
            if at in self.others:
                owners |= self.others[at]
        return ranges, {self.items[k] for k in owners}


@lru_cache(maxsize=1)
def _scanner(items: tuple[tuple[str, str], ...], window: int) -> Scanner:
    return Scanner(list(items), window)


def _spans(data: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Character offsets in the original of ranges of words."""
    normal = np.frombuffer(data.translate(_NORMAL), dtype=np.uint8) != 0x20
    edge = np.diff(np.concatenate(([False], normal, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)))
    return [{"first": int(chars[starts[a]]), "end": int(chars[ends[b - 1]])} for a, b in ranges]


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Add to ``docs`` the columns n_words, n_hit, item_ids and spans.

    spans: (first, end) character offsets in the original of each run of hit
    words.  Null and empty texts have no words, so no hits; long texts are scanned
    whole; repeated rows are scanned each for itself; items with a null id or no words
    take no part, several texts of one id are one item; an empty benchmark hits
    nothing and an empty table gives none.  Columns of ``docs`` that bear one of the
    added names are replaced, all others are kept.  There is one automaton and one scan
    whatever the size of the benchmark; beyond ``most_bytes`` bytes of texts, which the
    workers' memory must hold some 80 times, ValueError is raised.
    """
    own = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("t")).where("id is not null and t is not null").distinct()
    size = int(own.agg(F.coalesce(F.sum(F.octet_length("t") + F.octet_length("id")), F.lit(0))).first()[0])
    if size > most_bytes:
        raise ValueError(f"the benchmark has {size} bytes, more than most_bytes = {most_bytes}, which bounds the automaton in each worker")
    new = ["n_words", "n_hit", "item_ids", "spans"]
    docs = spread(docs.drop(*new))
    schema = schema_of(docs, "n_words long", "n_hit long", "item_ids array<string>", "spans array<struct<first:long,end:long>>")
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(tuple((r["id"], r["t"]) for r in own.orderBy("id", "t").collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared.value, window)
        for batch in batches:
            counts, hits, ids, spans = [], [], [], []
            for _, _, data, offsets in chunks(batch.column(at)):
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    raw = data[a:b].tobytes()
                    words = raw.translate(_NORMAL).split()
                    ranges, owners = scanner.scan(words)
                    counts.append(len(words))
                    hits.append(sum(e - s for s, e in ranges))
                    ids.append(sorted(owners))
                    spans.append(_spans(raw, ranges) if ranges else [])
            added = [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, SPANS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *new])

    return arrow_map(docs, run, schema)
