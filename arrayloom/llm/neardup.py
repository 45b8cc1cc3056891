"""Near duplicates by DartMinHash over weighted word shingles.

A text is a weighted set: its shingles of five words, each with its count.  Words are
normalised: runs of digits, letters and characters beyond ASCII, A to Z as a to z, so
case, punctuation and white space make no difference.  Over every unit of weight of every element lies the same random process of darts along
the axis of ranks, drawn from hashes, so equal regions hold equal darts.  A text
throws only the darts below the rank at which about k*ln(k) + 3k of them fall into
its regions, whatever its length; a hash deals each dart to one of k coordinates,
and the earliest dart of each coordinate is the signature.  Two texts agree in a
coordinate with a probability equal to their weighted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arrayloom.llm._common import arrow_map, bounded, cut, fresh, hot_join, hot_keys, lookup, salted_join, spread
from arrayloom.llm._words import chunks, hashes, mix, split, sums, window

SHINGLE = 5
SIMILARITY = 0.8
#: 26 bands of 5 coordinates: a pair of similarity 0.8 shares no band in 3 of 100,000 cases.
BANDS, ROWS = 26, 5
#: Sketches of 128 single bits; a pair of similarity 0.8 differs in 12.8 +- 3.4 of them.
MOST_BITS = 32
#: Long sketches of so many bits, for texts of buckets that hold several classes; a pair of
#: similarity 0.8 differs in 204.8 +- 13.6 of them.
LONG_BITS, MOST_LONG_BITS = 2048, 264
#: Regions that are thrown at in one call; all arrays of a call take some 20 MB.
REGIONS = 150_000
#: Rows of a bucket that are compared with each other in one task.
BLOCK = 2000
#: Texts whose long sketches one task makes.
SKETCH_ROWS = 500
_FIRST = -(1 << 63)
# Normalisation, byte for byte: A-Z become a-z, and what is no digit, letter or byte of a
# character beyond ASCII is no part of a word.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def shingles(words: np.ndarray, texts: np.ndarray, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle; a text of fewer words, but not none, is one shingle."""
    sizes = np.diff(texts)
    count = np.where(sizes > 0, np.maximum(sizes - length + 1, 1), 0)
    text = np.repeat(np.arange(len(sizes)), count)
    at = np.repeat(texts[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return text, window(sums(words), at, np.minimum(at + length, texts[1:][text]))


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """The ``n`` x ``k`` earliest darts of weighted sets; rows of sets without weight are 0.

    ``weight`` may be fractional: a dart in the last unit of an element's weight has a
    hashed height there, and counts only if that is within the weight.
    """
    out = np.zeros((n, k), dtype=np.uint64)
    norm = np.bincount(text, weight, minlength=n)
    depth = k * np.log(k) + 3 * k
    cost = np.cumsum(norm + depth) // REGIONS  # sets in one group share a call
    bounds = [0, *(np.flatnonzero(np.diff(cost)) + 1).tolist(), n] if n else [0]
    rows = np.searchsorted(text, bounds)  # texts are in order
    for a, b, lo, hi in zip(bounds[:-1], bounds[1:], rows[:-1], rows[1:], strict=True):
        _fill(out[a:b], text[lo:hi] - a, element[lo:hi], weight[lo:hi], norm[a:b], depth)
    return out


def _fill(out: np.ndarray, text: np.ndarray, element: np.ndarray, weight: np.ndarray, norm: np.ndarray, depth: float) -> None:
    n, k = out.shape
    reach = np.zeros(n)
    todo = np.flatnonzero(norm > 0)
    reach[todo] = depth / norm[todo]
    while len(todo):
        wanted = np.zeros(n, dtype=bool)
        wanted[todo] = True
        rank, dart = _throw(*(x[wanted[text]] for x in (text, element, weight)), reach, n, k)
        missing = todo[np.isinf(rank[todo]).any(1)]
        done = np.setdiff1d(todo, missing, assume_unique=True)
        out[done] = dart[done]
        reach[missing] *= 2  # a coordinate without a dart: look further
        todo = missing


def _throw(text: np.ndarray, element: np.ndarray, weight: np.ndarray, reach: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    rank, dart = np.full(n * k, np.inf), np.zeros(n * k, dtype=np.uint64)
    # Regions: each unit of weight, cut into unit steps of rank.
    units = np.ceil(weight).astype(np.int64)
    steps = np.ceil(reach[text]).astype(np.int64)
    cells = units * steps
    of = np.repeat(np.arange(len(text)), cells)
    inner = np.arange(int(cells.sum())) - np.repeat(np.cumsum(cells) - cells, cells)
    unit, step = inner // steps[of], inner % steps[of]
    seed = mix(element[of] + mix(unit.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + step.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    room = weight[of] - unit
    owner = text[of]
    low, high = step.astype(np.float64), np.minimum(step + 1.0, reach[owner])
    turn = 0
    while len(seed):
        turn += 1
        draw = mix(seed + np.uint64(turn * 0xD6E8FEB86659FD93 % 2**64))
        low = low - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53)
        live = low < high
        seed, room, owner, low, high, draw = (x[live] for x in (seed, room, owner, low, high, draw))
        mark = mix(draw ^ np.uint64(0xA0761D6478BD642F))
        key = owner * k + ((mark >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
        inside = room >= 1.0
        if not inside.all():
            height = (mix(draw + np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            inside |= height < room
        key, got, own = key[inside], low[inside], mark[inside]
        np.minimum.at(rank, key, got)
        first = got == rank[key]
        dart[key[first]] = own[first]
    return rank.reshape(n, k), dart.reshape(n, k)


def _sets(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for i, j, data, offsets in chunks(column):
        starts, ends, texts = split(data, offsets, _WORD)
        text, element = shingles(hashes(_LOWER[data], starts, ends), texts, length)
        order = np.lexsort((element, text))
        text, element = text[order], element[order]
        new = np.ones(len(text), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (element[1:] != element[:-1])
        head = np.flatnonzero(new)
        yield i, j, text[head], element[head], np.diff(np.concatenate((head, [len(text)])))


def sketch(docs: DataFrame, key: str, text: str, length: int, bands: int, rows: int) -> DataFrame:
    """(id, h1, h2, b0, b1, bands) of the rows whose texts have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = bands * rows
        for batch in batches:
            for i, j, owner, element, weight in _sets(batch.column(3), length):
                marks = signatures(owner, element, weight.astype(np.float64), j - i, k)
                has = np.bincount(owner, minlength=j - i) > 0
                at = pa.array(i + np.flatnonzero(has))
                marks = marks[has]
                band = np.zeros((len(marks), bands), dtype=np.uint64)
                for r in range(rows):
                    band = mix(band + marks[:, r::rows] * np.uint64(0x9E3779B97F4A7C15))
                halves = _packed(np.resize(marks.T, (128, len(marks))).T if k < 128 else marks[:, :128]).T
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, bands, dtype=np.int32)), pa.array(np.ascontiguousarray(band).ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), *(pa.array(np.ascontiguousarray(h)) for h in halves), lists], names=["id", "h1", "h2", "b0", "b1", "bands"])

    source = docs.where(F.col(text).isNotNull()).select(_id(key).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(17), F.col(text)).alias("h2"), F.col(text).alias("text"))
    return arrow_map(spread(source), run, "id long, h1 long, h2 long, b0 long, b1 long, bands array<long>")


def _packed(marks: np.ndarray) -> np.ndarray:
    """The lowest bit of each mark, 64 to a long."""
    bits = (marks & np.uint64(1)).reshape(len(marks), -1, 64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(2, dtype=np.uint64).view(np.int64)


def long_sketch(texts: DataFrame, length: int, bits: int = LONG_BITS) -> DataFrame:
    """(id, h1, far): the bits of ``bits`` coordinates of each text of (id, h1, text), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, owner, element, weight in _sets(batch.column(2), length):
                packed = _packed(signatures(owner, element, weight.astype(np.float64), j - i, bits))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, packed.size + 1, bits // 64, dtype=np.int32)), pa.array(packed.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(2)), lists], names=["id", "h1", "far"])

    return arrow_map(texts, run, "id long, h1 long, far array<long>")


def _id(key: str):
    return F.coalesce(F.col(key).cast("long"), F.lit(_FIRST))


def _texts(docs: DataFrame, key: str, text: str, wanted: DataFrame, unique: bool) -> DataFrame:
    """(id, h1, text), one row each, of the (id, h1) in ``wanted``; ``unique`` if no row is repeated."""
    texts = docs.where(F.col(text).isNotNull()).select(_id(key).alias("id"), F.xxhash64(text).alias("h1"), F.col(text).alias("text"))
    texts = texts.join(bounded(wanted), ["id", "h1"], "left_semi")
    return texts if unique else texts.groupBy("id", "h1").agg(F.min("text").alias("text"))  # equal texts, whichever stays


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, length: int, least: float, unique: bool = False) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts' weighted Jaccard similarity is at least ``least``.

    ``pairs`` is a table (a, ha, b, hb) of ids and text hashes, a pair once.  Texts that
    many pairs share are copied, so no task gathers the pairs of a hub.
    """
    side = lambda x: pairs.select(F.col(x).alias("id"), F.col(f"h{x}").alias("h1"))
    wanted = cut(side("a").union(side("b")).distinct())
    texts = _texts(docs, key, text, wanted, unique)
    rows = pairs
    for x, body in (("b", "y"), ("a", "x")):
        on = [x, f"h{x}"]
        own = texts.select(F.col("id").alias(x), F.col("h1").alias(f"h{x}"), F.col("text").alias(body))
        rows = salted_join(rows, own, on, hot_keys(pairs, on, "copies"), "copies")
    rows = rows.select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                same = similarity(part.column(2), part.column(3), length)
                yield part.select([0, 1]).filter(pa.array(same >= least))

    return arrow_map(rows, run, "a long, b long")


def similarity(x: pa.Array, y: pa.Array, length: int = SHINGLE) -> np.ndarray:
    """The exact weighted Jaccard similarity of the shingles of each pair of texts."""
    sides = []
    for column in (x, y):
        keys, owners, weights = [], [], []
        for i, _, owner, element, weight in _sets(column, length):
            owners.append(owner + i)
            keys.append(mix(element ^ mix((owner + i).astype(np.uint64))))
            weights.append(weight)
        sides.append([np.concatenate(v) if v else np.zeros(0, np.int64) for v in (keys, owners, weights)])
    (ka, oa, wa), (kb, ob, wb) = sides
    n = len(x)
    _, i, j = np.intersect1d(ka, kb, return_indices=True)
    both = np.bincount(oa[i], np.minimum(wa[i], wb[j]), minlength=n)
    all_ = np.bincount(oa, wa, minlength=n) + np.bincount(ob, wb, minlength=n) - both
    return np.where(all_ > 0, both / np.maximum(all_, 1), 0.0)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component of edges (a, b).

    First each node b keeps the link to its least partner alone, and its other partners
    are linked with that one: they are hubs that many nodes share, so few links are
    left a node.  Then rounds of neighbours' minimum and of following one's label, each
    cut; only the count of changes comes to the driver.  Hubs and labels that are hot
    are joined by broadcast.
    """
    low = edges.groupBy("b").agg(F.min("a").alias("low"), F.count(F.lit(1)).alias("n"))
    stars = hot_join(edges.select("a", "b"), cut(low), ["b"], "n")
    # Each row gives (low, b) and (low, a); that of the least partner gives (low, b) twice.
    ends = F.explode(F.array("b", F.when(F.col("a") != F.col("low"), F.col("a")).otherwise(F.col("b"))))
    edges = cut(stars.select(F.col("low").alias("a"), ends.alias("b")).distinct())
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    degrees = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label"), F.count(F.lit(1)).alias("n"))
    labels = cut(degrees.select(F.col("a").alias("node"), "label", "n"))
    while True:
        near = hot_join(both, labels.select(F.col("node").alias("b"), "label", "n"), ["b"], "n").groupBy("a").agg(F.min("label").alias("near"))
        new = cut(labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"), "n"))
        # A label is a node too: its own label is the next one of all that have it.
        heads = new.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
        heads = heads.join(new.select(F.col("node").alias("label"), F.col("label").alias("next")), "label")
        new = cut(hot_join(new, cut(heads), ["label"], "size").select("node", "was", F.col("next").alias("label"), "n"))
        labels = new.select("node", "label", "n")
        if not new.where("was <> label").limit(1).count():
            return labels.select("node", "label")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = SHINGLE, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, class_id) for every row: the least key among its near duplicates.

    Classes are the connected components of links between texts of similarity
    ``least`` or more.  Equal texts are one class and take part once.  Null texts and
    texts without words are classes by themselves.  Rows of one key are one document,
    whose class is that of all its texts; a null key counts as the least key, and its
    class_id is null.  Repeated rows take part once; an empty table gives no rows; a
    long text is one signature; no other column of ``docs`` is read.

    Candidates are rows that share a band.  Each is first compared with the least row
    of each of its buckets; after joining what links, only rows of one bucket in
    different classes are left.  Of these, the pairs whose long sketches allow the
    similarity (all but 7 in a million of those that have it) are compared exactly.
    So no bucket is capped, and a group of copies costs a link a row, not all pairs.
    Texts, buckets, hubs and labels that are hot are joined by broadcast or copies.
    """
    marks = cut(sketch(docs, key, text, length, bands, rows))
    copies = cut(marks.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    marks = cut(lookup(marks, copies, ["h1", "h2"], "n").withColumn("rep", F.coalesce("rep", "id")).drop("n"))
    members = cut(marks.groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n")))
    unique = not members.where("n > 1").limit(1).count()  # rows of one key cost an exchange of texts more
    nodes = marks.where("id = rep") if unique else cut(marks.where("id = rep").dropDuplicates(["id", "h1"]))
    placed = nodes.select("id", "h1", "b0", "b1", F.posexplode("bands").alias("band", "hash"))

    of_least = [F.min_by(c, "id").alias(f"hub_{c}") for c in ("h1", "b0", "b1")]
    hubs = placed.groupBy("band", "hash").agg(F.min("id").alias("hub"), *of_least, F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("hub < last").drop("last")
    shared = cut(hot_join(placed, cut(hubs), ["band", "hash"], "n").drop("n"))
    alike = lambda p, q: (F.bit_count(p[0].bitwiseXOR(q[0])) + F.bit_count(p[1].bitwiseXOR(q[1]))) <= MOST_BITS
    near = alike((F.col("b0"), F.col("b1")), (F.col("hub_b0"), F.col("hub_b1")))
    tried = shared.where((F.col("id") != F.col("hub")) & near).select(F.col("hub").alias("a"), F.col("hub_h1").alias("ha"), F.col("id").alias("b"), F.col("h1").alias("hb"))
    tried = cut(tried.distinct())
    links = verified(tried, docs, key, text, length, least, unique)
    if not unique:  # the texts of one key are one document
        several = marks.join(bounded(members.where("rep < last").select("id", F.col("rep").alias("a"))), "id")
        links = links.union(several.where("rep <> a").select("a", F.col("rep").alias("b")))
    links = cut(links)
    labels = components(links)

    named = shared.select("band", "hash", "id", "h1", "b0", "b1").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = cut(named)
    mixed = named.groupBy("band", "hash").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("band", "hash", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    # What is left: pairs of different classes in one bucket, each in its first shared band.
    open_ = cut(hot_join(named, cut(mixed), ["band", "hash"], "n").drop("n"))
    texts = _texts(docs, key, text, cut(open_.select("id", "h1").distinct()), unique)
    texts = texts.repartition(max(1, -(-texts.select("id").count() // SKETCH_ROWS)))
    wide = cut(long_sketch(texts, length).join(nodes.select("id", "h1", "bands"), ["id", "h1"]))
    open_ = open_.join(wide, ["id", "h1"])
    left = open_.withColumn("block", F.pmod(F.xxhash64("id", "h1"), F.col("blocks")))
    right = open_.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    on = (F.col("l.band") == F.col("r.band")) & (F.col("l.hash") == F.col("r.hash")) & (F.col("l.block") == F.col("r.block"))
    on = on & (F.col("l.id") < F.col("r.id")) & (F.col("l.label") != F.col("r.label")) & alike((F.col("l.b0"), F.col("l.b1")), (F.col("r.b0"), F.col("r.b1")))
    apart = [F.bit_count(F.get("l.far", F.lit(k)).bitwiseXOR(F.get("r.far", F.lit(k)))) for k in range(LONG_BITS // 64)]
    sooner = [(F.col("l.band") > k) & (F.get("l.bands", F.lit(k)) == F.get("r.bands", F.lit(k))) for k in range(bands - 1)]
    on = on & (reduce(lambda a, b: a + b, apart) <= MOST_LONG_BITS) & ~reduce(lambda a, b: a | b, sooner)
    rest = left.alias("l").join(right.alias("r"), on).select(F.col("l.id").alias("a"), F.col("l.h1").alias("ha"), F.col("r.id").alias("b"), F.col("r.h1").alias("hb"))
    rest = cut(rest.join(tried, ["a", "ha", "b", "hb"], "left_anti"))
    more = cut(verified(rest, docs, key, text, length, least, unique)) if rest.limit(1).count() else rest.select("a", "b")
    if more.limit(1).count():
        labels = components(cut(links.union(more)))

    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    classes = cut(sizes.join(labels.withColumnRenamed("node", "rep"), "rep"))
    id_, rep, label, n = fresh([key], "id", "rep", "label", "n")
    members = lookup(members.select("id", "rep", "n"), classes, ["rep"], "size").select(F.col("id").alias(id_), F.coalesce("label", "rep").alias(label), F.col("n").alias(n))
    out = lookup(docs.select(F.col(key), _id(key).alias(id_)), cut(members), [id_], n)
    found = F.coalesce(label, id_)
    return out.select(key, F.when(found != _FIRST, found).alias("class_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` without the rows whose class has a smaller key.

    All rows of one key stay or go together; null texts and texts without words stay.
    """
    classes = near_duplicates(docs, key, text, **settings)
    id_ = fresh(docs.columns, "id")[0]
    gone = cut(classes.where(~F.col(key).eqNullSafe(F.col("class_id"))).select(_id(key).alias(id_)).distinct())
    return docs.withColumn(id_, _id(key)).join(bounded(gone), id_, "left_anti").drop(id_)
