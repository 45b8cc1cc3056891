"""Toxicity by a support vector machine with a gapped subsequence string kernel.

The kernel compares windows of text by their subsequences of three symbols: each occurrence
within a span of SPAN symbols adds DECAY to the power of its length to the feature
of its three symbols.  So words with symbols inserted, or a known stem with another
ending, stay similar.  Landmark windows give the Nyström map in which the machine is
trained; since its decision is a sum over landmarks, it folds back into one weight
per subsequence, and scoring a window is a sum of looked-up weights.

The training units are sentences, which end at . ! or ? before white space and at line
ends, and carry their document's label.  A sentence is seen through its windows: every
word, and every two neighbouring words of PAIR symbols at most.  Its decision is that of
its strongest window, a document's that of its strongest sentence.  All sentences of
clean documents are clean; of a toxic document at least one is toxic, and which ones,
and by which window, is found in turns with training.  So an insult of two words, each
harmless alone, can be learned and found; one that needs three or more cannot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.llm._common import arrow_map, schema_of, spread
from arrayloom.llm._common import sample as sample_rows
from arrayloom.llm._words import CHUNK_BYTES, chunks, mix, powers

SYMBOLS = 42
SPAN = 6
DECAY = 0.6
LENGTH = 24
#: Two neighbouring words of so many symbols are a window too.
PAIR = 14
#: Windows are scored in matrices of these widths, by their size.
WIDTHS = (8, PAIR, LENGTH)
#: Training sample: rows of each label at most, and bytes of a row at most.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 20_000
LANDMARKS = 160
ROUNDS = 4
#: Times that a pair of words must come in toxic sentences to be an example.
REPEATS = 5
THRESHOLD = 0.7

# The symbol of each byte: a-z 1 to 26, digits 27, later bytes of characters beyond
# ASCII 28 to 41; 0 is dropped, and SPACES separate tokens.
_CODE = np.zeros(256, dtype=np.uint8)
_CODE[0x61:0x7B] = _CODE[0x41:0x5B] = np.arange(1, 27)
_CODE[0x30:0x3A] = 27
_CODE[0x80:0xC0] = 28 + (np.arange(0x80, 0xC0) & 0x1F) % 14  # capitals are 32 before small letters
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[0x21, 0x2E, 0x3F]] = True
_STEPS = [(i, j) for i in range(1, SPAN - 1) for j in range(1, SPAN - i)]


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, sentence, first, end, symbols): the windows as slices of ``symbols``.

    Runs of single symbols are one word, as in words that are spaced out.  A word
    longer than LENGTH becomes overlapping pieces.  The kth sentence is 2k for its words
    and 2k+1 for its pairs of words.
    """
    code = _CODE[data]
    keep = code > 0
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[keep]
    word = np.cumsum(_SPACE[data])[keep]
    stop = data == 0x0A
    stop[:-1] |= _STOP[data[:-1]] & _SPACE[data[1:]]
    line = np.cumsum(stop)[keep]
    symbols = code[keep]
    if not len(symbols):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, symbols
    new = np.concatenate(([True], (word[1:] != word[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate((first, [len(symbols)])))
    owner = text[first]
    glued = np.concatenate(([False], (size[1:] == 1) & (size[:-1] == 1) & (owner[1:] == owner[:-1])))
    first, owner = first[~glued], owner[~glued]
    size = np.diff(np.concatenate((first, [len(symbols)])))
    line = line[first]
    sentence = np.cumsum(np.concatenate(([False], (line[1:] != line[:-1]) | (owner[1:] != owner[:-1]))))
    pair = np.flatnonzero((sentence[1:] == sentence[:-1]) & (size[1:] + size[:-1] <= PAIR))
    half = LENGTH // 2
    pieces = np.where(size > LENGTH, -(-(size - half) // half), 1)
    inner = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    end = np.repeat(first + size, pieces)
    start = np.repeat(first, pieces) + inner * half
    both = lambda c: np.concatenate([np.repeat(c, pieces), c[pair]])
    sentence = 2 * both(sentence) + (np.arange(len(start) + len(pair)) >= len(start))
    return both(owner), sentence, np.concatenate([start, first[pair]]), np.concatenate([np.minimum(end, start + LENGTH), first[pair] + size[pair] + size[pair + 1]]), symbols


def distinct(first: np.ndarray, end: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, which): the distinct windows' symbols, 0 where they end, and each window's row."""
    total = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(mix(symbols.astype(np.uint64)) * powers(len(symbols))[: len(symbols)], out=total[1:])
    key = mix((total[end] - total[first]) * powers(len(symbols), True)[first] + (end - first).astype(np.uint64))
    _, at, which = np.unique(key, return_index=True, return_inverse=True)
    out = np.zeros((len(at), LENGTH), dtype=np.uint8)
    for k in range(0, len(at), 65536):
        own = at[k : k + 65536]
        place = first[own][:, None] + np.arange(LENGTH)
        out[k : k + 65536] = np.where(place < end[own][:, None], symbols[np.minimum(place, len(symbols) - 1)], 0)
    return out, which.astype(np.int32)


def _reach(size: np.ndarray) -> np.ndarray:
    """The length of a window's features, if no subsequence came twice."""
    total = sum(DECAY ** (2 * (i + j + 1)) * np.maximum(size - i - j, 0) for i, j in _STEPS)
    return np.sqrt(np.maximum(total, 1e-9))


def scores(matrix: np.ndarray, weights: np.ndarray, at_row: np.ndarray | None = None) -> np.ndarray:
    """The normalised sum of the weights of each window's subsequences.

    ``at_row``, if given, is the row of ``weights`` for each subsequence.
    """
    out = np.zeros((len(matrix), *weights.shape[1:]))
    size = (matrix > 0).sum(1)
    low = 0
    for width in WIDTHS:
        own = np.flatnonzero((size > low) & (size <= width))
        low = width
        for k in range(0, len(own), 8192):
            part = own[k : k + 8192]
            rows = matrix[part, :width].astype(np.int32)
            for i, j in _STEPS:
                at = (rows[:, : width - i - j] * SYMBOLS + rows[:, i : width - j]) * SYMBOLS + rows[:, i + j :]
                got = weights[at if at_row is None else at_row[at]]
                got[rows[:, i + j :] == 0] = 0
                out[part] += DECAY ** (i + j + 1) * got.sum(1)
    norm = _reach(size)
    return out / (norm if out.ndim == 1 else norm[:, None])


def features(matrix: np.ndarray) -> np.ndarray:
    """The normalised features themselves, dense: for landmarks only."""
    out = np.zeros((len(matrix), SYMBOLS**3), dtype=np.float32)
    rows = matrix.astype(np.int64)
    for i, j in _STEPS:
        at = (rows[:, : LENGTH - i - j] * SYMBOLS + rows[:, i : LENGTH - j]) * SYMBOLS + rows[:, i + j :]
        who, where = np.nonzero(rows[:, i + j :] > 0)
        np.add.at(out, (who, at[who, where]), DECAY ** (i + j + 1))
    return out / _reach((matrix > 0).sum(1))[:, None]


@dataclass(frozen=True)
class Model:
    """Weights of subsequences, a bias, and the logistic map from margin to score."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine by Newton's method; weights and bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(25):
        active = y * (x @ w) < 1
        a, c = x[active], cost[active][:, None]
        new = np.linalg.solve(penalty + a.T @ (a * c), (a * c).T @ y[active])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Platt's map, by Newton's method with smoothed targets and a positive slope."""
    n1, n0 = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        s = p * (1 - p) + 1e-6
        h = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = max(a - step[0], 0.05), b - step[1]
    return float(a), float(b)


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> Model:
    """Train on the sentences of labelled texts; with one label alone every text scores its share."""
    flat = Model(np.zeros(SYMBOLS**3, dtype=np.float32), 0.0, 0.0, 0.0)
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(flat.weights, 0.0, 0.0, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    docs, lines, firsts, ends, pieces, base, count = [], [], [], [], [], 0, 0
    for i, _, data, offsets in chunks(texts):
        owner, sentence, first, end, symbols = windows(data, offsets)
        docs.append((owner + i).astype(np.int32))
        lines.append((sentence + count).astype(np.int32))
        firsts.append((first + base).astype(np.int32))  # a sample has far fewer than 2**31 bytes
        ends.append((end + base).astype(np.int32))
        pieces.append(symbols)
        base += len(symbols)
        count += int(sentence.max(initial=-1)) // 2 * 2 + 2
    doc, line, symbols = np.concatenate(docs), np.concatenate(lines), np.concatenate(pieces)
    first, end = np.concatenate(firsts), np.concatenate(ends)
    del docs, lines, firsts, ends, pieces
    matrix, which = distinct(first, end, symbols)
    _, at = np.unique(line * np.int64(len(matrix)) + which, return_index=True)
    doc, line, token = doc[at], line[at], which[at]  # each window once a sentence
    del first, end, which, at
    toxic = labels[doc] == 1

    def strongest(score: np.ndarray, by: np.ndarray = doc, n: int = len(labels)) -> np.ndarray:
        out = np.full(n, score.min() if len(score) else 0.0)
        np.maximum.at(out, by, score[token])
        return out

    in_clean = np.bincount(token[~toxic], minlength=len(matrix))
    # A pair of words tells something only if it comes again in toxic texts.
    word = (np.bincount(token[line % 2 == 0], minlength=len(matrix)) > 0) | (np.bincount(token[toxic], minlength=len(matrix)) >= REPEATS)
    score, own, heard = np.zeros(len(matrix)), np.flatnonzero(word), word[token]
    score[own] = _first_guess(matrix[own], doc[heard], (np.cumsum(word) - 1)[token[heard]], labels)
    clean = np.flatnonzero(in_clean > 0)
    for turn in range(ROUNDS):
        heard = np.where(word, score, score.min())
        top, peak = strongest(heard), score[token] >= strongest(score, line, count)[line]  # a sentence's strongest windows
        close = toxic & word[token] & (score[token] >= np.where(top > 0, 0.75, 1.0)[doc] * top[doc]) & (in_clean[token] == 0)
        good = np.unique(token[close])
        if not len(good):
            good = np.unique(token[toxic & (heard[token] == top[doc])])
        weight = np.bincount(token[close], minlength=len(matrix))[good].astype(float) if close.any() else np.ones(len(good))
        seen = np.unique(token[~toxic & peak])
        hard = seen[np.argsort(-score[seen], kind="stable")[:4000]]
        bad = np.unique(np.concatenate([hard, rng.choice(clean, min(len(clean), 6000), replace=False)]))
        some = good[np.argsort(-weight, kind="stable")[: LANDMARKS // 4]]
        rest = np.setdiff1d(good, some)
        marks = np.concatenate([some, rng.choice(rest, min(len(rest), LANDMARKS // 4), replace=False), hard[: LANDMARKS // 4], rng.choice(clean, min(len(clean), LANDMARKS // 4), replace=False)])
        z = features(matrix[np.unique(marks)])
        used = np.flatnonzero(z.any(0))  # the subsequences that landmarks have
        z = z[:, used].astype(np.float64)
        at_row = np.full(SYMBOLS**3, len(used))
        at_row[used] = np.arange(len(used))
        gram = z @ z.T
        values, vectors = np.linalg.eigh(gram)
        ok = values > 1e-6 * values.max()
        nystrom = vectors[:, ok] / np.sqrt(values[ok])
        use, marked = np.concatenate([good, bad]), np.concatenate([z.T, np.zeros((1, len(z)))])
        kernel = np.concatenate([scores(matrix[use[k : k + 256]], marked, at_row) for k in range(0, len(use), 256)])
        y = np.concatenate([np.ones(len(good)), -np.ones(len(bad))])
        cost = np.concatenate([np.minimum(weight, 20) / np.minimum(weight, 20).sum(), np.full(len(bad), 1.0 / len(bad))]) * len(use) / 2
        w, bias = _machine(kernel @ nystrom, y, cost)
        weights = np.zeros(SYMBOLS**3)
        weights[used] = z.T @ (nystrom @ w)
        score = scores(matrix, weights) + bias
    slope, shift = _logistic(strongest(score), labels)
    return Model(weights.astype(np.float32), bias, slope, shift)


def _first_guess(matrix: np.ndarray, doc: np.ndarray, token: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Each window's best part of four symbols, by how much more toxic documents have it."""
    rows = matrix.astype(np.int32)
    parts = ((rows[:, :-3] * SYMBOLS + rows[:, 1:-2]) * SYMBOLS + rows[:, 2:-1]) * SYMBOLS + rows[:, 3:]
    parts[rows[:, 3:] == 0] = -1
    names, index = np.unique(parts, return_inverse=True)
    index = index.reshape(parts.shape)
    counts = np.zeros((2, len(names)))
    for label in (0, 1):
        own = labels[doc] == label
        for k in range(0, int(own.sum()), 200_000):
            d, t = doc[own][k : k + 200_000], token[own][k : k + 200_000]
            width = parts.shape[1]
            pair = np.unique(np.repeat(d, width) * len(names) + index[t].ravel())
            counts[label] += np.bincount(pair % len(names), minlength=len(names))
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    p1, p0 = counts[1] / n1, counts[0] / n0
    mean = np.clip((counts[1] + counts[0] + 0.5) / (n1 + n0 + 1), 1e-9, 1 - 1e-9)
    z = (p1 - p0) / np.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0))
    z[names == -1] = 0.0
    return np.maximum(z[index].max(1), 0.0)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a sample of ``labels``: at most ``rows`` of each label, by a hash of the key.

    Rows with a null key or label take no part, nor do null texts and those beyond
    ``most_bytes``; of several labels of one key the largest holds.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    sample = sample_rows(known, "y", "k", rows, 2).select("k", "y")
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.octet_length("t") <= most_bytes)).join(F.broadcast(sample), "k")
    rows_ = found.groupBy("k").agg(F.max("y").alias("y"), F.max("t").alias("t")).toArrow().sort_by("k")
    return fit(rows_.column("t").combine_chunks(), rows_.column("y").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add score, from 0 to 1, to every row: that of the strongest sentence of the whole text.

    Null and empty texts, and texts without a word of three symbols, get the score of
    the bias alone.  Equal texts score alike; long texts count whole; an empty table
    gives none.  A column called score is replaced, all others are kept.
    """
    docs = spread(docs.drop("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index(text), [*docs.columns, "score"]
    kind = schema_of(docs, "score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            margin = np.full(batch.num_rows, own.bias)
            for i, j, data, offsets in chunks(batch.column(at), CHUNK_BYTES):
                owner, _, first, end, symbols = windows(data, offsets)
                if len(owner):
                    matrix, which = distinct(first, end, symbols)
                    part = scores(matrix, own.weights) + own.bias
                    best = np.full(j - i, -np.inf)
                    np.maximum.at(best, owner, part[which])
                    margin[i:j] = np.where(np.isinf(best), own.bias, best)
            value = 1 / (1 + np.exp(-np.clip(own.slope * margin + own.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=names)

    return arrow_map(docs, run, kind)
