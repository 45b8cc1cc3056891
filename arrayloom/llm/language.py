"""Language identification by Bayesian fusion of four kinds of evidence.

log P(language | row) adds: the likelihood of the text under character trigrams; that
of the language which the markup declares; that of the suffix of the address; and the
prior of the host, smoothed towards its domain and that towards all rows.  The last
three are learned by grouped counts of what the texts alone say, over all rows, less
the row's own vote.  The suffix is no level of the host's prior, so it counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.llm._common import BROADCAST_ROWS, arrow_map, cut, fresh, lookup, schema_of, spread
from arrayloom.llm._common import sample as sample_rows
from arrayloom.llm._words import CHUNK_BYTES, chunks

UNKNOWN = "und"
#: Training sample: at most so many labelled rows a language, each of at most so many bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 20_000
BUCKETS = 1 << 16
#: Overlapping trigrams are not independent; each counts as this share of evidence.
TEMPER = 0.3
#: Pseudo-counts of a level of the host hierarchy in the one below, and of a likelihood's prior.
STRENGTH = 20.0
#: How often the markup tells the truth, before any is counted.
TRUST = 0.95
#: The least posterior of a language that is accepted, and the prior of none of them.
LEAST, NONE = 0.5, 0.01


@dataclass(frozen=True)
class Model:
    """Log-likelihoods of hashed trigrams: a row per language, the last for none of them."""

    languages: tuple[str, ...]
    table: np.ndarray


def _fold(data: np.ndarray) -> np.ndarray:
    """Letters in lower case, also accented Latin ones; all else that is ASCII a space."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    table[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
    out = table[data]
    if len(data) > 1:  # U+00C0 to U+00DE are C3 80 to C3 9E; their small letters 32 further
        upper = np.zeros(len(data), dtype=bool)
        upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[upper] += 32
    return out


def trigrams(data: np.ndarray, offsets: np.ndarray, step: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of the byte trigrams inside each text, but those of spaces alone.

    They come in pieces of at most ``step``, so a long text takes no more memory.
    """
    for at in range(0, len(data) - 2, step):
        n, skip = min(step, len(data) - 2 - at), min(at, 1)
        small = _fold(data[at - skip : at + n + 2])[skip:].astype(np.uint32)
        code = (small[:-2] << np.uint32(16)) | (small[1:-1] << np.uint32(8)) | small[2:]
        bucket = (code * np.uint32(2654435761)) >> np.uint32(16)
        held = np.diff(np.clip(offsets, at, at + n))
        text = np.repeat(np.arange(len(held)), held)
        inside = np.arange(at + 3, at + n + 3) <= np.repeat(offsets[1:], held)
        use = inside & ~((small[1:-1] == 0x20) & ((small[:-2] == 0x20) | (small[2:] == 0x20)))
        yield text[use], bucket[use]


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, bucket, n) of each batch of (label, text)."""
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        which, counts = names.indices.to_numpy(), np.zeros((len(names.dictionary), BUCKETS), dtype=np.int64)
        for i, _, data, offsets in chunks(batch.column(1)):
            for text, bucket in trigrams(data, offsets):
                pairs = which[i + text].astype(np.int64) * BUCKETS + bucket
                counts += np.bincount(pairs, minlength=counts.size).reshape(counts.shape)
        k, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(k)), pa.array(bucket.astype(np.int32)), pa.array(counts[k, bucket])], names=["label", "bucket", "n"])


def train(docs: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, most_languages: int = 200) -> Model:
    """Fit the trigram model on a sample of labelled rows, chosen by a hash of the text.

    The bounds are ``rows`` a language, ``most_bytes`` a row and ``most_languages``
    languages, by name; null labels and texts, and empty texts, take no part.  Equal texts
    take one place of the sample, so a large group of copies does not fill it.  Trigrams
    are counted where the rows are: the driver gets one number per language and bucket.
    """
    usable = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & (F.octet_length(text) <= most_bytes) & (F.octet_length(text) > 0))
    usable = usable.select(F.col(label).cast("string").alias("label"), F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    picked = sample_rows(usable.select("label", "key", "hash"), "label", "hash", rows, most_languages).distinct()
    same = F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.hash") == F.col("b.hash")) & (F.col("a.label") == F.col("b.label"))
    found = usable.alias("a").join(F.broadcast(picked.alias("b")), same, "left_semi").select("label", "text")
    got = arrow_map(found, _bucket_counts, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = tuple(sorted(set(got.column("label").to_pylist())))
    at = {name: k for k, name in enumerate(names)}
    counts = np.zeros((len(names) + 1, BUCKETS))
    counts[np.array([at[x] for x in got.column("label").to_pylist()], dtype=np.int64), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    smooth = counts + 0.05
    table = np.log(smooth / smooth.sum(1, keepdims=True))
    table[-1] = -np.log(BUCKETS) + 1.0  # none of them: any trigram is as likely
    return Model(names, table.astype(np.float32))


def text_evidence(rows: DataFrame, model: Model, text: str, name: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``name``, the text's log-likelihoods per language and for none of them."""
    shared = rows.sparkSession.sparkContext.broadcast(model.table)
    at, kept = rows.columns.index(text), [rows.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            out = np.zeros((batch.num_rows, len(table)))
            for i, j, data, offsets in chunks(batch.column(at)):
                for owner, bucket in trigrams(data, offsets):
                    for k in range(len(table)):
                        out[i:j, k] += np.bincount(owner, table[k][bucket], minlength=j - i) * TEMPER
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), lists], names=[*keep, name])

    return arrow_map(rows, run, schema_of(rows.select(keep), f"`{name}` array<double>"))


def _counts(told: DataFrame, key: str, vote: str, n: int) -> DataFrame:
    """(key, counts, n): the votes for each language, and the rows, of each non-null key."""
    each = [F.sum((F.col(vote) == k).cast("long")).alias(f"c{k}") for k in range(n)]
    got = told.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), *each)
    return cut(got.select(key, F.array(*[F.coalesce(f"c{k}", F.lit(0)).cast("double") for k in range(n)]).alias("counts"), "n"))


def _sums(counts: DataFrame, n: int) -> list[Column]:
    return [F.sum(F.get("counts", F.lit(k))).alias(f"c{k}") for k in range(n)]


def host_counts(told: DataFrame, host: str, vote: str, n: int) -> tuple[DataFrame, list[float]]:
    """(host, own, domain, n) with the votes of each host and of its domain, and those of all rows.

    The domain is the last two labels of the host.  ``told`` has a vote, the index of
    the language that the text alone says, or null.
    """
    hosts = _counts(told, host, vote, n)
    domain = F.array_join(F.slice(F.split(host, r"\."), F.greatest(F.size(F.split(host, r"\.")) - 1, F.lit(1)), 2), ".")
    hosts = hosts.withColumn("name", domain)
    domains = hosts.groupBy("name").agg(*_sums(hosts, n)).select("name", F.array(*[f"c{k}" for k in range(n)]).alias("domain"))
    everywhere = [x or 0.0 for x in hosts.agg(*_sums(hosts, n)).first()]
    return cut(hosts.join(domains, "name").select(host, F.col("counts").alias("own"), "domain", "n")), everywhere


def _below(own: Column, above: Column, n: int) -> Column:
    """Shares of the counts ``own``, smoothed towards the shares ``above``."""
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(own, above, lambda c, p: (c + STRENGTH * p) / (total + STRENGTH))


def _likelihood(told: DataFrame, key: str, vote: str, own: str, names: tuple[str, ...], out: str, trust: float | None) -> DataFrame:
    """Add ``out``: log P(key | language), learned by grouped counts; null where the key is.

    Before any row is counted all values are as likely, or, with ``trust``, the value that
    is the language's own name has that probability.  For none of the languages all
    values are as likely.
    """
    n = len(names)
    table = _counts(told.where(F.col(vote).isNotNull()), key, vote, n)
    *totals, kinds = table.agg(*_sums(table, n), F.count(F.lit(1)).alias("kinds")).first()
    kinds = max(1, kinds)
    told = lookup(told, table.withColumnRenamed("counts", out).withColumnRenamed("n", f"{out}n"), [key], f"{out}n", BROADCAST_ROWS // (n + 1)).drop(f"{out}n")
    each = []
    for k, name in enumerate(names):
        prior = F.lit(1.0 / kinds) if trust is None else F.when(F.col(key) == name, F.lit(trust)).otherwise(F.lit((1 - trust) / kinds))
        mine = F.get(own, F.lit(k))
        seen = F.greatest(F.coalesce(F.get(out, F.lit(k)), F.lit(0.0)) - mine, F.lit(0.0))
        each.append(F.log((seen + STRENGTH * prior) / (F.lit(float(totals[k] or 0.0)) - mine + STRENGTH)))
    return told.withColumn(out, F.when(F.col(key).isNotNull(), F.array(*each, F.log(F.lit(1.0 / kinds)))))


def identify(rows: DataFrame, model: Model, text: str = "text", host: str | None = None, declared: str | None = None, suffix: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) with language, posterior and accepted, for every row.

    ``host``, ``declared`` and ``suffix`` name columns with the address's host, the
    language of the markup and the last label of the host; those not given, and nulls
    in them, say nothing.  The extra class ``und`` stands for texts of none of the
    languages.  A row is accepted if its most probable class is a language with a
    posterior of LEAST or more and its text holds a letter; the language of other rows
    is ``und``.  Null and empty texts are never accepted and have no vote; repeated rows
    are judged alike and vote each; a model without languages accepts nothing; an empty
    table gives none.  Long texts are read in pieces.  Columns of ``rows`` that bear one
    of the three added names are replaced; all other names may occur.

    The texts' evidence is computed once and written; hosts, suffixes and declared
    languages are grouped from it with partial sums, and joined back by broadcast, or,
    when there are too many of them, with hot ones apart.
    """
    names, n = model.languages, len(model.languages)
    new = ["language", "posterior", "accepted"]
    keep = [c for c in (rows.columns if keep is None else keep) if c not in new]
    ll, h, s, d, letters, vote, own, prior, domain, like_s, like_d, score, at, size, body = fresh(rows.columns, "ll", "host", "suffix", "declared", "letters", "vote", "own", "prior", "domain", "ls", "ld", "score", "at", "size", "text")
    if not n:
        return rows.select(keep).withColumn("language", F.lit(UNKNOWN)).withColumn("posterior", F.lit(0.0)).withColumn("accepted", F.lit(False))
    null = F.lit(None).cast("string")
    primary = F.lower(F.substring_index(F.substring_index(F.col(declared), "-", 1), "_", 1)) if declared else null
    given = [(F.col(host).cast("string") if host else null).alias(h), (F.lower(F.col(suffix)) if suffix else null).alias(s), F.when(primary != "", primary).alias(d)]
    has = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(letters)
    told = spread(rows.select(*keep, *given, has, F.col(text).alias(body)))
    told = cut(text_evidence(told, model, body, ll, [*keep, h, s, d, letters]))

    said = F.array_position(ll, F.array_max(ll)).cast("int") - 1
    told = told.withColumn(vote, F.when(F.col(letters) & (said < n), said))
    told = told.withColumn(own, F.array(*[F.when(F.col(vote) == k, 1.0).otherwise(0.0) for k in range(n)]))
    total = F.col(ll)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    if host:
        table, everywhere = host_counts(told, h, vote, n)
        table = table.select(h, F.col("own").alias(prior), F.col("domain").alias(domain), F.col("n").alias(size))
        told = lookup(told, table, [h], size, BROADCAST_ROWS // (2 * n + 1)).drop(size)
        less = lambda c: F.zip_with(c, own, lambda a, b: a - b)
        flat = F.array_repeat(F.lit(1.0 / n), n)
        above = _below(less(F.array(*[F.lit(float(x)) for x in everywhere])), flat, n)
        shares = _below(less(F.col(prior)), _below(less(F.col(domain)), above, n), n)
        shares = F.transform(F.when(F.col(h).isNotNull(), shares).otherwise(flat), lambda p: F.log(p * (1 - NONE)))
        total = add(total, F.concat(shares, F.array(F.log(F.lit(NONE)))))
    for key, like, trust, there in ((s, like_s, None, suffix), (d, like_d, TRUST, declared)):
        if there:
            told = _likelihood(told, key, vote, own, names, like, trust)
            total = F.when(F.col(like).isNull(), total).otherwise(add(total, F.col(like)))
    told = told.withColumn(score, total)
    best = F.array_max(score)
    told = told.withColumn(at, F.array_position(score, best).cast("int") - 1)
    told = told.withColumn("posterior", 1.0 / F.aggregate(score, F.lit(0.0), lambda a, x: a + F.exp(x - best)))
    told = told.withColumn("accepted", F.col(letters) & (F.col(at) < n) & (F.col("posterior") >= LEAST))
    told = told.withColumn("language", F.when(F.col("accepted"), F.get(F.array(*map(F.lit, names)), F.col(at))).otherwise(UNKNOWN))
    return told.select(*keep, *new)


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Columns _text, _host, _suffix and _declared of web pages.

    The text is what stands outside tags, scripts and styles; the host is in lower
    case, without a port; the declared language is the lang attribute of the html tag.
    Nulls give nulls; columns of these four names are replaced.
    """
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    declared = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", 1)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    none = lambda c: F.when(c != "", c)
    return pages.withColumn("_text", bare).withColumn("_host", none(host)).withColumn("_suffix", none(F.element_at(F.split(host, r"\."), -1))).withColumn("_declared", none(F.lower(declared)))
