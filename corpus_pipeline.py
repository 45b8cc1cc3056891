"""From raw documents to packed batches, in five stages of whole-table operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.llm import decontaminate, language, lines, neardup, pack
from arrayloom.llm._common import cut, fresh
from arrayloom.plans.ship import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` without columns called ``names``, and the columns as they were called."""
    taken = [c for c in docs.columns if c.lower() in names]
    moved = dict(zip(taken, fresh([*docs.columns, *names], *taken), strict=True))
    return docs.withColumnsRenamed(moved), [F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is told with enough certainty.

    Null, empty and letterless texts go; long texts are read whole.  Documents without
    a label teach nothing, those without a source are judged by their text alone.
    Repeated rows share their fate, an empty table gives none, and other columns are
    kept as they are, whatever their names.
    """
    ship(spark)
    docs, columns = _aside(docs, ["language", "posterior", "accepted"])
    return language.identify(docs, language.train(docs), host="source").where("accepted").select(columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated three-line passages out of the texts; n_chars follows.

    No row goes.  Null texts stay null with null n_chars; empty texts stay empty; long
    texts cost time in proportion; repeated rows keep their lines, an equal text of a
    larger doc_id loses them; a null doc_id is the smallest; an empty table gives none.
    Other columns are kept as they are, whatever their names.
    """
    docs, columns = _aside(docs, ["n_lines", "n_removed"])
    return lines.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least id of each class of near duplicates.

    Null texts and texts without words are no duplicates and stay, so do documents with
    a null id, which is the least; repeated rows of one id stay or go together; long
    texts are one signature; an empty table gives none.  Columns are kept as they are.
    """
    ship(spark)
    return neardup.drop_near_duplicates(docs).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no ten words in a row of a benchmark item.

    Null and empty texts hold none and stay; long texts are scanned whole; repeated
    rows share their fate; an empty table gives none.  Columns are kept as they are,
    whatever their names.
    """
    ship(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs, columns = _aside(docs, ["n_words", "n_hit", "item_ids", "spans"])
    return decontaminate.scan(docs, benchmark).where("n_hit = 0").select(columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document, with its text, in a length bucket and a batch.

    Null and empty texts have length 0; a text beyond the budget is a batch by itself,
    whole; repeated rows and null ids have a slot each; an empty table gives none.
    Columns called n_tokens, bucket, padded_tokens, batch or slot are replaced.
    """
    return pack.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_batches),
]

#: Training, components and the packing program are not SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = cut(docs)
    return docs
