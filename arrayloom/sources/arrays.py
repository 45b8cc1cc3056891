"""Arrays from tables and from rules: DataFrames (i, v), (i0, i1, v) or (i, j, v)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.functions import index as ix


#: Elements that one task makes by a rule.
SLICE = 1 << 24


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def origin(df: DataFrame, key: str, value: str | Column) -> DataFrame:
    """Existing rows as an array keyed by ``key``."""
    return df.select(F.col(key).cast("long").alias("i"), (F.col(value) if isinstance(value, str) else value).cast("double").alias("v"))


def generate(spark: SparkSession, n: int, value: Column | float) -> DataFrame:
    """An array of ``n`` elements; ``value`` may use the column i."""
    return spark.range(n).select(F.col("id").alias("i")).withColumn("v", (value if isinstance(value, Column) else F.lit(value)).cast("double"))


def delta(spark: SparkSession, n: int, at: int = 0) -> DataFrame:
    return generate(spark, n, F.when(F.col("i") == at, 1.0).otherwise(0.0))


def linear_fill(spark: SparkSession, shape: list[int]) -> DataFrame:
    """Every element's value is its row-major linear index; a task makes SLICE of them at most."""
    coords, n = ix.delinear(F.col("id"), shape), math.prod(shape)
    return spark.range(0, n, 1, max(spark.sparkContext.defaultParallelism, -(-n // SLICE))).select(*[c.alias(f"i{k}") for k, c in enumerate(coords)], F.col("id").cast("double").alias("v"))


def process_fill(spark: SparkSession, n: int, p: int) -> DataFrame:
    """Every element's value is its block."""
    return generate(spark, n, ix.block(F.col("i"), n, p))


def moving_weight(i: Column, n: int, centre: float) -> Column:
    """The work at i of a load that is centred at ``centre``."""
    return 1 + math.sqrt(n) * F.exp(-F.pow((i - centre) / 10, 2))


def random_coordinates(spark: SparkSession, n: int, d: int = 2, seed: int = 0) -> DataFrame:
    """``n`` points, each coordinate even in [0, 1): a hash of seed, point and axis, however rows are dealt."""
    at = lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id"), F.lit(k)), 11) / F.lit(float(1 << 53))
    return spark.range(n).select(F.col("id").alias("i"), *[at(k).alias(f"c{k}") for k in range(d)])


def initial_centres(spark: SparkSession, k: int, d: int = 2) -> DataFrame:
    """Cluster centres on the diagonal."""
    return spark.range(k).select(F.col("id").alias("k"), *[(F.col("id") / F.lit(k)).alias(f"c{x}") for x in range(d)])


def banded(spark: SparkSession, n: int, bands: dict[int, float]) -> DataFrame:
    """A square matrix (i, j, v) with a constant on each diagonal j-i, clipped at the edges."""
    entries = F.array(*[F.struct(F.lit(k).cast("long").alias("d"), F.lit(float(v)).alias("v")) for k, v in sorted(bands.items())])
    rows = spark.range(n).select(F.col("id").alias("i"), F.explode(entries).alias("e"))
    return rows.select("i", (F.col("i") + F.col("e.d")).alias("j"), "e.v").where((F.col("j") >= 0) & (F.col("j") < n))


def toeplitz(spark: SparkSession, n: int, left: float = -1.0, diagonal: float = 2.0, right: float = -1.0) -> DataFrame:
    return banded(spark, n, {-1: left, 0: diagonal, 1: right})


def constant(x: DataFrame, value: float) -> DataFrame:
    """``x`` with every value set to a constant."""
    return x.withColumn("v", F.lit(float(value)))


def no_fill(x: DataFrame) -> DataFrame:
    """The fill that does nothing, and the step of local diffusion that does nothing either."""
    return x


def predictable_points(spark: SparkSession, n: int, k: int, d: int = 2) -> DataFrame:
    """``n`` points, each on the one of ``k`` diagonal centres whose number is i mod k."""
    return spark.range(n).select(F.col("id").alias("i"), *[(F.pmod(F.col("id"), F.lit(k)) / F.lit(k)).alias(f"c{x}") for x in range(d)])
